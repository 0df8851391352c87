"""Nested outlines and washers: deep nests cost their depth, not its square."""

import math
import random

from pyspark.sql import functions as F

from cutledger.operators import drawings as drw
from cutledger.operators import spatial

CIRCLE = "drawing_id int, layer string, id long, cx double, cy double, r double"


def test_concentric_rings_ask_for_two_candidates_each(spark):
    rows = [(1, i, (-1.0 - i, -1.0 - i, 1.0 + i, 1.0 + i), 4.0 * (1 + i) ** 2) for i in range(2_000)]
    boxes = spark.createDataFrame(rows, "k int, id long, box struct<min_x:double,min_y:double,max_x:double,max_y:double>, size double").withColumn("node", F.col("id"))
    asked = boxes.select("k", "node", "box", F.col("size").alias("after_size"), F.lit((1 << 63) - 1).alias("after_id"))
    got = {r.node: [h.id for h in r.holders] for r in spatial.smallest_holders(asked, boxes, ["k"], 2).collect()}
    assert got == {i: [i + 1, i + 2][: 1999 - i] for i in range(1_999)}


def test_parents_in_a_deep_nest(spark):
    schema = "drawing_id int, layer string, id long, rings array<array<array<double>>>"
    square = lambda s: [[-s, -s], [s, -s], [s, s], [-s, s]]
    rows = [(1, "a", i, [square(10.0 * (i + 1))]) for i in range(120)]
    # many outlines whose boxes hold the smallest one, and that do not hold it
    bent = lambda s: [[-s, -s], [s, -s], [s, s], [s - 9, s], [s - 9, -s + 9], [-s, -s + 9]]
    rows += [(2, "a", 1_000 + i, [bent(100.0 + i)]) for i in range(30)] + [(2, "a", 2_000, [square(5.0)]), (2, "a", 2_001, [square(900.0)])]
    got = {r.id: r.parent_id for r in drw.containment_parent(spark.createDataFrame(rows, schema), 0.1).collect()}
    assert all(got[i] == i + 1 for i in range(119)) and got[119] is None
    assert got[2_000] == 2_001 and got[2_001] is None and len(got) == len(rows)


def greedy(rows, base):
    """Largest first, a circle not yet taken takes every smaller coaxial one not yet taken."""
    out = {}
    for d in {r[:2] for r in rows}:
        mine = sorted({(r[3], r[4], r[5]): min(q[2] for q in rows if q[:2] == d and q[3:] == r[3:]) for r in rows if r[:2] == d}.items(), key=lambda c: (-c[0][2], c[1]))
        outers = []
        for (x, y, r), i in mine:
            near = [(-R, o) for (X, Y, R), o in outers if R > r and math.hypot(x - X, y - Y) <= max(base, 0.02 * R)]
            mother = min(near)[1] if near else None
            if mother is None:
                outers.append(((x, y, r), i))
            for q in rows:
                if q[:2] == d and q[3:] == (x, y, r):
                    out[q[2]] = mother
    return out


def test_washers_match_the_greedy_rule(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        x, y = rnd.choice([0.0, 40.0, 41.0]) + rnd.choice([0, 0, 0.5, 0.9, 3]), rnd.choice([0.0, 1.0, 200.0])
        rows.append((1 + i % 2, "a", i, x, y, rnd.choice([5.0, 10.0, 12.5, 40.0, 200.0, 800.0, float(rnd.randint(1, 90))])))
    got = {r.id: r.outer_id for r in drw.washers(spark.createDataFrame(rows, CIRCLE), 0.1).collect()}
    assert got == greedy(rows, drw.join_tolerance(0.1))


def test_two_thousand_concentric_circles(spark):
    rows = [(1, "a", i, 7.0, 7.0, 1.0 + i) for i in range(2_000)]
    got = {r.id: r.outer_id for r in drw.washers(spark.createDataFrame(rows, CIRCLE), 0.1).collect()}
    assert got == {i: 1_999 for i in range(1_999)} | {1_999: None}


def test_nothing_nested(spark):
    assert drw.washers(spark.createDataFrame([], CIRCLE), 0.1).count() == 0
