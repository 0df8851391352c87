"""Clusters of touching boxes: the sweep, long and crowded boxes, one path for all."""

import random

import pytest

from cutledger.operators import drawings, spatial

BOX = "drawing_id long, id long, min_x double, min_y double, max_x double, max_y double"


def components(boxes):
    """Smallest id per box by comparing all pairs."""
    label = {b[0]: b[0] for b in boxes}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, a in enumerate(boxes):
        for b in boxes[i + 1 :]:
            if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]:
                x, y = root(a[0]), root(b[0])
                label[max(x, y)] = min(x, y)
    return {k: root(k) for k in label}


def joined(boxes):
    label = {b[0]: b[0] for b in boxes}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    links = list(spatial.sweep(sorted(boxes, key=lambda b: (b[1], b[0]))))
    for a, b in links:
        x, y = root(a), root(b)
        assert x != y, "a link too many"
        label[max(x, y)] = min(x, y)
    return {k: root(k) for k in label}


@pytest.mark.parametrize("seed", range(200))
def test_sweep_matches_all_pairs(seed):
    rnd = random.Random(seed)
    # whole numbers, so that edges and corners often just meet
    boxes = []
    for i in range(rnd.randint(0, 60)):
        x, y = rnd.randint(0, 60), rnd.randint(0, 60)
        boxes.append((i, x, y, x + rnd.choice([0, 1, 2, 3, 30]), y + rnd.choice([0, 1, 2, 3, 30])))
    assert joined(boxes) == components(boxes)


def clustered(spark, rows, pad):
    return {r.id: r.cluster_id for r in drawings.cluster(spark.createDataFrame(rows, BOX), pad).collect()}


def test_long_thin_and_crowded_boxes(spark):
    rnd = random.Random(4)
    rows = [(1, 0, 0.0, 0.0, 12_000.0, 0.0), (1, 1, -50_000.0, 500.0, 50_000.0, 501.0)]
    rows += [(1, 2 + i, *(p := (rnd.uniform(0, 12_000), rnd.uniform(-300, 900))), p[0] + 2, p[1] + 2) for i in range(400)]
    rows += [(1, 500 + i, *(p := (rnd.uniform(0, 5), rnd.uniform(2_000, 2_005))), p[0] + rnd.uniform(0, 20), p[1] + 20) for i in range(300)]
    rows += [(2, 900 + i, 100.0 * i, 0.0, 100.0 * i + 70, 10.0) for i in range(50)] + [(2, 990, 0.0, 0.0, 70.0, 10.0)]
    want = {}
    for d in (1, 2):
        want |= components([(r[1], r[2] - 15, r[3] - 15, r[4] + 15, r[5] + 15) for r in rows if r[0] == d])
    assert clustered(spark, rows, 15.0) == want


def test_links_do_not_grow_with_pairs(spark):
    """Two thousand boxes on one spot, and a comb of long lines crossed by tall boxes: fewer links than boxes in each cell."""
    rows = [(1, i, 0.0, 0.0, 100.0 + i, 100.0) for i in range(2_000)]
    from pyspark.sql import functions as F

    corners = ("min_x", "min_y", "max_x", "max_y")
    boxes = spark.createDataFrame(rows, BOX).select("drawing_id", "id", F.struct(*corners).alias("box"))
    cells = spatial.own_grid(boxes, ["drawing_id"]).count()
    assert cells <= 3 * len(rows) + 10 and spatial.touch_links(boxes, ["drawing_id"]).count() < cells
    comb = [(i, 0.0, 2.0 * i, 1e6, 2.0 * i) for i in range(300)] + [(1_000 + i, 10.0 * i, 0.0, 10.0 * i + 1, 600.0) for i in range(300)]
    assert len(list(spatial.sweep(sorted(comb, key=lambda b: b[1])))) == len(comb) - 1


def test_points_and_no_boxes(spark):
    assert clustered(spark, [(1, 1, 5.0, 5.0, 5.0, 5.0), (1, 2, 5.0, 5.0, 5.0, 5.0), (1, 3, 6.0, 5.0, 6.0, 5.0)], 0.0) == {1: 1, 2: 1, 3: 3}
    assert clustered(spark, [], 15.0) == {}
