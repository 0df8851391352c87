"""Pairs of stacked pieces, limits of the estimate, and small and crowded keys against plain loops."""

from __future__ import annotations

import random

import pytest
from test_round3 import shuffled

from cutledger.operators import drawings as drw
from cutledger.operators import jobs, spatial
from cutledger.plans import layout_queries
from cutledger.session import CLEANUP, kept

BOX = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]]
PLACED = "run_id long, sheet_index int, piece_index int, rings array<array<array<double>>>, x_mm double, y_mm double"


def test_clip_area_pairs_list_stacked_pieces(spark, monkeypatch):
    rows = [(1, 0, i, BOX, 0.0, 0.0) for i in range(3)] + [(1, 0, 3, BOX, 5.0, 5.0), (1, 0, 4, BOX, 9.0, 9.0), (2, 0, 0, BOX, 0.0, 0.0)]
    monkeypatch.setattr(layout_queries.src, "placed", lambda s, d: spark.createDataFrame(rows, PLACED))
    got = {(r.run_id, r.sheet_index, r.a_index, r.b_index, r.shared_mm2) for r in layout_queries.R.queries["u2_clip_area_pairs"](spark, "").collect()}
    at = {i: x for _, _, i, _, x, _ in rows[:5]}
    side = {(a, b): 10.0 - abs(at[a] - at[b]) for a in range(5) for b in range(a + 1, 5)}
    assert got == {(1, 0, a, b, s * s) for (a, b), s in side.items() if s * s > 1}


def components(boxes):
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


@pytest.mark.parametrize("coarse", [0.3, 1.0, 4.0])
def test_groups_of_cells_are_the_components(spark, monkeypatch, coarse):
    monkeypatch.setattr(spatial, "COARSE", coarse)
    rnd = random.Random(9)
    rows = []
    for d, span in ((1, 300), (2, 2_000), (3, 100_000)):
        for _ in range(350):
            x, y = rnd.randint(-span, span), rnd.randint(-span, span)
            rows.append((d, len(rows), float(x), float(y), float(x + rnd.choice([0, 1, 20, 40, 300])), float(y + rnd.choice([0, 1, 20, 40, 300]))))
    want = {}
    for d in (1, 2, 3):
        want |= components([(r[1], r[2] - 15, r[3] - 15, r[4] + 15, r[5] + 15) for r in rows if r[0] == d])
    df = spark.createDataFrame(rows, "drawing_id long, id long, min_x double, min_y double, max_x double, max_y double")
    got = drw.cluster(df, 15.0).collect()
    assert len(got) == len(rows) and {r.id: r.cluster_id for r in got} == want


def test_few_links_leave_a_crowded_drawing(spark):
    boxes = spark.range(20_000).selectExpr("1 as d", "id", "double(id * 37 % 6007) as x", "double(id * 91 % 6011) as y")
    boxes = boxes.selectExpr("d", "id", "named_struct('min_x', x, 'min_y', y, 'max_x', x + 90, 'max_y', y + 90) as box")
    groups = spatial.touching_groups(boxes, ["d"]).groupBy("home").count().collect()
    assert {r["home"]: r["count"] for r in groups}.pop(1) == 20_000
    assert sum(r["count"] for r in groups if r["home"] == 0) < 2_000


def shuffle_files(spark) -> int:
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_stored_tables_leave_no_shuffle_behind(spark):
    spark.sparkContext._jvm.System.gc()
    before = shuffle_files(spark)
    rows = kept(spark.range(1_000).repartition(7, "id"), "rows")
    assert shuffle_files(spark) <= before and rows.count() == 1_000
    assert spark.conf.get(CLEANUP, None) is None


def test_small_keys_read_each_side_once(spark, tmp_path):
    ring = "array(array(array(0D, 0D), array(w, 0D), array(w, w), array(0D, w)))"
    pieces = spark.range(60).selectExpr("id div 12 as k", "id", "cast(id % 12 as int) as piece_index", "double(20 + id % 3 * 40) as w")
    pieces = pieces.selectExpr("k", "id", "piece_index", f"{ring} as rings", "named_struct('min_x', 0D, 'min_y', 0D, 'max_x', w, 'max_y', w) as box")
    pieces.write.parquet(str(tmp_path / "pieces"))
    points = spark.range(60).selectExpr("id div 12 as k", "id", "id * 29 % 100 + 0.5D as x", "id * 31 % 100 + 0.5D as y")
    points.write.parquet(str(tmp_path / "points"))
    plan = drw.attach_points(spark.read.parquet(str(tmp_path / "points")), spark.read.parquet(str(tmp_path / "pieces")), ["k"])
    assert plan.count() and plan._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


def test_hole_fillers_of_small_and_crowded_keys(spark, monkeypatch):
    """Plugs, copies of thin frames whose hole is larger than themselves, nested frames."""
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s]]
    rows = []
    for k in range(4):
        for i in range(9):
            x, y, s = 200.0 * i, 50.0 * k, [10.0, 30.0, 60.0][i % 3]
            frame = [square(x, y, 100.0), square(x + 50 - s, y + 50 - s, 2 * s)[:4]] if s < 50 else [square(x, y, 100.0), square(x + 4, y + 4, 92.0)]
            rows += [(k, "L", 100 * k + 10 * i, frame), (k, "L", 100 * k + 10 * i + 1, frame)]
            rows += [(k, "L", 100 * k + 10 * i + 2 + n, [square(x + 50 - f * s, y + 50 - f * s, 2 * f * s)]) for n, f in enumerate((1.0, 0.5)[: 1 + i % 2])]
        rows.append((k, None, 900 + k, [square(0.0, 0.0, 10.0)]))
    df = spark.createDataFrame(rows, "drawing_id int, layer string, id int, rings array<array<array<double>>>").localCheckpoint()

    def left():
        return sorted((r.drawing_id, r.id) for r in drw.drop_hole_fillers(df, 0.1).collect())

    few = left()
    assert len(few) < len(rows) and {(k, 900 + k) for k in range(4)} <= set(few) and {(k, 100 * k + 20) for k in range(4)} <= set(few)
    assert not [(k, n) for k, n in few if n < 900 and n % 100 in (2, 12)]
    monkeypatch.setattr(spatial, "FEW", 0)
    assert left() == few
    rings = shuffled(spark, drw.drop_hole_fillers(df.where("size(rings) < 2"), 0.1).select("drawing_id", "id"))
    assert rings < 60 * len(rows)


def test_estimates_of_long_runs_are_whole_numbers_of_64_bits(spark):
    """A run of years, as in the SQL: its first estimate is beyond 32 bits."""
    rows = spark.sql(
        """select 1L as run_id, id, timestamp_seconds(1577836800 + id * 200000000) as at, cast(if(id = 0, 0, 6) as int) as percent,
           timestamp_seconds(1577836800) as started_at from range(3)"""
    )
    got = {r.id: r.eta_sec_smoothed for r in jobs.ewma_eta(rows).collect()}
    assert got == {0: None, 1: round(200_000_000 * 94 / 6), 2: round(200_000_000 * 94 / 6)}
