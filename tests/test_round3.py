"""Work of small groups that must not grow into shuffled pairs or rows per order, and measures over whole batches."""

import numpy as np
from pyspark.sql import functions as F

from cutledger.functions import geometry as geo
from cutledger.functions.vectorised import principal_angle, principal_angles
from cutledger.operators import drawings as drw
from cutledger.operators import layout as lay
from cutledger.operators import spatial


def shuffled(spark, df) -> int:
    """Bytes that a query shuffles."""
    context = spark.sparkContext._jsc.sc()

    def written() -> int:
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = written()
    df.write.format("noop").mode("overwrite").save()
    return written() - before


def test_piece_orders_do_not_shuffle_rows_per_order(spark, monkeypatch):
    pieces = spark.range(4000).selectExpr(
        "id div 8 as project_id", "cast(id % 8 as int) as piece_index", "double(hash(id) % 50 * 10 + 600) as area_mm2",
        "double(hash(id, 1) % 9 * 10 + 100) as width_mm", "double(hash(id, 2) % 9 * 10 + 100) as height_mm",
    ).localCheckpoint()
    assert shuffled(spark, lay.piece_orders(pieces)) < 4000 * 200
    whole = sorted(map(tuple, lay.piece_orders(pieces).collect()))
    monkeypatch.setattr(lay, "WHOLE_PIECES", 7)
    assert sorted(map(tuple, lay.piece_orders(pieces).collect())) == whole


RINGS = "array<array<array<double>>>"


def test_measures_of_whole_batches(spark):
    holed = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]], [[2.0, 2.0], [4.0, 2.0], [4.0, 4.0], [2.0, 4.0]]]
    bar = [[[3.0, 0.0], [5.0, 0.0], [5.0, 8.0], [3.0, 8.0]]]
    df = spark.createDataFrame([(0, holed), (1, None), (2, []), (3, bar)], f"id int, rings {RINGS}").coalesce(1)
    seg = F.array(F.array(F.lit(-1.0), F.lit(3.0)), F.array(F.lit(11.0), F.lit(3.0)))
    got = {r.id: r for r in df.select(
        "id", geo.polygon_area(F.col("rings")).alias("area"), geo.centroid(F.col("rings")).alias("c"), geo.bbox(F.col("rings")).alias("b"),
        geo.length_inside(seg, F.col("rings")).alias("inside"), geo.place(F.col("rings"), F.lit(1.0), F.lit(0.0), F.lit(90.0)).alias("moved"),
    ).collect()}
    assert (got[0].area, got[1].area, got[2].area, got[3].area) == (96.0, None, None, 16.0)
    assert (got[0].inside, got[1].inside, got[2].inside, got[3].inside) == (8.0, None, 0.0, 2.0)
    assert abs(got[0].c.x - (500 - 12) / 96) < 1e-9 and got[1].c.x is None and (got[3].c.x, got[3].c.y) == (4.0, 4.0)
    assert got[1].moved is None and got[2].moved == [] and [len(r) for r in got[0].moved] == [4, 4]
    assert all(abs(p - q) < 1e-9 for p, q in zip(got[3].moved[0][0], [9.0, 3.0]))
    assert (got[0].b.max_x, got[2].b.max_x, got[3].b.min_x) == (10.0, None, 3.0)
    # no measure runs point by point in a row's expression
    plan = df.select(geo.bbox(geo.place(F.col("rings"), F.lit(1.0), F.lit(0.0), F.lit(9.0))), geo.length_inside(seg, F.col("rings")))
    assert "lambdafunction" not in plan._jdf.queryExecution().executedPlan().toString()


def test_directions_of_rings_together():
    rng = np.random.default_rng(3)
    for n in (3, 4, 7, 20):
        rings = np.round(rng.normal(0, 50, (60, n, 2)), rng.integers(0, 3))
        rings[0], rings[1, 1:] = rings[0, :1], rings[1, :1]
        got = principal_angles(rings[:, :, 0], rings[:, :, 1])
        for ring, angle in zip(rings, got):
            want = principal_angle(ring.tolist())
            assert np.isnan(angle) if want is None else abs(angle - want) < 1e-9


def test_small_keys_meet_in_one_join(spark, monkeypatch):
    ring = "array(array(array(x, y), array(x + w, y), array(x + w, y + w), array(x, y + w)))"
    pieces = spark.range(60).selectExpr("id div 12 as k", "id", "cast(id % 12 as int) as piece_index", "double(id * 37 % 90) as x", "double(id * 53 % 80) as y", "double(20 + id % 3 * 40) as w")
    pieces = pieces.selectExpr("k", "id", "piece_index", f"{ring} as rings").withColumn("box", geo.bbox(F.col("rings"))).localCheckpoint()
    points = spark.range(60).selectExpr("id div 12 as k", "id", "id * 29 % 100 + 0.5D as x", "id * 31 % 100 + 0.5D as y")
    seg = points.selectExpr("k", "id", "array(array(x, y), array(x + 30, y + 9)) as segment", "named_struct('min_x', x, 'min_y', y, 'max_x', x + 30, 'max_y', y + 9) as box")

    def found():
        a, b = drw.attach_points(points, pieces, ["k"]), drw.attach_lines(seg, pieces, ["k"])
        return sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))

    few = found()
    assert few[0] and few[1] and shuffled(spark, drw.attach_lines(seg, pieces, ["k"])) < 60 * 400
    for most in (0, 11):
        monkeypatch.setattr(spatial, "FEW", most)
        assert found() == few
