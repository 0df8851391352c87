"""Work and memory of a task that must stay bounded as the tables grow."""

from pyspark.sql import functions as F

from cutledger.llm import fingerprints
from cutledger.operators import addresses
from cutledger.operators import drawings as drw
from cutledger.operators import layout as lay
from cutledger.operators import spatial


def test_tasks_read_small_parts_of_a_shuffle(spark):
    kept = {key: spark.conf.get(key) for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        rows = spark.range(400_000).select(F.sha2(F.col("id").cast("string"), 512).alias("k"))
        # some 30 MB compressed
        assert rows.groupBy("k").count().rdd.getNumPartitions() >= 3
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def _not_called(*args):
    raise AssertionError("small keys need no search")


def test_washers_of_small_keys_take_one_pass(spark, monkeypatch):
    circles = spark.range(600).selectExpr(
        "id", "id div 12 as drawing_id", "'CUT' as layer", "double(hash(id) % 3) * 0.6 as cx", "double(hash(id, 1) % 2) as cy", "double(abs(hash(id, 2)) % 9 * 10 + 5) as r"
    ).localCheckpoint()
    got = lambda df: sorted(map(tuple, drw.washers(df, 0.1).collect()))
    monkeypatch.setattr(drw, "WHOLE_CIRCLES", 5, raising=False)
    by_axis = got(circles)
    monkeypatch.undo()
    monkeypatch.setattr(drw, "connected", _not_called)
    assert got(circles) == by_axis
    # without a layer a circle has no partner, but stays a piece
    assert {r.outer_id for r in drw.washers(circles.withColumn("layer", F.lit(None).cast("string")), 0.1).collect()} == {None}


def test_parents_in_small_keys_come_from_one_join(spark, monkeypatch):
    box = "array(array(array(x, y), array(x + w, y), array(x + w, y + h), array(x, y + h)))"
    polys = spark.range(600).selectExpr(
        "id", "id div 12 as drawing_id", "'CUT' as layer", "double(abs(hash(id)) % 5 * 10) as x", "double(abs(hash(id, 1)) % 5 * 10) as y",
        "double(abs(hash(id, 2)) % 5 * 30 + 10) as w", "double(abs(hash(id, 3)) % 5 * 30 + 10) as h",
    ).selectExpr("id", "drawing_id", "layer", f"{box} as rings").localCheckpoint()
    got = lambda df: sorted(map(tuple, drw.containment_parent(df, 0.1).collect()), key=str)
    monkeypatch.setattr(spatial.by_crowding, "__defaults__", (5,))
    by_asking = got(polys)
    monkeypatch.undo()
    monkeypatch.setattr(spatial, "smallest_holders", _not_called)
    assert got(polys) == by_asking
    assert sum(p is not None for *_, p in by_asking) > 50
    assert got(polys.withColumn("layer", F.lit(None).cast("string"))) == sorted(((r.drawing_id, None, r.id, None) for r in polys.collect()), key=str)


def test_overlaps_of_small_sheets_come_from_one_join(spark, monkeypatch):
    rings = "array(array(array(0D, 0D), array(w, 0D), array(w, h), array(0D, h)))"
    placed = spark.range(400).selectExpr(
        "id div 10 as run_id", "0 as sheet_index", "cast(id % 10 as int) as piece_index", "double(abs(hash(id)) % 3 * 20) as x_mm", "double(abs(hash(id, 1)) % 3 * 20) as y_mm",
        "double(abs(hash(id, 2)) % 2 * 30 + 10) as w", "double(abs(hash(id, 3)) % 2 * 30 + 10) as h",
    ).selectExpr("*", f"{rings} as rings").localCheckpoint()
    pieces, outlines = (lambda f=f: sorted(map(tuple, f(placed).collect())) for f in (lay.overlapping_pieces, lay.overlapping_pairs))
    monkeypatch.setattr(spatial.by_crowding, "__defaults__", (3,))
    on_grid = pieces(), outlines()
    monkeypatch.undo()
    monkeypatch.setattr(lay, "self_pairs", _not_called)
    assert (pieces(), outlines()) == on_grid
    p = {(r.run_id, r.piece_index): r for r in placed.collect()}
    wanted = set()
    for (run, i), a in p.items():
        for (other, j), b in p.items():
            shared = [max(min(a[x] + a[s], b[x] + b[s]) - max(a[x], b[x]), 0.0) for x, s in (("x_mm", "w"), ("y_mm", "h"))]
            if run == other and i < j and shared[0] * shared[1] > 1:
                wanted.add((run, i, j))
    assert {(r[0], *r[2:4]) for r in on_grid[0]} == wanted


def test_pieces_of_projects_with_few_sheets_need_no_line(spark, monkeypatch):
    pieces = spark.range(500).selectExpr("id % 20 as project_id", "cast(id as int) as piece_index", "double(abs(hash(id)) % 9 * 10) as width_mm", "double(abs(hash(id, 1)) % 9 * 10) as height_mm").localCheckpoint()
    stocks = spark.range(60).selectExpr("id % 19 as project_id", "double(abs(hash(id)) % 7 * 10) as width_mm", "double(abs(hash(id, 1)) % 7 * 10) as height_mm").localCheckpoint()
    got = lambda: sorted(map(tuple, lay.fits(pieces, stocks, 1.0).collect()))
    monkeypatch.setattr(lay, "FEW_SHEETS", 2, raising=False)
    on_line = got()
    monkeypatch.undo()
    monkeypatch.setattr(lay, "running", _not_called)
    assert got() == on_line and len({f for *_, f in on_line}) == 2


def test_fingerprints_shuffle_texts_once(spark):
    from test_round3 import shuffled

    words = F.concat_ws("", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 512) for i in range(40)])
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), words.alias("text")).localCheckpoint()
    once = shuffled(spark, docs.repartition(7, "doc_id"))
    assert once > 2_000_000
    assert shuffled(spark, fingerprints.fingerprint_documents(docs, blocks=5)) < 1.6 * once


def test_addresses_are_read_from_their_text_once(spark):
    df = spark.createDataFrame([(1, "203.0.113.9"), (2, "bad")], "id long, ip string")
    out = addresses.country_for_address(df, spark.createDataFrame([("203.0.113.0/24", "CR")], "network string, country_code string"))
    assert "trim(ip#" not in out._jdf.queryExecution().analyzed().toString()
    assert {r.id: r.ip_country for r in out.collect()} == {1: "CR", 2: None}
