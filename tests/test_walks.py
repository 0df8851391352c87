"""First fit by a tournament tree, and the exponential mean as a walk."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from cutledger.operators import jobs
from cutledger.operators import layout as lay


def test_first_fit_takes_the_first_sheet_with_room():
    for seed in range(30):
        rnd = random.Random(seed)
        copies = rnd.choice([3, 40, float("inf")])
        sheets, left = lay.Sheets(7, 100.0, 50.0, copies), []
        for _ in range(300):
            area = rnd.choice([1.0, 700.0, 2_500.0, 5_000.0, 5_000.5, rnd.uniform(0, 5_000)])
            want = next((k for k, x in enumerate(left) if x >= area), None)
            if want is None and len(left) < copies and area <= 5_000:
                left.append(5_000.0)
                want = len(left) - 1
            if want is not None:
                left[want] -= area
            assert sheets.take(area) == want


def test_many_sheets_stay_cheap():
    sheets, began = lay.Sheets(1, 10.0, 10.0, float("inf")), time.process_time()
    # every piece opens a sheet of its own; then small ones fill them from the first on
    for _ in range(100_000):
        sheets.take(60.0)
    assert [sheets.take(40.0) for _ in range(100_000)] == list(range(100_000)) and sheets.opened == 100_000
    assert time.process_time() - began < 20


def test_mean_of_a_long_run(spark):
    """One run of a hundred thousand hours, a row each, and one with all its rows in an hour; plan without lists of a run."""
    rnd = random.Random(3)
    start = dt.datetime(2020, 1, 1)
    from pyspark.sql import functions as F

    hourly = spark.range(100_000).selectExpr("1L as run_id", "id", "timestamp_seconds(1577836800 + id * 3600) as at", "cast(pmod(hash(id), 99) as int) as percent", "timestamp_seconds(1577836800) as started_at")
    dense = spark.createDataFrame(
        [(2, 1_000_000 + i, start + dt.timedelta(milliseconds=7 * i), rnd.choice([0, 0, 50, 99, 130]), start) for i in range(3_000)],
        "run_id long, id long, at timestamp, percent int, started_at timestamp",
    )
    rows = hourly.unionByName(dense)
    for alpha in (0.3, 0.01, 0.999, 1.0):
        out = jobs.ewma_eta(rows, alpha)
        got = {r.id: r.smoothed for r in out.select("id", "smoothed").collect()}
        mean = {}
        for r in sorted(rows.collect(), key=lambda r: (r.run_id, r.at, r.id)):
            if r.percent > 0:
                x = min(r.percent, 100)
                mean[r.run_id] = x if r.run_id not in mean else alpha * x + (1 - alpha) * mean[r.run_id]
                assert abs(got[r.id] - mean[r.run_id]) < 1e-9
            else:
                assert got[r.id] is None
    assert "collect_list" not in jobs.ewma_eta(rows)._jdf.queryExecution().toString()
    assert rows.where(F.col("run_id") == 1).count() == 100_000


def test_means_are_rounded_one_after_the_other(spark):
    rows = [(run, n, dt.datetime(2026, 1, 1, 0, 0, n % 60, n), (run * 37 + n * 61) % 100 + 1) for run in range(40) for n in range(90)]
    df = spark.createDataFrame(rows, "run_id bigint, id bigint, at timestamp, percent int").withColumn("started_at", F.lit(dt.datetime(2026, 1, 1)))
    got = {(r.run_id, r.id): r.smoothed for r in jobs.ewma_eta(df).collect()}
    for run in range(40):
        mean = None
        for _, n, _, percent in sorted((r for r in rows if r[0] == run), key=lambda r: (r[2], r[1])):
            mean = float(percent) if mean is None else percent * 3 / 10 + 0.7 * mean
            assert got[run, n] == mean
