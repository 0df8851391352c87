"""Streams over several small files: limits, time-outs, de-duplication across batches, late rows."""

import datetime as dt

from pyspark.sql import functions as F

from cutledger.streaming import events as sev
from cutledger.streaming.runtime import drain

BASE = dt.datetime(2026, 1, 1)
SCHEMA = "id bigint, event_type string, priority string, properties string, user_id bigint, anonymous_session_key string, idempotency_key string, occurred_at timestamp"


def _row(i, seconds, key=None, kind="paywall_viewed", user=1, priority="low"):
    return (i, kind, priority, "{}", user, "s", key, BASE + dt.timedelta(seconds=seconds))


def _stream(spark, folder, batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part{n}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_rate_limit_counts_accepted_events_only(spark, tmp_path):
    first = [_row(i, i) for i in range(150)]
    second = [_row(i, i) for i in range(150, 301)] + [_row(400, 3601), _row(500, 400, user=None, priority="critical"), _row(600, 90_000)]
    got = {r.id: r.accepted for r in drain(sev.rate_limit(_stream(spark, tmp_path, [first, second]), 300), "t").collect()}
    assert all(got[i] for i in range(300)) and not got[300] and got[400] and got[500] and 600 not in got


def test_ingest_across_batches(spark, tmp_path):
    batches = [
        [_row(1, 0, "a"), _row(2, 1, "a"), _row(3, 2), _row(4, 3, kind="nope"), _row(5, 4, kind="nest_completed")],
        [_row(6, 7200, "a"), _row(7, 7201, "b"), _row(8, 7202)],
        [_row(9, 60, "c"), _row(10, 7300, "d")],
    ]
    good, dead = sev.ingested(_stream(spark, tmp_path, batches), "10 minutes")
    assert sorted(r.id for r in good.collect() if r.id not in (1, 2)) == [3, 7, 8, 10]
    assert good.where("idempotency_key = 'a'").count() == 1
    assert {r.id: r.reject_reason.split(":")[0] for r in dead.collect()} == {4: "not registered", 5: "missing", 9: "late"}


def test_dedup_stream_keeps_null_keys(spark, tmp_path):
    rows = [[_row(1, 0, "a"), _row(2, 1)], [_row(3, 2, "a"), _row(4, 3)]]
    got = sorted(r.id for r in drain(sev.dedup_stream(_stream(spark, tmp_path, rows), "1 hour"), "d").collect())
    assert got == [1, 2, 4]


def test_dedup_stream_takes_the_lowest_id_of_a_batch(spark, tmp_path):
    rows = [_row(i, 400 - i, f"k{i % 200}", user=None if i % 2 else 1 << 60) for i in range(400)][::-1]
    source = _stream(spark, tmp_path, [rows, [_row(1_000, 3, "k5"), _row(1_001, 4, "k999")]])
    got = drain(sev.dedup_stream(source, "1 hour"), "d").collect()
    assert sorted(r.id for r in got) == [*range(200), 1_001]
    assert {r.id: r.user_id for r in got if r.id < 2} == {0: 1 << 60, 1: None}


def test_live_backfill_reads_the_first_login(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.createDataFrame([(1, None, "s1"), (2, None, "s2"), (3, 9, "s1")], "id bigint, user_id bigint, anonymous_session_key string").write.parquet(path)
    at = lambda h: BASE + dt.timedelta(hours=h)
    schema, source = "anonymous_session_key string, user_id bigint, logged_in_at timestamp", tmp_path / "logins"
    root = str(tmp_path / "work")
    source.mkdir()
    logins = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    read = lambda: {r.id: r.user_id for r in sev.identified(spark.read.parquet(path), root).collect()}
    sev.record_logins(logins, root)
    assert read() == {1: None, 2: None, 3: 9}
    for n, rows in enumerate([[("s1", 5, at(2)), ("s1", 6, at(3)), (" ", 1, at(0)), ("s2", None, at(0))], [("s1", 7, at(1))], [("s1", 4, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/part{n}")
        sev.record_logins(logins, root)
        assert read() == {1: (5, 7, 7)[n], 2: None, 3: 9}
    # a batch that is replayed gives the same folder
    spark.createDataFrame([("s1", 7, at(1))], schema).write.mode("overwrite").parquet(f"{root}/logins/batch_id=1")
    assert read() == {1: 7, 2: None, 3: 9}


def test_gateway_steps():
    from cutledger.streaming.billing import gateway_step

    assert gateway_step("pending", False, True, "payment-intent.failed") == ("pending", True, "abandoned")
    assert gateway_step("pending", True, True, "payment-intent.succeeded") == ("succeeded", False, "fulfilled")
    assert gateway_step("pending", False, False, "payment-intent.failed") == ("failed", False, "failed")
    assert gateway_step("failed", False, False, "payment-intent.failed")[2] == "already_terminal"
    assert gateway_step("succeeded", False, True, "payment-intent.succeeded")[2] == "already_fulfilled"
    assert gateway_step("pending", False, True, "other")[2] == "ignored"


def _scattered(n=2_000):
    """Rows of one key in scattered order, all within the first day."""
    return [_row(i, (i * 7919) % 40_000, user=1) for i in range(n)]


def test_keyed_streams_do_not_depend_on_chunks_or_batches(spark, tmp_path):
    rows, end = _scattered(), [_row(10_000, 200_000)]
    want_let, last = set(), None
    for r in sorted(rows, key=lambda r: (r[-1], r[0])):
        if last is None or r[-1] - last >= dt.timedelta(minutes=5):
            want_let.add(r[0])
            last = r[-1]
    want_ok, kept = set(), []
    for r in sorted(rows, key=lambda r: (r[-1], r[0])):
        kept = [t for t in kept if t >= r[-1] - dt.timedelta(hours=1)]
        if len(kept) < 50:
            kept.append(r[-1])
            want_ok.add(r[0])
    half = [rows[:1_000], rows[1_000:], end]
    for n, (chunk, batches) in enumerate([(100, [rows, end]), (10_000, [rows, end]), (700, half)]):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", chunk)
        alerts = _stream(spark, tmp_path / f"a{n}", batches).selectExpr("event_type as alert_key", "id", "occurred_at as at")
        assert {r.id for r in drain(sev.alert_throttle(alerts, delay="1 day"), "a").collect()} == want_let
        limited = drain(sev.rate_limit(_stream(spark, tmp_path / f"b{n}", batches), 50, "1 day"), "b").collect()
        assert {r.id for r in limited if r.accepted} == want_ok and len(limited) == len(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_lock_closed_in_a_chunk_before_its_opening(spark, tmp_path):
    from cutledger.streaming import billing as sbill

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    schema = "payment_id bigint, at timestamp, waiting boolean"
    at = lambda m: BASE + dt.timedelta(minutes=m)
    rows = [(1, at(10), False), (1, at(0), True), (2, at(20), False), (2, at(0), True), (3, at(300), True)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "locks"))
    got = drain(sbill.lock_timeouts(spark.readStream.schema(schema).parquet(str(tmp_path / "locks"))), "l").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert [(r.payment_id, r.reason) for r in got] == [(2, "timeout")]


def test_events_without_a_time(spark, tmp_path):
    rows = [_row(1, 0, "a"), (2, "paywall_viewed", "low", "{}", 1, "s", "b", None)]
    _, dead = sev.ingested(_stream(spark, tmp_path, [rows]))
    assert {r.id: r.reject_reason for r in dead.collect()} == {2: "missing: occurred_at"}


def test_first_login_wins_by_time(spark):
    from cutledger.operators import events as ev

    logins = spark.createDataFrame([("s", 1, BASE + dt.timedelta(hours=2)), ("s", 9, BASE), ("t", 4, None), ("t", 3, None)], "anonymous_session_key string, user_id bigint, logged_in_at timestamp")
    assert {tuple(r) for r in ev.first_logins(logins).collect()} == {("s", 9), ("t", 3)}
