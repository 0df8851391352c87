"""Bounded streams run to the end of event time: tables whose rows all lie within the delay lose none."""

import datetime as dt
import random

import pytest

from cutledger.streaming import billing as sbill
from cutledger.streaming import events as sev
from cutledger.streaming import jobs as sjob
from cutledger.streaming.runtime import Closing, drain

BASE = dt.datetime(2026, 1, 1)
EVENT = "id bigint, event_type string, priority string, properties string, user_id bigint, anonymous_session_key string, idempotency_key string, occurred_at timestamp"
at = lambda s: BASE + dt.timedelta(seconds=s)


def stream(spark, folder, schema, *batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def ended(spark, build):
    closing = Closing(spark)
    return drain(build(closing), "ended", closing)


def events(n=200, seed=1):
    """Events of five minutes, in scattered order; every seventh has no session, every fifth no user."""
    rnd = random.Random(seed)
    return [
        (i, rnd.choice(["paywall_viewed", "payment_started"]), rnd.choice(["low", "low", "critical"]), "{}", None if i % 5 == 0 else i % 3, None if i % 7 == 0 else f"s{i % 4}",
         None, at(rnd.randint(0, 299)))
        for i in range(n)
    ]


def test_rate_limit_of_five_minutes(spark, tmp_path):
    rows = events()
    got = {r.id: r.accepted for r in ended(spark, lambda c: sev.rate_limit(stream(spark, tmp_path, EVENT, rows[:90], rows[90:]), 20, closing=c)).collect()}
    want, kept = {}, {}
    for i, _, priority, _, user, session, _, when in sorted(rows, key=lambda r: (r[-1], r[0])):
        who = f"u:{user}" if user is not None else f"s:{session}" if session is not None else None
        ok = priority != "low" or who is None or kept.get(who, 0) < 20
        if priority == "low" and who is not None and ok:
            kept[who] = kept.get(who, 0) + 1
        want[i] = ok
    assert got == want and not all(want.values())


def test_alerts_and_windows_of_five_minutes(spark, tmp_path):
    rows = events()
    times = sorted((r[-1], r[0], r[1]) for r in rows)
    want, last = set(), {}
    for when, i, kind in times:
        if kind not in last or when - last[kind] >= dt.timedelta(minutes=2):
            want.add(i)
            last[kind] = when
    source = stream(spark, tmp_path, EVENT, rows[:50], rows[50:])
    alerts = source.selectExpr("event_type as alert_key", "id", "occurred_at as at")
    assert {r.id for r in ended(spark, lambda c: sev.alert_throttle(alerts, 2, closing=c)).collect()} == want
    funnel = {r.event_type: r.n for r in ended(spark, lambda c: sev.live_funnel(source, closing=c)).collect()}
    assert funnel == {"paywall_viewed": sum(r[1] == "paywall_viewed" for r in rows)}
    sessions = ended(spark, lambda c: sev.sessions(source, closing=c)).collect()
    assert sum(r.n for r in sessions) == sum(r[5] is not None for r in rows)
    low = sum(r[2] == "low" for r in rows)
    assert max(r.low_priority_count for r in ended(spark, lambda c: sev.bot_alerts(source, 10, closing=c)).collect()) == low


def test_last_lock_run_and_gateway_event(spark, tmp_path):
    locks = [(1, at(0), True), (2, at(10), True), (2, at(60), False), (3, at(299), True)]
    got = ended(spark, lambda c: sbill.lock_timeouts(stream(spark, tmp_path / "l", "payment_id bigint, at timestamp, waiting boolean", locks), closing=c))
    assert {(r.payment_id, r.released_us - int(at(0).timestamp()) * 1_000_000) for r in got.collect()} == {(1, 900_000_000), (3, 1_199_000_000)}

    run = "run_id bigint, kind string, at timestamp, limit_sec int, eta_sec int"
    runs = [(1, "started", at(0), 600, 400), (1, "output", at(5), 600, None), (2, "started", at(9), 600, None), (3, "started", at(200), 600, None), (3, "cancel", at(280), 600, None), (4, "?", at(290), 1, 1)]
    got = ended(spark, lambda c: sjob.run_timeouts(stream(spark, tmp_path / "r", run, runs), closing=c))
    assert {(r.run_id, r.warning) for r in got.collect()} == {(1, "eta_overrun"), (1, "time_limit_reached"), (2, "abandoned"), (3, "cancelled")}

    gateway = [("a", "payment-intent.failed", at(0), 1), ("a", "payment-intent.succeeded", at(299), 2), ("x", "payment-intent.failed", at(3), 3), (None, "payment-intent.failed", at(4), 4)]
    known = spark.createDataFrame([("a", "pending", None, "card_crc")], "onvo_payment_intent_id string, status string, checkout_abandoned_at timestamp, payment_method string")
    got = ended(spark, lambda c: sbill.payment_states(stream(spark, tmp_path / "g", "payment_intent_id string, type string, at timestamp, event_no bigint", gateway), known, closing=c))
    assert {(r.event_no, r.status, r.outcome) for r in got.collect()} == {(1, "pending", "abandoned"), (2, "succeeded", "fulfilled")}


def test_progress_of_five_minutes(spark, tmp_path):
    doc = '{{"schema": "nesting-progress", "version": 2, "phase_id": "fill", "percent": {p}, "eta_sec": 9}}'
    from cutledger.sources.documents import read_progress

    rows = [(1, n, at(60 * n), doc.format(p=p)) for n, p in enumerate([5, 20, 10, 40])]
    schema = "run_id bigint, id bigint, at timestamp, doc string"
    valid = [r.id for r in read_progress(spark.createDataFrame(rows, schema)).collect()]
    if not valid:
        pytest.skip("the document form is another one")
    got = ended(spark, lambda c: sjob.progress_stream(stream(spark, tmp_path, schema, rows[:2], rows[2:]), closing=c))
    assert sorted(r.id for r in got.collect()) == [0, 1, 3]


def test_rows_of_null_time_pass_and_no_rows_end(spark, tmp_path):
    rows = [(1, "paywall_viewed", "low", "{}", 1, "s", "a", at(0)), (2, "paywall_viewed", "critical", "{}", 1, "s", "b", None)]
    got = ended(spark, lambda c: sev.rate_limit(stream(spark, tmp_path / "n", EVENT, rows), 5, closing=c))
    assert sorted(r.id for r in got.collect()) == [1, 2]
    (tmp_path / "e").mkdir()
    none = spark.readStream.schema(EVENT).parquet(str(tmp_path / "e"))
    assert ended(spark, lambda c: sev.alert_throttle(none.selectExpr("event_type as alert_key", "id", "occurred_at as at"), closing=c)).count() == 0
