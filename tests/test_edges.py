"""Literal edge tables: boundaries, NULLs, ties, and operators checked against brute force."""

import datetime as dt
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutledger.functions import geometry as geo
from cutledger.functions.clock import plan_end
from cutledger.functions.vectorised import principal_angle, shared_area, snap_angle, straight_share
from cutledger.operators import billing as bill
from cutledger.operators import drawings as drw
from cutledger.operators import events as ev
from cutledger.operators import inventory as inv
from cutledger.operators import jobs
from cutledger.operators import layout as lay
from cutledger.operators import payments as pay
from cutledger.operators.scan import Running, running
from cutledger.sources import documents as docs

UTC = dt.timezone.utc


def at(text):
    return dt.datetime.fromisoformat(text)


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_running_equals_plain_window_on_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 20), rng.randrange(5000), i, rng.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, t int, id int, v int")
    out = running(
        df, ["k"], [F.col("t"), F.col("id")], [F.floor(F.col("t") / 50), F.floor(F.col("t") / 1000)],
        [
            Running("s", "sum", F.col("v")), Running("s0", "sum", F.col("v"), False), Running("m", "max", F.col("v"), False),
            Running("n", "min", F.col("v")), Running("l", "last", F.when(F.col("v") > 50, F.col("v"))),
        ],
    ).collect()
    seen = {}
    for r in sorted(out, key=lambda r: (r.k, r.t, r.id)):
        past = seen.setdefault(r.k, [])
        assert r.s0 == sum(past) and r.m == (max(past) if past else None)
        past.append(r.v)
        assert r.s == sum(past) and r.n == min(past)
        high = [v for v in past if v > 50]
        assert r.l == (high[-1] if high else None)


def test_local_day_bounds(spark):
    df = spark.createDataFrame(
        [(1, at("2026-05-01 05:59:59")), (2, at("2026-05-01 06:00:00")), (3, at("2026-05-02 05:59:59")), (4, at("2026-05-02 06:00:00"))],
        "id int, created_at timestamp",
    )
    assert ids(pay.in_local_days(df, "2026-05-01", "2026-05-01")) == [2, 3]
    assert ids(pay.in_local_days(df, "", "nonsense")) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        pay.in_local_days(df, None, None, "updated_at")


def test_period_bounds():
    now = dt.datetime(2026, 3, 1, 3, tzinfo=UTC)  # still February in Costa Rica
    assert pay.period_bounds({}, now) == ("2026-02-01", "2026-02-28")
    assert pay.period_bounds({"start_date": "", "end_date": "2026-01-05"}, now) == (None, "2026-01-05")


@pytest.mark.parametrize("term,found", [("50%", [1]), ("a_b", [2]), ("c\\d", [3]), ("  ", [1, 2, 3]), ("A_B", [2])])
def test_search_is_literal(spark, term, found):
    df = spark.createDataFrame([(1, "50% off"), (2, "a_b"), (3, "c\\d axb")], "id int, purchaser_name string")
    assert ids(pay.search(df, term, ["purchaser_name"])) == found


def test_retention_boundaries(spark):
    df = spark.createDataFrame(
        [(1, "single_purchase", at("2026-01-01 00:00:00")), (2, "single_purchase", None), (3, "plan_included", at("2027-01-01 00:00:00"))],
        "id int, kind string, retained_until timestamp",
    )
    assert ids(bill.retention_active(df, "2026-01-01")) == [1]
    assert ids(bill.retained_active(df, "2026-01-01")) == []
    assert ids(bill.purge_list(df, "2026-01-01")) == []


def test_net_and_declared_total_differ_for_negative_totals(spark):
    df = spark.sql(
        """select id, 'succeeded' as status, 'crc' as currency, cast(t as decimal(12,2)) as total_amount,
           cast(100 as decimal(12,2)) as amount, cast(0 as decimal(12,2)) as list_price, cast(0 as decimal(12,2)) as discount_amount,
           cast(null as decimal(12,2)) as subtotal, cast(0 as decimal(12,2)) as tax_amount
           from values (1, 0), (2, null), (3, -5), (4, 7) as v(id, t)"""
    )
    net = {r.id: float(r.n) for r in df.select("id", pay.net_collected().alias("n")).collect()}
    assert net == {1: 100, 2: 100, 3: 100, 4: 7}
    row = pay.declaration_totals(df).first()
    assert (row.n, float(row.total), float(row.subtotal)) == (4, 100 + 100 - 5 + 7, 0)


def test_plan_end(spark):
    rows = [
        (1, at("2026-05-22 07:58:00"), 2, "America/Costa_Rica"), (2, at("2026-01-31 12:00:00"), 1, "UTC"),
        (3, at("2024-01-31 12:00:00"), 1, "UTC"), (4, at("2026-02-15 12:00:00"), 1, "America/New_York"),
    ]
    df = spark.createDataFrame(rows, "id int, s timestamp, n int, tz string")
    got = {r.id: r.e for r in df.select("id", F.date_format(plan_end(F.col("s"), F.col("n"), F.col("tz")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("e")).collect()}
    assert got == {
        1: "2026-07-23 05:59:59.999999", 2: "2026-02-28 23:59:59.999999",
        3: "2024-02-29 23:59:59.999999", 4: "2026-03-16 03:59:59.999999",
    }


def test_gap_class(spark):
    df = spark.createDataFrame([(2.0,), (2.0001,), (15.0,), (15.0001,)], "d double")
    got = [r.c for r in df.orderBy("d").select(inv.gap_class(F.col("d")).alias("c")).collect()]
    assert got == ["silent", "consent", "consent", "ignored"]


def test_superseded_at_the_same_instant(spark):
    t = at("2026-01-01 10:00:00")
    df = spark.createDataFrame(
        [(1, 7, 3, "pending", "single_download", t), (2, 7, 3, "succeeded", "single_download", t), (3, 7, None, "pending", "single_download", t)],
        "id int, user_id int, nesting_run_id int, status string, purpose string, created_at timestamp",
    )
    assert not any(r.superseded_later for r in pay.superseded_by_later(df).collect())
    assert {r.id for r in pay.superseded_for_lock(df).collect() if r.superseded_lock} == {1, 2}


EVENT = (
    "id int, event_type string, user_id int, anonymous_session_key string, tab_id string, project_id int, ip string,"
    " user_agent string, country_code string, locale string, occurred_at timestamp"
)


def test_event_context(spark):
    def event(i, kind, project, when):
        return (i, kind, i, f"s{i}", None, project, None, None, None, None, at(when))

    events = spark.createDataFrame(
        [
            event(1, "nest_completed", 1, "2026-01-01 10:00:00"), event(2, "user_logged_in", 1, "2026-01-01 10:00:05"),
            event(3, "workspace_started", 2, "2026-01-01 10:00:08"), event(4, "user_logged_in", 2, "2026-01-01 10:00:09"),
            event(5, "workspace_started", 3, "2026-01-01 11:00:00"),
        ],
        EVENT,
    )
    runs = spark.createDataFrame(
        [(p, p, at("2026-01-01 09:59:00"), at("2026-01-01 10:00:05"), at("2026-01-01 10:00:10")) for p in (1, 2, 3, 4)],
        "id int, project_id int, created_at timestamp, started_at timestamp, finished_at timestamp",
    )
    got = {r.run_id: (r.event_id, r.locale) for r in ev.event_context(runs, events, "2026-02-01").collect()}
    # exactly at the start; fallback to the workshop event; only later events; none at all
    assert got == {1: (2, "es"), 2: (3, "es"), 3: (None, "es"), 4: (None, "es")}


def test_stale_rows_take_null_keys(spark):
    now = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, k int")
    assert ids(inv.stale_rows(now, spark.createDataFrame([(10,), (None,)], "k int"), ["k"])) == [2, 3]


def test_country_for_ip(spark):
    def number(ip):
        a, b, c, d = map(int, ip.split("."))
        return ((a * 256 + b) * 256 + c) * 256 + d

    ranges = spark.createDataFrame(
        [(number("1.0.0.0"), number("1.3.255.255"), "CR"), (number("1.5.0.0"), number("1.5.0.9"), "US"), (number("10.0.0.0"), number("10.255.255.255"), "XX")],
        "ip_from bigint, ip_to bigint, country_code string",
    )
    cases = {
        "1.0.0.0": "CR", "1.3.255.255": "CR", "1.4.0.0": None, "1.5.0.9": "US", "1.5.0.10": None, "0.9.9.9": None,
        "10.1.1.1": None, "127.0.0.1": None, "172.16.0.1": None, "192.168.1.1": None, "300.1.1.1": None, "abc": None, " 1.2.3.4 ": "CR",
    }
    df = spark.createDataFrame([(k,) for k in cases], "ip string")
    assert {r.ip: r.ip_country for r in bill.country_for_ip(df, ranges).collect()} == cases


def test_consumption_rank(spark):
    df = spark.createDataFrame([(1, 1, None, 0), (2, 1, 5, 1), (3, 1, 2, 1), (4, 1, 1, 0)], "id int, project_id int, quantity int, sort_order int")
    got = {r.id: r.consumption_rank for r in inv.consumption_rank(df).collect()}
    assert got == {4: 0, 2: 1, 3: 2, 1: 3}


def test_dedup_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id int, idempotency_key string")
    assert ids(ev.dedup_events(df)) == [1, 3, 4]


def _progress(spark, rows):
    return spark.createDataFrame(
        [(r, i, dt.datetime.fromtimestamp(1_700_000_000 + t, UTC).replace(tzinfo=None), p) for i, (r, t, p) in enumerate(rows)],
        "run_id int, id int, at timestamp, percent int",
    )


def test_monotonic_progress(spark):
    df = _progress(spark, [(1, i, p) for i, p in enumerate([10, 30, 20, 30, 40])])
    assert [r.percent for r in jobs.monotonic_progress(df).orderBy("id").collect()] == [10, 30, 30, 40]


def test_throttle_and_ewma_against_a_plain_loop(spark):
    rng = random.Random(3)
    rows = []
    for run in range(4):
        t, p = 0.0, 0
        for _ in range(400):
            t += rng.choice([0.1, 0.2, 0.3, 0.9, 1.0, 2.5, 700.0 if rng.random() < 0.02 else 0.4])
            p = max(0, min(100, p + rng.choice([0, 0, 0, 0, 1, -3, 2])))
            rows.append((run, round(t, 1), p))
    df = _progress(spark, rows)
    want, state, smooth, start, due = set(), {}, {}, {}, {}
    want_eta = {}
    for i, (run, t, p) in enumerate(rows):
        last = state.get(run)
        p2 = p if last is None else max(p, last[1])
        if last is None or round(t - last[0], 6) >= 1 or p2 > last[1]:
            want.add((i, p2))
            state[run] = (t, p2)
        start.setdefault(run, t)
        if p > 0:
            smooth[run] = float(p) if run not in smooth else 0.3 * p + 0.7 * smooth[run]
            s, el = smooth[run], t - start[run]
            guess = 0 if s >= 99.9 else (max(0, round(el * (100 - s) / s)) if el >= 3 and s >= 5 else None)
            if guess is not None:
                due[run] = guess if run not in due else min(due[run], guess)
        want_eta[i] = (smooth.get(run) if p > 0 else None, due.get(run))
    assert {(r.id, r.percent) for r in jobs.throttle_progress(df).collect()} == want
    begun = df.join(df.groupBy("run_id").agg(F.min("at").alias("started_at")), "run_id")
    for r in jobs.ewma_eta(begun).collect():
        s, eta = want_eta[r.id]
        assert (r.smoothed is None) == (s is None) and (s is None or abs(r.smoothed - s) < 1e-9)
        assert r.eta_sec_smoothed == eta


def test_subscription_fold(spark):
    users = spark.createDataFrame([(1, "UTC"), (2, "UTC")], "id bigint, time_zone string")
    end = at("2026-02-28 23:59:59.999999")
    buys = spark.createDataFrame(
        [
            (1, 1, at("2026-01-31 10:00:00"), 1), (1, 2, end, 4), (2, 3, at("2026-01-31 10:00:00"), 1),
            (2, 4, end + dt.timedelta(microseconds=1), 2), (2, 5, at("2026-03-02 00:00:00"), 1), (2, 6, at("2026-03-03 00:00:00"), 1),
        ],
        "user_id bigint, id bigint, paid_at timestamp, tier_months int",
    )
    got = sorted((r.user_id, r.tier_months, str(r.ends_at), r.n_purchases) for r in bill.extend_subscriptions(buys, users).collect())
    assert got == [
        (1, 1, "2026-06-28 23:59:59.999999", 2), (2, 1, "2026-02-28 23:59:59.999999", 1), (2, 2, "2026-07-01 23:59:59.999999", 3),
    ]


def _boxes(spark, rows):
    return spark.createDataFrame(rows, "id int, drawing_id int, min_x double, min_y double, max_x double, max_y double")


def _brute_clusters(rows, pad=15.0):
    label = {r[0]: r[0] for r in rows}
    changed = True
    near = [
        (a[0], b[0]) for a in rows for b in rows
        if a[1] == b[1] and a[4] + 2 * pad >= b[2] and b[4] + 2 * pad >= a[2] and a[5] + 2 * pad >= b[3] and b[5] + 2 * pad >= a[3]
    ]
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("seed", [64, 2, 0])
def test_cluster_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(1, 0, 0.0, 0.0, 5.0, 5.0), (2, 0, 34.0, 0.0, 40.0, 5.0), (3, 0, 71.0, 0.0, 80.0, 5.0), (4, 0, 111.0, 0.0, 112.0, 1.0), (5, 0, 0.0, 0.0, 5.0, 5.0)]
    for i in range(10, 170):
        x, y = rng.uniform(-900, 900), rng.uniform(-900, 900)
        w, h = rng.choice([(rng.uniform(0, 60), rng.uniform(0, 60)), (rng.uniform(100, 400), 3.0), (0.0, 0.0)])
        rows.append((i, 1 + i % 2, x, y, x + w, y + h))
    got = {r.id: r.cluster_id for r in drw.cluster(_boxes(spark, rows)).collect()}
    assert got == _brute_clusters(rows)
    assert got[1] == got[2] == got[5] == 1 and got[3] == 3 and got[4] == 4


def test_best_layout_ties(spark):
    cols = ["sheet_count", "total_waste_mm2", "total_footprint_mm2", "max_layout_maxy", "total_free_strip_mm2", "min_min_y", "min_min_x"]
    base = [2, 10.0, 10.0, 10.0, 10.0, 10.0, 10.0]
    for i, _ in enumerate(cols):
        better = list(base)
        better[i] = better[i] + 1 if cols[i].startswith("total_free") else better[i] - 1
        df = spark.createDataFrame([(1, 1, *base), (1, 2, *better)], "job_id int, run_id int, sheet_count int, " + ", ".join(f"{c} double" for c in cols[1:]))
        assert lay.best_layout(df).first().run_id == 2


def test_split_grid_limits(spark):
    stocks = spark.createDataFrame([(1, 1, 100.0, 100.0, 1, 0)], "id bigint, project_id int, width_mm double, height_mm double, quantity int, sort_order int")
    pieces = spark.createDataFrame(
        [(1, 0, 0.0, 0.0, 200.0, 80.0), (1, 1, 5.0, 5.0, 100.0, 100.0), (1, 2, 0.0, 0.0, 3200.0, 100.0), (1, 3, 0.0, 0.0, 3201.0, 100.0)],
        "project_id int, piece_index int, min_x double, min_y double, width_mm double, height_mm double",
    )
    rows = lay.split_grid(pieces, stocks, 0.0).collect()
    n = {i: [r for r in rows if r.piece_index == i] for i in range(4)}
    assert [len(n[i]) for i in range(4)] == [2, 1, 32, 33] and all(r.feasible for r in rows)
    capped = lay.split_grid(pieces, stocks, 0.0, max_children=32).where("piece_index = 3").collect()
    assert len(capped) == 33 and {r.reason for r in capped} == {"split_not_feasible"} and {r.label for r in n[0]} == {"a", "b"}
    assert abs(sum((r.x1 - r.x0) * (r.y1 - r.y0) for r in n[2]) - 320_000) < 1e-6


def _ffd(pieces, stocks, margin):
    out = {}
    for project in {p[0] for p in pieces}:
        bins = []
        for s in sorted((s for s in stocks if s[1] == project), key=lambda s: (s[4] is None, s[5], s[0])):
            w, h = max(0, s[2] - 2 * margin), max(0, s[3] - 2 * margin)
            bins += [[s[0], k + 1, w, h, w * h] for k in range(300 if s[4] is None else s[4])]
        for p in sorted((p for p in pieces if p[0] == project), key=lambda p: (-p[4], p[1])):
            for b in bins:
                if ((p[2] <= b[2] and p[3] <= b[3]) or (p[3] <= b[2] and p[2] <= b[3])) and b[4] >= p[4]:
                    b[4] -= p[4]
                    out[p[0], p[1]] = (b[0], b[1], True)
                    break
            else:
                out[p[0], p[1]] = (bins[-1][0] if bins else None, -1, False)
    return out


def test_ffd_against_a_plain_loop(spark):
    rng = random.Random(5)
    stocks = [(1, 1, 300.0, 200.0, 2, 1), (2, 1, 400.0, 400.0, 3, 0), (3, 1, 250.0, 250.0, None, 2), (4, 2, 100.0, 500.0, 1, 0)]
    pieces = []
    for project in (1, 2, 3):
        for i in range(120):
            w, h = float(rng.randrange(10, 420)), float(rng.randrange(10, 300))
            pieces.append((project, i, w, h, w * h))
    p = spark.createDataFrame(pieces, "project_id bigint, piece_index int, width_mm double, height_mm double, area_mm2 double")
    s = spark.createDataFrame(stocks, "id bigint, project_id bigint, width_mm double, height_mm double, quantity int, sort_order int")
    got = {(r.project_id, r.piece_index): (r.stock_id, r.copy_no, r.placed) for r in lay.ffd_assign(p, s, 5.0).collect()}
    assert got == _ffd(pieces, stocks, 5.0)


def test_supersede_leaves_only_the_newest_open(spark):
    rows = [(i, 1, 1, "pending", "single_download", "sinpe_crc", at("2026-01-01") + dt.timedelta(minutes=i), None) for i in range(12)]
    schema = "id int, user_id int, nesting_run_id int, status string, purpose string, payment_method string, created_at timestamp, superseded_at timestamp"
    assert ids(pay.supersede(spark.createDataFrame(rows, schema))) == list(range(11))


def test_largest_bin_looks_at_all_stocks(spark):
    rows = [(i, 1, 100.0 + i, 300.0 - i, 1, i) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, project_id int, width_mm double, height_mm double, quantity int, sort_order int")
    assert tuple(lay.largest_bin(df, 0.0).select("max_w", "max_h").first()) == (139.0, 300.0)


def test_guest_carts_of_one_user(spark):
    carts = spark.createDataFrame([(1, None, "b"), (2, None, "a"), (3, None, "c"), (4, 8, None), (5, None, "d"), (6, None, "e")], "id int, user_id int, guest_token string")
    logins = spark.createDataFrame([("a", 7, at("2026-01-02")), ("b", 7, at("2026-01-01")), ("c", 8, at("2026-01-01")), ("d", 9, None)], "guest_token string, user_id int, logged_in_at timestamp")
    assert {(r.id, r.user_id) for r in bill.merge_carts(carts, logins).collect()} == {(1, 7), (4, 8), (5, 9), (6, None)}
    assert {(r.id, r.reason) for r in bill.lost_carts(carts, logins).collect()} == {(2, "later_login"), (3, "user_has_cart")}


@pytest.mark.parametrize("alpha", [0.01, 0.3, 0.97, 0.999999, 1.0])
def test_exponential_mean_of_any_alpha(spark, alpha):
    rng = random.Random(1)
    rows = [(run, i, at("2026-01-01") + dt.timedelta(seconds=i * 37), rng.randrange(0, 101), None, at("2026-01-01")) for run in (1, 2) for i in range(400)]
    df = spark.createDataFrame(rows, "run_id bigint, id bigint, at timestamp, percent int, eta_sec int, started_at timestamp")
    got = {(r.run_id, r.id): r.smoothed for r in jobs.ewma_eta(df, alpha).collect()}
    for run in (1, 2):
        mean = None
        for r in (r for r in rows if r[0] == run):
            if r[3] > 0:
                mean = float(r[3]) if mean is None else alpha * r[3] + (1 - alpha) * mean
                assert abs(got[run, r[1]] - mean) < 1e-7


def test_layer_hue(spark):
    names = ["CORTE", "grabado", "ñandú"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", geo.layer_hue(F.col("n")).alias("h"))
    assert {r.n: r.h for r in df.collect()} == {n: zlib.crc32(n.encode()) % 360 for n in names}


def test_plain_geometry_helpers():
    square = [[0, 0], [4, 0], [4, 4], [0, 4]]
    notch = [[0, 0], [4, 0], [4, 4], [2, 1], [0, 4]]
    assert abs(shared_area(square, [[2, 2], [6, 2], [6, 6], [2, 6]]) - 4) < 1e-9
    assert abs(shared_area(notch, square) - 10) < 1e-9 and abs(shared_area(square, notch[::-1]) - 10) < 1e-9
    assert shared_area(square, [[9, 9], [10, 9], [10, 10]]) == 0
    assert principal_angle([[0, 0], [1, 1], [2, 2]]) is None
    assert abs(principal_angle([[0, 0], [3, 3], [2, 4], [-1, 1]]) - 45) < 1e-9
    assert straight_share(square, 0.0) == 1.0 and snap_angle(89.5) == 90.0 and snap_angle(179.6) == 0.0 and snap_angle(30.0) == 30.0


def test_report_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"status": "partial", "orphans": [{"piece_index": 3, "reason": "x"}], "warnings": []}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    got = {r.path[-6:]: (r.status, None if r.orphans is None else len(r.orphans)) for r in docs.read_reports(spark, str(tmp_path)).collect()}
    assert got == {"a.json": ("partial", 1), "b.json": (None, None)}


def test_upload_checks(spark, tmp_path):
    (tmp_path / "ok.DXF").write_bytes(b"0\nSECTION\n" + b"x" * 2000)
    (tmp_path / "late.dxf").write_bytes(b"x" * 1024 + b"SECTION")
    (tmp_path / "plain.txt").write_bytes(b"0 SECTION")
    got = {r.path.rsplit("/", 1)[1]: r.errors for r in docs.validate_uploads(docs.read_uploads(spark, str(tmp_path))).collect()}
    assert got == {"ok.DXF": [], "late.dxf": ["corrupt_dxf"], "plain.txt": ["invalid_extension"]}


def test_overlaps_of_stacked_copies(spark):
    ring = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]]
    rows = [(1, 0, i, ring, 0.0, 0.0) for i in range(3)] + [(1, 0, 3, ring, 5.0, 5.0), (1, 1, 4, ring, 0.0, 0.0)]
    schema = "run_id int, sheet_index int, piece_index int, rings array<array<array<double>>>, x_mm double, y_mm double"
    got = {(r.a_index, r.b_index, r.a_copies, r.b_copies, r.shared_mm2) for r in lay.overlapping_pairs(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(0, 0, 3, 3, 100.0), (0, 3, 3, 1, 25.0)}


def test_length_inside_a_slanted_hole(spark):
    rings = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]], [[5.0, 2.0], [8.0, 5.0], [5.0, 8.0], [2.0, 5.0]]]
    df = spark.createDataFrame([(rings,)], T.StructType([T.StructField("rings", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))]))
    seg = F.array(F.array(F.lit(-1.0), F.lit(5.0)), F.array(F.lit(11.0), F.lit(5.0)))
    assert abs(df.select(geo.length_inside(seg, F.col("rings")).alias("n")).first().n - 4.0) < 1e-9


def _drawing(spark, outlines):
    rows = [(1, "L", i, [ring]) for i, ring in enumerate(outlines)]
    schema = "drawing_id int, layer string, id int, rings array<array<array<double>>>"
    return {r.id: r.parent_id for r in drw.containment_parent(spark.createDataFrame(rows, schema), 0.1).collect()}


def test_containment_in_concave_outlines(spark):
    box = lambda x0, y0, x1, y1: [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]
    u = [[0.0, 0.0], [100.0, 0.0], [100.0, 100.0], [70.0, 100.0], [70.0, 30.0], [30.0, 30.0], [30.0, 100.0], [0.0, 100.0]]
    got = _drawing(spark, [u, box(10.0, 60.0, 90.0, 70.0), box(5.0, 60.0, 25.0, 70.0), box(10.0, 5.0, 90.0, 25.0), box(40.0, 60.0, 60.0, 70.0)])
    assert got == {0: None, 1: None, 2: 0, 3: 0, 4: 1}
    ell = [[0.0, 0.0], [100.0, 0.0], [100.0, 20.0], [20.0, 20.0], [20.0, 100.0], [0.0, 100.0]]
    assert _drawing(spark, [ell, [[5.0, 90.0], [90.0, 5.0], [92.0, 7.0], [7.0, 92.0]], box(2.0, 2.0, 90.0, 18.0)]) == {0: None, 1: None, 2: 0}


def test_overlapping_pieces_with_stacked_copies(spark):
    ring = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]]
    rows = [(1, 0, i, ring, 0.0, 0.0) for i in range(3)] + [(1, 0, 3, ring, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "run_id int, sheet_index int, piece_index int, rings array<array<array<double>>>, x_mm double, y_mm double")
    assert {(r.a_piece, r.b_piece) for r in lay.overlapping_pieces(df).collect()} == {(a, b) for a in range(4) for b in range(a + 1, 4)}
    assert {(r.shape_index, r.piece_index) for r in lay.outline_members(df).collect()} == {(0, 0), (0, 1), (0, 2), (3, 3)}


def test_a_huge_box_takes_few_cells(spark):
    from cutledger.operators import spatial

    box = "named_struct('min_x', 0D, 'min_y', 0D, 'max_x', 1e6D, 'max_y', 1e6D)"
    df = spark.range(1).selectExpr("1 as k", "id", f"{box} as box").withColumn("level", spatial.size_class(spatial.longest_side(F.col("box"))))
    assert spatial.into_cells(df).count() <= 4
    points = spark.createDataFrame([(1, 7, 5e5, 9e5), (1, 8, 2e6, 0.0)], "k int, id int, x double, y double")
    assert [(r.point_id, r.box_id) for r in spatial.points_in_boxes(points, df, ["k"]).collect()] == [(7, 0)]
