"""Registered queries that run as streams over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutledger.plans.oracle import stamp
from cutledger.plans.registry import Registry
from cutledger.session import prepare, shared_path
from cutledger.sources import driver as src
from cutledger.streaming import billing as sbill
from cutledger.streaming import events as sev
from cutledger.streaming import jobs as sjob
from cutledger.streaming.runtime import Closing, drain, table_stream

R = Registry()


def _events(s, d):
    return src.shape_events(table_stream(prepare(s), d, "events"))


def _ended(s, build, label):
    """The output of a keyed or windowed stream over a whole table, run to the end of event time."""
    closing = Closing(prepare(s))
    return drain(build(closing), label, closing)


def _orders(s, d):
    return table_stream(prepare(s), d, "orders")


R.add(
    "t1_ingest",
    lambda s, d: sev.ingested(_events(s, d))[0].select("event_type", "priority").groupBy("event_type", "priority").agg(F.count("*").alias("n")),
    """SELECT event_type, priority, count(*) AS n FROM (SELECT event_type, priority, row_number() OVER (PARTITION BY
      coalesce('k' || idempotency_key, 'i' || id) ORDER BY id) AS rn, coalesce(idempotency_key, '') AS k FROM user_events
      WHERE event_type NOT IN ('first_dxf_uploaded', 'nest_completed')) WHERE rn = 1 GROUP BY 1, 2""",
)
R.add(
    "t1_dead_letter",
    lambda s, d: sev.ingested(_events(s, d))[1].groupBy("event_type", "reject_reason").agg(F.count("*").alias("n")),
    """SELECT event_type, CASE event_type WHEN 'first_dxf_uploaded' THEN 'missing: filename,byte_size'
      ELSE 'missing: duration_ms,pieces_count,sheets_used' END AS reject_reason, count(*) AS n FROM user_events
    WHERE event_type IN ('first_dxf_uploaded', 'nest_completed') GROUP BY ALL""",
)
R.add(
    "t2_dedup_stream",
    lambda s, d: drain(sev.dedup_stream(_events(s, d), "1 day").select("id", "idempotency_key"), "dedup"),
    """SELECT min(id) AS id, idempotency_key FROM user_events WHERE idempotency_key IS NOT NULL GROUP BY 2
    UNION ALL SELECT id, idempotency_key FROM user_events WHERE idempotency_key IS NULL""",
)
_LIMIT = 2
R.add(
    "t3_rate_limit",
    lambda s, d: _ended(s, lambda c: sev.rate_limit(_events(s, d), _LIMIT, closing=c), "limit").select("id", "principal", "accepted"),
    f"""WITH RECURSIVE low AS (SELECT id, coalesce('u:' || user_id, 's:' || anonymous_session_key) AS principal, epoch_us(occurred_at) AS t,
        row_number() OVER (PARTITION BY coalesce('u:' || user_id, 's:' || anonymous_session_key) ORDER BY occurred_at, id) AS n
        FROM user_events WHERE priority = 'low'),
    fold(principal, n, id, kept, ok) AS (SELECT principal, n, id, [t], true FROM low WHERE n = 1
      UNION ALL SELECT l.principal, l.n, l.id, CASE WHEN len(k) < {_LIMIT} THEN list_append(k, l.t) ELSE k END, len(k) < {_LIMIT}
      FROM (SELECT f.principal, l.n, l.id, l.t, [x FOR x IN f.kept IF x >= l.t - 3600000000] AS k FROM fold f
        JOIN low l ON l.principal = f.principal AND l.n = f.n + 1) l)
    SELECT f.id, f.principal, ok AS accepted FROM fold f
    UNION ALL SELECT id, coalesce('u:' || user_id, 's:' || anonymous_session_key), true FROM user_events WHERE priority <> 'low'""",
)
R.add(
    "t4_bot_alerts",
    lambda s, d: _ended(s, lambda c: sev.bot_alerts(_events(s, d), 8, closing=c), "bots"),
    f"""SELECT {stamp('w')} AS window_start, low_priority_count FROM (SELECT w, count(*) AS low_priority_count FROM (
      SELECT time_bucket(INTERVAL 5 MINUTE, occurred_at) - to_minutes(5 * k) AS w FROM user_events, unnest(range(12)) AS t(k)
      WHERE priority = 'low') GROUP BY 1) WHERE low_priority_count > 8""",
)
R.add(
    "t5_progress_stream",
    lambda s, d: _ended(
        s, lambda c: sjob.progress_stream(src.shape_progress(table_stream(prepare(s), d, "events")), keep_days=4000, closing=c), "progress"
    ).select("run_id", "id", "percent", "due_us"),
    """SELECT run_id, id, percent, min(epoch_us(t_at) + eta_sec * 1000000) OVER (PARTITION BY run_id ORDER BY t_at, id
      ROWS UNBOUNDED PRECEDING)::BIGINT AS due_us
    FROM (SELECT *, max(percent) OVER (PARTITION BY run_id ORDER BY t_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      AS top FROM valid_progress) WHERE top IS NULL OR percent >= top""",
)


def _lock_rows(s, d):
    """Transfer checkouts opening at the order date; some settle after 10 minutes, some after 20."""
    o = _orders(s, d).where("substr(o_orderpriority, 1, 1) in ('1', '2')")
    opened = "cast(o_orderdate as timestamp)"
    return o.selectExpr(
        "o_orderkey as payment_id",
        f"""explode(array(named_struct('at', {opened}, 'waiting', true),
            named_struct('at', {opened} + make_dt_interval(0, 0, if(o_orderstatus = 'F', 10, 20), 0), 'waiting', false))) as e""",
    ).select("payment_id", "e.at", "e.waiting")


R.add(
    "t6_lock_timeouts",
    lambda s, d: _ended(s, lambda c: sbill.lock_timeouts(_lock_rows(s, d), closing=c), "locks").select("payment_id", "reason", "released_us"),
    """SELECT o_orderkey AS payment_id, 'timeout' AS reason, epoch_us(o_orderdate + INTERVAL 15 MINUTE) AS released_us
    FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('1', '2') AND o_orderstatus <> 'F'""",
)


def _gateway(s, d):
    return table_stream(prepare(s), d, "lineitem").selectExpr(
        "concat('pi_', if(l_linenumber = 7, l_orderkey + 100000000, l_orderkey)) as payment_intent_id",
        """case l_returnflag when 'A' then 'payment-intent.succeeded' when 'R' then 'payment-intent.failed'
           else 'payment-intent.deferred' end as type""",
        "cast(l_shipdate as timestamp) as at",
        "l_orderkey * 1000000 + l_partkey * 8 + l_linenumber as event_no",
    )


_STEP = """CASE WHEN g.type = 'payment-intent.succeeded' THEN 'succeeded' WHEN g.type <> 'payment-intent.failed' OR f.abandoned
    THEN f.status WHEN card AND f.status <> 'succeeded' THEN 'pending' ELSE 'failed' END"""
_LEFT = """CASE WHEN g.type = 'payment-intent.succeeded' THEN CASE WHEN f.status = 'succeeded' THEN f.abandoned ELSE false END
    WHEN g.type <> 'payment-intent.failed' OR f.abandoned THEN f.abandoned WHEN card AND f.status <> 'succeeded' THEN true ELSE false END"""
R.add(
    "t7_payment_states",
    lambda s, d: _ended(
        s, lambda c: sbill.payment_states(_gateway(s, d), src.payments(s, d), keep_days=40000, closing=c), "gateway"
    ).select("payment_intent_id", "event_no", "status", "abandoned"),
    f"""WITH RECURSIVE g AS (SELECT e.*, p.status AS s0, p.checkout_abandoned_at IS NOT NULL AS a0, p.payment_method LIKE 'card%' AS card,
        row_number() OVER (PARTITION BY e.payment_intent_id ORDER BY t_at, event_no) AS n
        FROM gateway_events e JOIN payments p ON p.onvo_payment_intent_id = e.payment_intent_id),
    fold(payment_intent_id, n, event_no, status, abandoned) AS (
      SELECT payment_intent_id, 0::BIGINT, -1::BIGINT, s0, a0 FROM g WHERE n = 1
      UNION ALL SELECT g.payment_intent_id, g.n, g.event_no, {_STEP}, {_LEFT} FROM fold f JOIN g
        ON g.payment_intent_id = f.payment_intent_id AND g.n = f.n + 1)
    SELECT payment_intent_id, event_no, status, abandoned FROM fold WHERE n > 0""",
)
R.add(
    "t7_unmatched_webhooks",
    lambda s, d: drain(sbill.unmatched_webhooks(_gateway(s, d), src.payments(s, d)), "unmatched"),
    """SELECT payment_intent_id, event_no, 'payment not found' AS error FROM gateway_events WHERE payment_intent_id NOT IN
      (SELECT onvo_payment_intent_id FROM payments WHERE onvo_payment_intent_id IS NOT NULL)""",
)


def _run_rows(s, d):
    """Runs starting at the order date: failed ones give no output, open ones run into the limit."""
    at = "cast(o_orderdate as timestamp)"
    return _orders(s, d).selectExpr(
        "o_orderkey as run_id",
        f"""explode(array_compact(array(named_struct('kind', 'started', 'at', {at}),
          if(o_orderstatus = 'P', null, named_struct('kind', 'output', 'at', {at} + interval 30 seconds)),
          if(o_orderpriority like '1%', named_struct('kind', 'cancel', 'at', {at} + interval 60 seconds), null),
          if(o_orderstatus = 'F', named_struct('kind', 'finished', 'at', {at} + interval 300 seconds), null)))) as e""",
    ).select("run_id", "e.kind", "e.at", F.lit(600).alias("limit_sec"), F.lit(400).alias("eta_sec"))


R.add(
    "t8_run_timeouts",
    lambda s, d: _ended(s, lambda c: sjob.run_timeouts(_run_rows(s, d), closing=c), "runs"),
    """WITH r AS (SELECT o_orderkey AS run_id, o_orderstatus AS st, o_orderpriority LIKE '1%' AS c, epoch_us(o_orderdate) AS t FROM orders)
    SELECT run_id, 'failed' AS status, 'cancelled' AS warning, t + 60000000 AS at_us FROM r WHERE c
    UNION ALL SELECT run_id, 'failed', 'abandoned', t + 90000000 FROM r WHERE NOT c AND st = 'P'
    UNION ALL SELECT run_id, 'processing', 'eta_overrun', t + 400000000 FROM r WHERE NOT c AND st = 'O'
    UNION ALL SELECT run_id, 'partial', 'time_limit_reached', t + 600000000 FROM r WHERE NOT c AND st = 'O'""",
)


def _requests(s, d):
    return table_stream(prepare(s), d, "events").selectExpr(
        "timestamp_seconds(floor(unix_timestamp(cast(ts as timestamp)) / 7200) * 7200 + event_id % 60) as at",
        "if(event_type = 'view', 'get', 'post') as method",
        """element_at(array('/', '/checkout/pagar', '/checkout/pagos/9/sinpe', '/planes'), cast(event_id % 4 as int) + 1) as path""",
        "concat('10.0.0.', user_id % 2) as ip",
    )


def _live_backfill(s, d):
    """Two logins per session, as a stream; the events are read with the earlier one's user."""
    logins = table_stream(prepare(s), d, "customer").where("c_mktsegment in ('HOUSEHOLD', 'MACHINERY')").selectExpr(
        "concat('s-', c_custkey) as anonymous_session_key",
        """explode(array(named_struct('u', c_custkey, 'at', timestamp_seconds(1704067200 + c_custkey % 7)),
            named_struct('u', c_custkey + 1, 'at', timestamp_seconds(1704067200 + c_custkey % 5)))) as e""",
    ).selectExpr("anonymous_session_key", "e.u as user_id", "e.at as logged_in_at")
    root = shared_path(s, "identities")
    sev.record_logins(logins, root)
    return sev.identified(src.user_events(s, d), root).select("id", F.coalesce("user_id", F.lit(-1)).alias("user_id"))


R.add(
    "t11_live_backfill",
    _live_backfill,
    """SELECT e.id, coalesce(e.user_id, CASE WHEN l.user_id % 5 < l.user_id % 7 THEN l.user_id + 1 ELSE l.user_id END, -1) AS user_id
    FROM user_events e LEFT JOIN logins l ON e.anonymous_session_key = 's-' || l.user_id""",
)
R.add(
    "t12_request_throttle",
    lambda s, d: _ended(s, lambda c: sev.request_throttle(_requests(s, d), 2, closing=c), "throttle"),
    f"""SELECT {stamp('w')} AS window_start, rule, ip, n FROM (SELECT w, rule, ip, count(*) AS n FROM (
      SELECT make_timestamp((epoch_us(ts) // 7200000000) * 7200000000) AS w, CASE event_id % 4 WHEN 0 THEN 'auth' ELSE 'payment' END AS rule,
        '10.0.0.' || user_id % 2 AS ip FROM events WHERE event_type <> 'view' AND event_id % 4 <> 3) GROUP BY 1, 2, 3)
    WHERE n > 2""",
)
R.add(
    "t13_alert_throttle",
    lambda s, d: _ended(
        s,
        lambda c: sev.alert_throttle(_events(s, d).selectExpr("event_type as alert_key", "id", "occurred_at as at"), 60, closing=c),
        "alerts",
    ).select("alert_key", "id"),
    """WITH RECURSIVE walk AS (SELECT event_type AS alert_key, arg_min(id, (occurred_at, id)) AS id, min(occurred_at) AS t
        FROM user_events GROUP BY 1
      UNION ALL SELECT w.alert_key, x.id, x.t FROM walk w, LATERAL (SELECT arg_min(e.id, (e.occurred_at, e.id)) AS id, min(e.occurred_at) AS t
        FROM user_events e WHERE e.event_type = w.alert_key AND e.occurred_at >= w.t + INTERVAL 60 MINUTE) x WHERE x.id IS NOT NULL)
    SELECT alert_key, id FROM walk""",
)
R.add(
    "t14_live_funnel",
    lambda s, d: _ended(s, lambda c: sev.live_funnel(_events(s, d), closing=c), "funnel"),
    f"""SELECT {stamp('w')} AS window_start, event_type, n FROM (SELECT date_trunc('day', occurred_at) AS w, event_type, count(*) AS n
      FROM user_events WHERE event_type <> 'payment_failed' GROUP BY 1, 2)""",
)
R.add(
    "t14_live_status",
    lambda s, d: _ended(
        s,
        lambda c: sev.live_status(
            _orders(s, d).selectExpr(
                "cast(o_orderdate as timestamp) as created_at",
                "case o_orderstatus when 'F' then 'succeeded' when 'O' then 'pending' else 'failed' end as status",
            ),
            closing=c,
        ),
        "status",
    ),
    f"""SELECT {stamp('created_at')} AS window_start, status, count(*) AS n FROM payments GROUP BY payments.created_at, status""",
)
R.add(
    "t15_sessions",
    lambda s, d: _ended(s, lambda c: sev.sessions(_events(s, d), "12 hours", closing=c), "sessions").select("anonymous_session_key", "started_at", "n"),
    f"""SELECT anonymous_session_key, {stamp('min(occurred_at)')} AS started_at, count(*) AS n FROM (SELECT *,
      sum(CASE WHEN prev IS NULL OR occurred_at >= prev + INTERVAL 12 HOUR THEN 1 ELSE 0 END)
        OVER (PARTITION BY anonymous_session_key ORDER BY occurred_at, id ROWS UNBOUNDED PRECEDING) AS no
      FROM (SELECT *, lag(occurred_at) OVER (PARTITION BY anonymous_session_key ORDER BY occurred_at, id) AS prev FROM user_events))
    GROUP BY anonymous_session_key, no""",
)
