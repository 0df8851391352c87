"""Registered queries over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutledger.operators import events as ev
from cutledger.plans.oracle import stamp
from cutledger.plans.registry import Registry
from cutledger.sources import dims
from cutledger.sources import driver as src

R = Registry()
PERIOD = ("2024-01-03", "2024-01-25")
IN_PERIOD = "occurred_at >= TIMESTAMP '2024-01-03' AND occurred_at < TIMESTAMP '2024-01-26'"
STAGES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(dims.FUNNEL_STAGES, 1))
NOW = "2024-02-01"


def _filtered(spark, d, **kw):
    return ev.filter_events(src.user_events(spark, d), *PERIOD, **kw)


R.add(
    "s5_event_catalog",
    lambda s, d: src.user_events(s, d)
    .groupBy("event_type")
    .agg(F.count("*").alias("n"))
    .join(dims.catalog(s), "event_type", "right")
    .select("event_type", "priority", F.size("required_properties").alias("n_required"), F.coalesce("n", F.lit(0)).alias("n")),
    "SELECT c.event_type, c.priority, c.n_required, coalesce(e.n, 0) AS n FROM (VALUES "
    + ", ".join(f"('{k}', '{p}', {len(r)})" for k, (p, r) in dims.EVENT_CATALOG.items())
    + ") AS c(event_type, priority, n_required) LEFT JOIN (SELECT event_type, count(*) AS n FROM user_events GROUP BY 1) e"
    " ON e.event_type = c.event_type",
)
R.add(
    "f7_filter_events",
    lambda s, d: _filtered(s, d, locale="es", payment_method="sinpe_crc", currency="crc").select(
        "id", "event_type", "occurred_at"
    ),
    f"SELECT id, event_type, {stamp('occurred_at')} AS occurred_at FROM user_events WHERE {IN_PERIOD} AND locale = 'es'"
    " AND p_method = 'sinpe_crc' AND p_currency = 'crc'",
)
R.add(
    "g1_funnel",
    lambda s, d: ev.funnel(_filtered(s, d)),
    f"""SELECT g.stage_no, g.event_type, coalesce(n, 0) AS n FROM (VALUES {STAGES}) AS g(stage_no, event_type)
    LEFT JOIN (SELECT event_type, count(*) AS n FROM user_events WHERE {IN_PERIOD} GROUP BY 1) c
    ON c.event_type = g.event_type""",
)
_CONV = f"""SELECT paywall_count, succeeded_count,
    CASE WHEN paywall_count > 0 THEN round(succeeded_count / paywall_count * 100, 1) ELSE 0.0 END AS conversion_percent,
    CASE WHEN paywall_count > 0 THEN round(succeeded_count / paywall_count * 100, 1) ELSE 0.0 END < 15 AS conversion_alert
    FROM (SELECT count(*) FILTER (event_type = 'paywall_viewed')::DOUBLE AS paywall_d,
      count(*) FILTER (event_type = 'paywall_viewed') AS paywall_count,
      count(*) FILTER (event_type = 'payment_succeeded') AS succeeded_count FROM user_events WHERE {IN_PERIOD} %s)"""
R.add("g2_conversion", lambda s, d: ev.conversion(_filtered(s, d)), _CONV % "")
R.add(
    "g2_conversion_by_method",
    lambda s, d: ev.conversion(_filtered(s, d, payment_method="card_usd")),
    _CONV % "AND p_method = 'card_usd'",
)
R.add(
    "g13_bot_flag",
    lambda s, d: ev.bot_flag(src.user_events(s, d), "2024-01-10 12:00:00", limit=5),
    """SELECT count(*) AS low_priority_count, count(*) > 5 AS bot_heuristic FROM user_events WHERE priority = 'low'
    AND occurred_at >= TIMESTAMP '2024-01-10 11:00:00' AND occurred_at <= TIMESTAMP '2024-01-10 12:00:00'""",
)
R.add(
    "g14_facets",
    lambda s, d: ev.facets(src.user_events(s, d)),
    """SELECT DISTINCT facet, value FROM (SELECT 'locale' AS facet, locale AS value FROM user_events
    UNION ALL SELECT 'payment_method', p_method FROM user_events UNION ALL SELECT 'currency', p_currency FROM user_events)
    WHERE value IS NOT NULL""",
)
R.add(
    "w5_dedup_events",
    lambda s, d: ev.dedup_events(src.user_events(s, d)).select("id", "event_type", "occurred_at"),
    f"""SELECT id, event_type, {stamp('occurred_at')} AS occurred_at FROM user_events
    QUALIFY idempotency_key IS NULL OR row_number() OVER (PARTITION BY idempotency_key ORDER BY id) = 1""",
)
R.add(
    "w14_trailing_hour_count",
    lambda s, d: ev.trailing_hour_count(src.user_events(s, d)),
    f"""SELECT id, principal, {stamp('occurred_at')} AS occurred_at, count(*) OVER (PARTITION BY principal
      ORDER BY occurred_at RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS low_in_hour
    FROM (SELECT *, coalesce('u:' || user_id, 's:' || anonymous_session_key) AS principal FROM user_events
      WHERE priority = 'low')""",
)
_CTX = """WITH primary_hit AS (SELECT r.id AS run_id, e.* FROM runs r ASOF JOIN
      (SELECT * FROM user_events ORDER BY occurred_at, id) e
      ON r.project_id = e.project_id AND coalesce(r.started_at, r.created_at) >= e.occurred_at),
    fallback_hit AS (SELECT r.id AS run_id, e.* FROM (SELECT *, coalesce(finished_at, TIMESTAMP '2024-02-01') AS fb FROM runs) r
      ASOF JOIN (SELECT * FROM user_events WHERE event_type IN ('workspace_started','first_dxf_uploaded')) e
      ON r.project_id = e.project_id AND r.fb >= e.occurred_at WHERE r.fb > coalesce(r.started_at, r.created_at))
    SELECT r.id AS run_id, coalesce(p.id, f.id, -1) AS event_id,
      coalesce(CASE WHEN p.id IS NULL THEN f.user_id ELSE p.user_id END, -1) AS user_id,
      CASE WHEN p.id IS NULL THEN f.anonymous_session_key ELSE p.anonymous_session_key END AS anonymous_session_key,
      CASE WHEN p.id IS NULL THEN f.country_code ELSE p.country_code END AS country_code,
      coalesce(CASE WHEN p.id IS NULL THEN f.locale ELSE p.locale END, 'es') AS locale
    FROM runs r LEFT JOIN primary_hit p ON p.run_id = r.id LEFT JOIN fallback_hit f ON f.run_id = r.id"""
R.add(
    "j10_event_context",
    lambda s, d: ev.event_context(src.runs(s, d), src.user_events(s, d), NOW).select(
        "run_id",
        F.coalesce("event_id", F.lit(-1)).alias("event_id"),
        F.coalesce("user_id", F.lit(-1)).alias("user_id"),
        "anonymous_session_key",
        "country_code",
        "locale",
    ),
    _CTX,
)
R.add(
    "w23_user_timeline",
    lambda s, d: ev.user_timeline(src.user_events(s, d)).select("user_id", "id", "event_type", "occurred_at"),
    f"SELECT user_id, id, event_type, {stamp('occurred_at')} AS occurred_at FROM user_events WHERE user_id IS NOT NULL",
)
R.add(
    "t1_validate_events",
    lambda s, d: ev.validate_events(src.user_events(s, d)).select("id", "priority", "reject_reason"),
    """SELECT id, priority, CASE event_type WHEN 'first_dxf_uploaded' THEN 'missing: filename,byte_size'
      WHEN 'nest_completed' THEN 'missing: duration_ms,pieces_count,sheets_used' END AS reject_reason FROM user_events""",
)
R.add(
    "t11_backfill_users",
    lambda s, d: ev.backfill_users(
        src.user_events(s, d),
        src.logins(s, d).selectExpr("concat('s-', user_id) as anonymous_session_key", "user_id"),
    ).select("id", F.coalesce("user_id", F.lit(-1)).alias("user_id")),
    """SELECT e.id, coalesce(e.user_id, l.user_id, -1) AS user_id FROM user_events e LEFT JOIN logins l
    ON e.anonymous_session_key = 's-' || l.user_id""",
)
