"""Registered queries over payments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cutledger.operators import payments as pay
from cutledger.plans.oracle import stamp
from cutledger.plans.registry import Registry
from cutledger.sources import driver as src

R = Registry()
AT = "1997-06-15 12:00:00"
SQL_AT = f"TIMESTAMP '{AT}'"
LOCAL = "CAST(created_at - INTERVAL 6 HOUR AS DATE)"
NET = "CASE WHEN total_amount > 0 THEN total_amount ELSE amount END"
P = src.payments


def _scoped(s, d):
    return pay.reporting_scope(P(s, d))


def D(expr: str, alias: str) -> str:
    return f"CAST({expr} AS DOUBLE) AS {alias}"


R.add(
    "f1_reporting_scope",
    lambda s, d: _scoped(s, d).select("id", "status", "amount"),
    f"SELECT id, status, {D('amount', 'amount')} FROM payments WHERE superseded_at IS NULL",
)
R.add(
    "f2_in_local_days",
    lambda s, d: pay.in_local_days(P(s, d), "1996-03-01", "1996-08-31").select("id", "created_at"),
    f"""SELECT id, {stamp('created_at')} AS created_at FROM payments WHERE created_at >= TIMESTAMP '1996-03-01 06:00:00'
    AND created_at < TIMESTAMP '1996-09-01 06:00:00'""",
)
R.add(
    "f3_paid_in_period_bounds",
    lambda s, d: pay.in_local_days(
        P(s, d), *pay.period_bounds({"end_date": ""}, dt.datetime(1996, 3, 20, tzinfo=dt.timezone.utc)), "paid_at"
    ).select("id", "paid_at"),
    f"SELECT id, {stamp('paid_at')} AS paid_at FROM payments WHERE paid_at >= TIMESTAMP '1996-03-01 06:00:00'",
)
R.add(
    "f4_where_in",
    lambda s, d: pay.where_in(pay.where_in(P(s, d), "payment_method", ["sinpe_crc", " "]), "status", []).select("id"),
    "SELECT id FROM payments WHERE payment_method = 'sinpe_crc'",
)
R.add(
    "f5_search",
    lambda s, d: pay.search(P(s, d), "%3@EXAMPLE").select("id", "purchaser_email"),
    r"""SELECT id, purchaser_email FROM payments WHERE purchaser_name ILIKE '%\%3@EXAMPLE%' ESCAPE '\'
    OR purchaser_email ILIKE '%\%3@EXAMPLE%' ESCAPE '\' OR purchase_reference ILIKE '%\%3@EXAMPLE%' ESCAPE '\'
    OR sinpe_transfer_identification ILIKE '%\%3@EXAMPLE%' ESCAPE '\'""",
)
R.add(
    "f9_payment_history",
    lambda s, d: pay.payment_history(P(s, d), 3).select("user_id", "position", "id"),
    """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position, id
    FROM payments WHERE checkout_abandoned_at IS NULL QUALIFY position <= 3""",
)
R.add(
    "l5_recent",
    lambda s, d: pay.recent(P(s, d), 8, 100).select("id", "created_at"),
    f"""SELECT id, {stamp('created_at')} AS created_at FROM payments WHERE user_id = 8 AND checkout_abandoned_at IS NULL
    ORDER BY payments.created_at DESC, id DESC LIMIT 100""",
)
R.add(
    "p1_net_collected",
    lambda s, d: P(s, d).select("id", pay.net_collected().alias("net")),
    f"SELECT id, {D(NET, 'net')} FROM payments",
)
R.add(
    "p2_labels",
    lambda s, d: pay.labels(P(s, d)).select("id", "method_label", "status_label", "purpose_label"),
    """SELECT id, CASE payment_method WHEN 'card_crc' THEN 'Tarjeta CRC' WHEN 'card_usd' THEN 'Tarjeta USD'
      ELSE 'SINPE Móvil' END AS method_label,
    CASE status WHEN 'succeeded' THEN 'Exitoso' WHEN 'pending' THEN 'Pendiente' ELSE 'Fallido' END AS status_label,
    CASE purpose WHEN 'single_download' THEN 'Descarga suelta' ELSE 'Plan' END AS purpose_label FROM payments""",
)
R.add(
    "p3_product_label",
    lambda s, d: pay.labels(P(s, d)).groupBy("product_label").agg(F.count("*").alias("n")),
    """SELECT CASE product_description WHEN 'single_download' THEN 'Procesamiento de anidado DXF'
      WHEN 'plan_1_months' THEN 'Suscripción mensual - Plan de 1 mes'
      ELSE 'Suscripción mensual - Plan de ' || substr(product_description, 6, 1) || ' meses' END AS product_label,
    count(*) AS n FROM payments GROUP BY 1""",
)
R.add(
    "p4_tier_months",
    lambda s, d: P(s, d).select("id", F.coalesce(pay.tier_months(F.col("product_description")), F.lit(0)).alias("tier")),
    """SELECT id, CASE WHEN purpose = 'plan_subscription' THEN CAST(substr(product_description, 6, 1) AS INTEGER)
    ELSE 0 END AS tier FROM payments""",
)
R.add(
    "p5_catalog_code",
    lambda s, d: P(s, d).select("id", pay.catalog_code(F.col("cabys_code")).alias("code")),
    "SELECT id, coalesce(nullif(cabys_code, ''), '8314200000100') AS code FROM payments",
)
_RUBRIC = """CASE WHEN status <> 'succeeded' THEN 'No declarable' WHEN currency = 'usd' THEN 'Exentas crédito pleno'
    ELSE 'Ventas a 13%' END"""
R.add(
    "p6_vat_rubric",
    lambda s, d: P(s, d).groupBy(pay.vat_rubric().alias("rubric")).agg(F.count("*").alias("n")),
    f"SELECT {_RUBRIC} AS rubric, count(*) AS n FROM payments GROUP BY 1",
)
_ACTIVE = f"kind = 'single_purchase' AND retained_until >= {SQL_AT}"
_COVERED = f"""EXISTS (SELECT 1 FROM download_grants g WHERE g.user_id = p.user_id AND g.nesting_run_id = p.nesting_run_id
    AND g.kind = 'single_purchase' AND g.retained_until >= {SQL_AT} AND g.updated_at >= p.created_at)"""
_LATER = """EXISTS (SELECT 1 FROM payments s WHERE s.user_id = p.user_id AND s.nesting_run_id = p.nesting_run_id
    AND s.status = 'succeeded' AND s.purpose = 'single_download' AND s.created_at {op} p.created_at)"""
_LOCKROWS = f"""SELECT p.*, {_COVERED} AS covered, (payment_method = 'sinpe_crc' AND status = 'pending') AS waiting,
    created_at + INTERVAL 15 MINUTE AS expires, {_LATER.format(op='>=')} AS later_lock FROM payments p"""
# payments carry order dates at midnight, so the lock test is taken just after one of them
LOCK_AT = "1997-06-15 00:07:00"


def _at_lock(sql: str) -> str:
    return sql.replace(SQL_AT, f"TIMESTAMP '{LOCK_AT}'")


_ACTIVE_LOCK = f"""(waiting AND superseded_at IS NULL AND checkout_lock_released_at IS NULL
    AND checkout_abandoned_at IS NULL AND NOT covered AND {SQL_AT} < expires)"""
R.add(
    "p18_checkout_lock",
    lambda s, d: pay.checkout_lock(P(s, d), src.download_grants(s, d), LOCK_AT).select(
        "id", "lock_expires_at", "lock_active", "lock_expired"
    ),
    _at_lock(
        f"""SELECT id, CASE WHEN waiting THEN {stamp('expires')} END AS lock_expires_at, {_ACTIVE_LOCK} AS lock_active,
    (waiting AND {SQL_AT} >= expires) AS lock_expired FROM ({_LOCKROWS})"""
    ),
)
R.add(
    "p23_payment_state",
    lambda s, d: pay.payment_state(P(s, d), src.download_grants(s, d), LOCK_AT).select(
        "id", "ui_state", "can_retry", "can_release"
    ),
    _at_lock(
        f"""SELECT id, CASE WHEN status = 'succeeded' AND gate = 'succeeded' AND (purpose = 'plan_subscription' OR granted)
      THEN 'ready' WHEN status = 'succeeded' THEN 'confirming' WHEN status = 'failed' THEN 'declined'
      WHEN gate = 'requires_payment_method' AND payment_method LIKE 'card%' THEN 'canceled'
      WHEN gate = 'requires_payment_method' THEN 'declined' WHEN gate IN ('requires_action','canceled') THEN 'canceled'
      ELSE 'waiting' END AS ui_state,
    (payment_method = 'sinpe_crc' AND purpose = 'single_download' AND nesting_run_id IS NOT NULL AND status = 'pending'
      AND NOT {_ACTIVE_LOCK}) AS can_retry, {_ACTIVE_LOCK} AS can_release
    FROM (SELECT *, coalesce(gateway_status, '') AS gate, EXISTS (SELECT 1 FROM download_grants g
      WHERE g.user_id = x.user_id AND g.nesting_run_id = x.nesting_run_id) AS granted FROM ({_LOCKROWS}) x)"""
    ),
)
R.add(
    "p26_validate_payments",
    lambda s, d: pay.validate_payments(P(s, d)).select("id", "errors"),
    """SELECT id, concat_ws(',', CASE WHEN gateway_provider = 'onvo' AND onvo_payment_intent_id IS NULL
      THEN 'onvo_payment_intent_id' END, CASE WHEN checkout_lock_reason = 'odd_reason' THEN 'checkout_lock_reason' END,
    CASE WHEN coalesce(cabys_code, '') <> '8314200000100' THEN 'cabys_code' END) AS errors FROM payments""",
)
R.add(
    "j1_tier_join",
    lambda s, d: pay.tier_join(P(s, d), src.subscriptions(s, d)).select("id", "tier_months"),
    """SELECT p.id, s.tier_months FROM payments p JOIN subscriptions s ON s.id = p.subscription_id
    WHERE p.status = 'succeeded'""",
)
R.add(
    "j3_superseded_by_later",
    lambda s, d: pay.superseded_by_later(P(s, d)).select("id", "superseded_later"),
    f"SELECT id, {_LATER.format(op='>')} AS superseded_later FROM payments p",
)
R.add(
    "j4_superseded_for_lock",
    lambda s, d: pay.superseded_for_lock(P(s, d)).select("id", "superseded_lock"),
    f"SELECT id, {_LATER.format(op='>=')} AS superseded_lock FROM payments p",
)
R.add(
    "j5_incomplete_card",
    lambda s, d: pay.incomplete_card(P(s, d), src.download_grants(s, d), AT).select("id", "status"),
    f"""SELECT id, status FROM payments p WHERE payment_method LIKE 'card%' AND status <> 'succeeded'
    AND ({_LATER.format(op='>')} OR NOT {_COVERED})""",
)
_AWAIT = f"""SELECT * FROM payments p WHERE status = 'pending' AND purpose = 'single_download' AND superseded_at IS NULL
    AND NOT (checkout_abandoned_at IS NOT NULL AND payment_method LIKE 'card%') AND NOT {_COVERED}"""
_GRANTROWS = f"""SELECT g.user_id, g.nesting_run_id, g.created_at AS sort_at, g.id AS grant_id, l.id AS display_payment_id
    FROM download_grants g LEFT JOIN (SELECT * FROM payments WHERE status = 'succeeded' AND purpose = 'single_download'
      QUALIFY row_number() OVER (PARTITION BY user_id, nesting_run_id ORDER BY created_at DESC, id DESC) = 1) l
    ON l.user_id = g.user_id AND l.nesting_run_id = g.nesting_run_id
    WHERE g.kind = 'single_purchase' AND g.retained_until >= {SQL_AT} AND NOT EXISTS (SELECT 1 FROM ({_AWAIT}) w
      WHERE w.user_id = g.user_id AND w.nesting_run_id = g.nesting_run_id)"""


def _grant_rows(s, d):
    return pay.purchase_rows(src.download_grants(s, d), P(s, d), AT)


def _union(s, d):
    return pay.purchase_union(_grant_rows(s, d), pay.pending_rows(P(s, d), src.download_grants(s, d), AT))


_UNION = f"""SELECT user_id, nesting_run_id, sort_at, grant_id, NULL AS pending_payment_id FROM ({_GRANTROWS})
    UNION ALL SELECT user_id, nesting_run_id, created_at, NULL, id FROM ({_AWAIT})"""
R.add(
    "j6_purchase_rows",
    _grant_rows,
    f"SELECT user_id, nesting_run_id, {stamp('sort_at')} AS sort_at, grant_id, display_payment_id FROM ({_GRANTROWS})",
)
R.add(
    "j7_covered_by_grant",
    lambda s, d: pay.covered_by_grant(P(s, d), src.download_grants(s, d), AT).select("id", "covered"),
    f"SELECT id, {_COVERED} AS covered FROM payments p",
)
R.add(
    "w3_latest_success",
    lambda s, d: pay.latest_success(P(s, d)).select("user_id", "nesting_run_id", "id"),
    """SELECT user_id, nesting_run_id, id FROM payments WHERE status = 'succeeded' AND purpose = 'single_download'
    QUALIFY row_number() OVER (PARTITION BY user_id, nesting_run_id ORDER BY created_at DESC, id DESC) = 1""",
)
R.add(
    "x1_purchase_union",
    lambda s, d: _union(s, d).select(
        "user_id", "sort_at", F.coalesce("grant_id", F.lit(-1)).alias("grant_id"),
        F.coalesce("pending_payment_id", F.lit(-1)).alias("pending_payment_id"),
    ),
    f"""SELECT user_id, {stamp('sort_at')} AS sort_at, coalesce(grant_id, -1) AS grant_id,
    coalesce(pending_payment_id, -1) AS pending_payment_id FROM ({_UNION})""",
)
R.add(
    "g31_purchase_counters",
    lambda s, d: pay.purchase_counters(_union(s, d)),
    f"SELECT user_id, count(grant_id) AS ready, count(pending_payment_id) AS pending FROM ({_UNION}) GROUP BY 1",
)
R.add(
    "w12_supersede",
    lambda s, d: pay.supersede(P(s, d)).select("id", "new_superseded_at", "position"),
    f"""SELECT id, {stamp('nxt')} AS new_superseded_at, position FROM (SELECT id,
      lead(created_at) OVER w AS nxt, row_number() OVER w AS position FROM payments
      WHERE status = 'pending' AND purpose = 'single_download' AND payment_method = 'sinpe_crc' AND superseded_at IS NULL
      WINDOW w AS (PARTITION BY user_id, nesting_run_id ORDER BY created_at, id)) WHERE nxt IS NOT NULL""",
)
R.add(
    "l8_pending_lock_user",
    lambda s, d: pay.pending_lock(P(s, d), src.download_grants(s, d), LOCK_AT).select("user_id", "id"),
    _at_lock(
        f"""SELECT user_id, id FROM ({_LOCKROWS}) WHERE {_ACTIVE_LOCK} AND purpose = 'single_download' AND NOT later_lock
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) = 1"""
    ),
)
R.add(
    "l8_pending_lock_project",
    lambda s, d: pay.pending_lock(P(s, d), src.download_grants(s, d), LOCK_AT, src.runs(s, d)).select(
        "user_id", "project_id", "id"
    ),
    _at_lock(
        f"""SELECT x.user_id, r.project_id, x.id FROM ({_LOCKROWS}) x JOIN runs r ON r.id = x.nesting_run_id
    WHERE {_ACTIVE_LOCK} AND purpose = 'single_download' AND NOT later_lock
    QUALIFY row_number() OVER (PARTITION BY x.user_id, r.project_id ORDER BY x.created_at DESC, x.id DESC) = 1"""
    ),
)
R.add(
    "g3_status_counts",
    lambda s, d: pay.status_counts(_scoped(s, d)),
    """SELECT count(*) FILTER (status = 'succeeded') AS succeeded_count, count(*) FILTER (status = 'failed') AS failed_count,
    count(*) FILTER (status = 'pending') AS pending_count FROM payments WHERE superseded_at IS NULL""",
)
_SUMS = ", ".join(D(f"sum({c})", c) for c in pay.MONEY)
R.add(
    "g4_declaration_totals",
    lambda s, d: pay.declaration_totals(_scoped(s, d)),
    f"""SELECT currency, count(*) AS n, {_SUMS}, {D('sum(coalesce(nullif(total_amount, 0), amount))', 'total')} FROM payments
    WHERE superseded_at IS NULL AND status = 'succeeded' GROUP BY 1""",
)
R.add(
    "g5_daily_summary",
    lambda s, d: pay.daily_summary(_scoped(s, d)),
    f"""SELECT strftime({LOCAL}, '%Y-%m-%d') AS day, currency, payment_method, count(*) AS n, {_SUMS},
    {D(f'sum({NET})', 'net')} FROM payments WHERE superseded_at IS NULL AND status = 'succeeded' GROUP BY 1, 2, 3""",
)
R.add(
    "g6_daily_summary_with_total",
    lambda s, d: pay.daily_summary_with_total(_scoped(s, d)),
    f"""SELECT day, currency, payment_method, grouping(day) = 1 AS is_total, count(*) AS n, {_SUMS}, {D(f'sum({NET})', 'net')}
    FROM (SELECT *, strftime({LOCAL}, '%Y-%m-%d') AS day FROM payments WHERE superseded_at IS NULL AND status = 'succeeded')
    GROUP BY GROUPING SETS ((day, currency, payment_method), (currency))""",
)
R.add(
    "g7_purpose_counts",
    lambda s, d: pay.purpose_counts(_scoped(s, d)),
    """SELECT count(*) FILTER (purpose = 'single_download') AS single_count,
    count(*) FILTER (purpose = 'plan_subscription') AS plan_count FROM payments
    WHERE superseded_at IS NULL AND status = 'succeeded'""",
)
R.add(
    "g8_plans_by_tier",
    lambda s, d: pay.plans_by_tier(_scoped(s, d), src.subscriptions(s, d)),
    """SELECT count(*) FILTER (tier_months = 1) AS plans_1_month, count(*) FILTER (tier_months = 2) AS plans_2_month,
    count(*) FILTER (tier_months = 4) AS plans_4_month FROM payments p JOIN subscriptions s ON s.id = p.subscription_id
    WHERE p.superseded_at IS NULL AND p.status = 'succeeded'""",
)
R.add(
    "g10_vat_boxes",
    lambda s, d: pay.vat_boxes(pay.in_local_days(_scoped(s, d), "1996-01-01", "1996-12-31", "paid_at")),
    f"""SELECT b.box_no, b.box, b.currency, CAST(coalesce(CASE b.box_no WHEN 0 THEN s13 WHEN 1 THEN t13 ELSE ex END, 0)
      AS DOUBLE) AS amount FROM (SELECT sum(subtotal) FILTER (currency = 'crc') AS s13,
      sum(tax_amount) FILTER (currency = 'crc') AS t13, sum(subtotal) FILTER (currency = 'usd') AS ex FROM payments
      WHERE superseded_at IS NULL AND status = 'succeeded' AND paid_at >= TIMESTAMP '1996-01-01 06:00:00'
      AND paid_at < TIMESTAMP '1997-01-01 06:00:00'),
    (VALUES (0, 'Total ventas a 13%', 'CRC'), (1, 'Monto de impuesto a 13%', 'CRC'),
      (2, 'Total ventas exentas con derecho a crédito pleno', 'USD')) AS b(box_no, box, currency)""",
)
R.add(
    "g18_failure_rate",
    lambda s, d: pay.failure_rate(_scoped(s, d)).withColumn("failure_rate", F.round("failure_rate", 6)),
    """SELECT round(count(*) FILTER (status = 'failed') * 100.0::DOUBLE / count(*), 6) AS failure_rate,
    count(*) FILTER (status = 'failed') * 100.0::DOUBLE / count(*) > 20 AS alert FROM payments WHERE superseded_at IS NULL""",
)
_PAGE = """SELECT id, currency, (SELECT count(*) FROM scope {cnt}) AS total_count,
    greatest((SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) FROM scope {cnt}), 1) AS total_pages, {page} AS page
    FROM scope {flt} ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET {off}"""
_SCOPE = "WITH scope AS (SELECT * FROM payments WHERE superseded_at IS NULL AND status = 'succeeded') "
_PAGECOLS = ["id", "currency", "total_count", "total_pages", "page"]
R.add(
    "l1_page",
    lambda s, d: pay.page(pay.where_in(_scoped(s, d), "status", ["succeeded"]), 3).select(_PAGECOLS),
    _SCOPE + _PAGE.format(cnt="", flt="", page=3, off=40),
)
R.add(
    "l2_currency_pages",
    lambda s, d: pay.currency_pages(pay.where_in(_scoped(s, d), "status", ["succeeded"]), {"crc": 2, "usd": 0}).select(
        _PAGECOLS
    ),
    _SCOPE
    + "SELECT * FROM ("
    + _PAGE.format(cnt="WHERE currency = 'crc'", flt="WHERE currency = 'crc'", page=2, off=20)
    + ") UNION ALL SELECT * FROM ("
    + _PAGE.format(cnt="WHERE currency = 'usd'", flt="WHERE currency = 'usd'", page=1, off=0)
    + ")",
)
R.add(
    "l3_sort_for_vat",
    lambda s, d: pay.sort_for_vat(_scoped(s, d).where("paid_at is not null")).select("id", "paid_at"),
    f"SELECT id, {stamp('paid_at')} AS paid_at FROM payments WHERE superseded_at IS NULL AND paid_at IS NOT NULL",
)
R.add(
    "l4_sort_summary",
    lambda s, d: pay.sort_summary(pay.daily_summary(_scoped(s, d))).select("day", "payment_method", "n"),
    f"""SELECT strftime({LOCAL}, '%Y-%m-%d') AS day, payment_method, count(*) AS n FROM payments
    WHERE superseded_at IS NULL AND status = 'succeeded' GROUP BY 1, 2""",
)
R.add(
    "j29_match_webhooks",
    lambda s, d: pay.match_webhooks(src.gateway_events(s, d), P(s, d)).groupBy("type", "error").agg(
        F.count("*").alias("n"), F.countDistinct("payment_id").alias("n_payments")
    ),
    """SELECT e.type, CASE WHEN p.id IS NULL THEN 'payment not found' END AS error, count(*) AS n,
    count(DISTINCT p.id) AS n_payments FROM gateway_events e LEFT JOIN payments p
    ON p.onvo_payment_intent_id = e.payment_intent_id GROUP BY 1, 2""",
)
