"""Registered queries over prices, plans, quotas, carts and countries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.functions.clock import plan_end
from cutledger.functions.money import to_major, to_minor
from cutledger.operators import addresses as adr
from cutledger.operators import billing as bill
from cutledger.operators import events as ev
from cutledger.plans.oracle import stamp
from cutledger.plans.registry import Registry
from cutledger.sources import driver as src

R = Registry()
AT = "1997-06-15 12:00:00"
SQL_AT = f"TIMESTAMP '{AT}'"
END_OF_DAY = "CAST(CAST({0} AS DATE) + to_months({1}) AS TIMESTAMP) + INTERVAL 1 DAY"
LOCAL = "(({0} AT TIME ZONE 'UTC') AT TIME ZONE time_zone)"
PLAN_END = (
    "(((" + END_OF_DAY.format(LOCAL.format("{0}"), "{1}") + ") AT TIME ZONE time_zone) AT TIME ZONE 'UTC'"
    " - INTERVAL 1 MICROSECOND)"
)

R.add(
    "f10_active_at",
    lambda s, d: bill.active_at(src.subscriptions(s, d), AT).select("id", "user_id"),
    f"SELECT id, user_id FROM subscriptions WHERE {SQL_AT} BETWEEN starts_at AND ends_at",
)
R.add(
    "f11_retention_active",
    lambda s, d: bill.retention_active(src.download_grants(s, d), "1997-06-15").select("id"),
    "SELECT id FROM download_grants WHERE kind = 'single_purchase' AND retained_until >= TIMESTAMP '1997-06-15'",
)
R.add(
    "f11_retained_active",
    lambda s, d: bill.retained_active(src.download_grants(s, d), "1997-06-15").select("id"),
    "SELECT id FROM download_grants WHERE kind = 'single_purchase' AND retained_until > TIMESTAMP '1997-06-15'",
)
R.add(
    "t9_purge_list",
    lambda s, d: bill.purge_list(src.download_grants(s, d), "1997-06-15").select("id"),
    "SELECT id FROM download_grants WHERE kind = 'single_purchase' AND retained_until < TIMESTAMP '1997-06-15'",
)
R.add(
    "t10_extend_retention",
    lambda s, d: bill.extend_retention(src.download_grants(s, d), src.payments(s, d).where("paid_at is not null")).select(
        "id", "retained_until"
    ),
    f"""SELECT g.id, {stamp("greatest(g.retained_until, m.p + INTERVAL 24 HOUR)")} AS retained_until FROM download_grants g
    LEFT JOIN (SELECT user_id, nesting_run_id, max(paid_at) AS p FROM payments GROUP BY 1, 2) m
    ON m.user_id = g.user_id AND m.nesting_run_id = g.nesting_run_id""",
)
R.add(
    "f12_billable_users",
    lambda s, d: bill.billable_users(src.users(s, d)).select("id"),
    "SELECT id FROM users WHERE confirmed_at IS NOT NULL AND suspended_at IS NULL",
)
_ERR = """CASE WHEN billing_method = 'sinpe' AND currency <> 'crc' THEN 'sinpe requires crc currency'
    WHEN product = 'plan' AND tier_months IS NULL THEN 'tier_months required for plan'
    WHEN product = 'plan' AND overage THEN 'plan overage is not supported'
    WHEN product = 'plan' AND tier_months = 3 THEN 'unknown plan tier_months' END"""
_PRICED = f"""SELECT q.*, {_ERR} AS price_error, CASE WHEN {_ERR} IS NULL THEN CASE WHEN currency = 'usd' THEN card_usd
      WHEN billing_method = 'sinpe' THEN v.sinpe ELSE v.official END END AS price,
      CASE WHEN currency = 'crc' THEN v.sinpe END AS promo,
      CASE WHEN currency = 'crc' THEN v.official ELSE v.card_usd END AS list_price
    FROM (SELECT * FROM quotes) q LEFT JOIN (SELECT product AS vp, tier AS vt, overage AS vo, official, sinpe, card_usd
      FROM price_rows) v ON vp = product AND vo = overage AND vt = CASE WHEN product = 'plan' THEN tier_months ELSE 0 END"""
R.add(
    "p7_with_price",
    lambda s, d: bill.with_price(src.quotes(s, d)).select("id", "price", "price_error"),
    f"SELECT id, CAST(price AS DOUBLE) AS price, price_error FROM ({_PRICED})",
)


def _breakdown(s, d):
    asked = bill.with_price(src.quotes(s, d)).where("price_error is null").drop("price", "price_error")
    card = bill.with_price(asked.withColumn("_m", F.col("billing_method")).withColumn("billing_method", F.lit("card")))
    listed = card.withColumnRenamed("price", "list_price").drop("price_error").withColumn("billing_method", F.lit("sinpe"))
    both = bill.with_price(listed).withColumnRenamed("price", "sinpe_price").drop("price_error")
    return bill.checkout_breakdown(both.withColumn("billing_method", F.col("_m")).drop("_m"))


R.add(
    "p8_checkout_breakdown",
    lambda s, d: _breakdown(s, d).select("id", "list_price", "discount_amount", "subtotal", "tax_amount", "total_amount"),
    f"""SELECT id, CAST(list_price AS DOUBLE) AS list_price, CAST(disc AS DOUBLE) AS discount_amount,
      CAST(list_price - disc AS DOUBLE) AS subtotal, CAST(tax AS DOUBLE) AS tax_amount,
      CAST(list_price - disc + tax AS DOUBLE) AS total_amount
    FROM (SELECT *, CASE WHEN iva_applicable THEN round(CAST(list_price - disc AS DECIMAL(12,2)) * 0.13, 2) ELSE 0 END AS tax
      FROM (SELECT *, CASE WHEN billing_method = 'sinpe' AND promo IS NOT NULL THEN greatest(list_price - promo, 0) ELSE 0 END
        AS disc FROM ({_PRICED}) WHERE price_error IS NULL))""",
)
_IPC = """SELECT i.id, r.country_code AS ip_country FROM ip_numbers i LEFT JOIN ip_ranges r ON i.n BETWEEN r.ip_from AND r.ip_to
    AND i.ip <> '10.0.0.1' AND NOT (i.ip LIKE '127.%') AND NOT (i.ip LIKE '10.%')
    AND NOT (i.n BETWEEN 2886729728 AND 2887778303) AND NOT (i.ip LIKE '192.168.%')"""
_CART = "CASE WHEN id % 2 = 0 THEN ' cr' WHEN id % 7 = 0 THEN NULL ELSE 'us' END"
R.add(
    "p8_cart_breakdown",
    lambda s, d: bill.cart_breakdown(
        src.carts(s, d).withColumns({"country_code": F.expr(_CART), "billing_method": F.expr("if(id % 3 = 0, 'card', 'sinpe')")})
    ).select("id", "list_price_cents", "policy_currency", "list_price", "discount_amount", "subtotal", "tax_amount", "total_amount"),
    f"""SELECT id, list_price_cents, CASE WHEN home THEN 'crc' ELSE 'usd' END AS policy_currency, l AS list_price, d AS discount_amount,
      l - d AS subtotal, CASE WHEN home THEN round((l - d) * 0.13, 2) ELSE 0 END AS tax_amount,
      l - d + CASE WHEN home THEN round((l - d) * 0.13, 2) ELSE 0 END AS total_amount
    FROM (SELECT *, CASE WHEN id % 3 <> 0 THEN greatest(l - p, 0) ELSE 0 END AS d FROM (SELECT *, list_price_cents / u AS l, sinpe_price_cents / u AS p
      FROM (SELECT *, coalesce(upper(trim({_CART})) = 'CR', false) AS home, CASE WHEN coalesce(upper(trim({_CART})) = 'CR', false) THEN 1.0 ELSE 100.0 END AS u
        FROM carts)))""",
)
R.add(
    "p10_event_country",
    lambda s, d: ev.resolve_event_country(bill.country_for_ip(src.visits(s, d), src.ip_ranges(s, d))).select("id", "country_code"),
    f"""SELECT v.id, coalesce(CASE WHEN trim(header_country) <> '' THEN upper(header_country) END, ip_country) AS country_code
    FROM visits v JOIN ({_IPC}) i ON i.id = v.id""",
)
R.add(
    "p9_regional_policy",
    lambda s, d: bill.regional_policy(src.user_events(s, d).select("id", "country_code")).select(
        "id", "policy_country", "policy_currency", "iva_applicable", "available_methods", "default_method", "policy_error"
    ),
    """SELECT id, country_code AS policy_country, CASE WHEN country_code = 'CR' THEN 'crc' ELSE 'usd' END AS policy_currency,
    coalesce(country_code = 'CR', false) AS iva_applicable,
    CASE WHEN country_code = 'CR' THEN 'sinpe,card' ELSE 'card' END AS available_methods,
    CASE WHEN country_code = 'CR' THEN 'sinpe' ELSE 'card' END AS default_method, CAST(NULL AS VARCHAR) AS policy_error
    FROM user_events""",
)
R.add(
    "j20_country_for_ip",
    lambda s, d: bill.country_for_ip(src.user_events(s, d).select("id", "ip"), src.ip_ranges(s, d)).select(
        "id", "ip_country"
    ),
    _IPC,
)


def _nested_networks(s, d):
    """Networks of both families from customers: wide ones, and narrower ones inside some of them."""
    c = src.table(s, d, "customer").selectExpr("c_custkey as k", "c_nationkey as n")
    forms = (
        ("concat('2001:db8:', lower(hex(k % 60)), '::/48')", "A"), ("concat('2001:DB8:', hex(k % 60), ':', hex(k % 7), '::/64')", "B"),
        ("concat(k % 200 + 11, '.0.0.0/8')", "C"), ("concat(k % 200 + 11, '.', k % 5, '.0.0/16')", "D"),
    )
    return reduce(DataFrame.union, [c.selectExpr(f"{form} as network", f"concat('{mark}', n) as country_code") for form, mark in forms])


def _addresses(s, d):
    e = src.table(s, d, "events").selectExpr("event_id as id", "event_id % 70 as a", "event_id % 9 as b")
    return e.selectExpr("id", "if(id % 2 = 0, concat('2001:db8:', lower(hex(a)), ':', hex(b), '::', hex(id % 5000)), concat(a + 5, '.', b, '.3.', id % 250)) as ip")


R.add(
    "j20_country_for_address",
    lambda s, d: adr.country_for_address(_addresses(s, d), _nested_networks(s, d)).select("id", "ip", "ip_country"),
    """WITH e AS (SELECT event_id AS id, event_id % 70 AS a, event_id % 9 AS b FROM events),
    n AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer),
    wide6 AS (SELECT k % 60 AS a, min('A' || n) AS c FROM n GROUP BY 1), deep6 AS (SELECT k % 60 AS a, k % 7 AS b, min('B' || n) AS c FROM n GROUP BY 1, 2),
    wide4 AS (SELECT k % 200 + 11 AS a, min('C' || n) AS c FROM n GROUP BY 1), deep4 AS (SELECT k % 200 + 11 AS a, k % 5 AS b, min('D' || n) AS c FROM n GROUP BY 1, 2)
    SELECT e.id, CASE WHEN e.id % 2 = 0 THEN '2001:db8:' || lower(hex(e.a)) || ':' || hex(e.b) || '::' || hex(e.id % 5000) ELSE (e.a + 5) || '.' || e.b || '.3.' || (e.id % 250) END AS ip,
      CASE WHEN e.id % 2 = 0 THEN coalesce(d6.c, w6.c) WHEN e.a + 5 <> 10 THEN coalesce(d4.c, w4.c) END AS ip_country
    FROM e LEFT JOIN wide6 w6 ON w6.a = e.a LEFT JOIN deep6 d6 ON d6.a = e.a AND d6.b = e.b
      LEFT JOIN wide4 w4 ON w4.a = e.a + 5 LEFT JOIN deep4 d4 ON d4.a = e.a + 5 AND d4.b = e.b""",
)
R.add(
    "p10_resolve_country",
    lambda s, d: bill.resolve_country(bill.country_for_ip(src.visits(s, d), src.ip_ranges(s, d))).select(
        "id", "country_code", "resolution_source"
    ),
    f"""SELECT v.id, CASE WHEN trim(header_country) <> '' THEN 'CR' WHEN ip_country IS NOT NULL THEN ip_country
      WHEN time_zone = 'America/Costa_Rica' THEN 'CR' ELSE session_country END AS country_code,
    CASE WHEN trim(header_country) <> '' THEN 'cloudflare' WHEN ip_country IS NOT NULL THEN 'geolite2'
      WHEN time_zone = 'America/Costa_Rica' THEN 'user_time_zone' WHEN session_country IS NOT NULL THEN 'session'
      ELSE 'default_international' END AS resolution_source FROM visits v JOIN ({_IPC}) c ON c.id = v.id""",
)
R.add(
    "p11_money_units",
    lambda s, d: src.carts(s, d).select(
        "id",
        to_major(F.col("list_price_cents"), F.col("currency_mode")).alias("major"),
        to_minor(to_major(F.col("list_price_cents"), F.col("currency_mode")), F.col("currency_mode")).alias("minor"),
    ),
    """SELECT id, CASE WHEN currency_mode = 'usd' THEN list_price_cents / 100.0 ELSE list_price_cents END::DOUBLE AS major,
    CASE WHEN currency_mode = 'usd' THEN list_price_cents ELSE list_price_cents * 100 END AS minor FROM carts""",
)
R.add(
    "p12_plan_end",
    lambda s, d: src.subscriptions(s, d)
    .join(src.users(s, d).selectExpr("id as user_id", "time_zone"), "user_id")
    .select("id", plan_end(F.col("starts_at"), F.col("tier_months"), F.col("time_zone")).alias("plan_end")),
    f"""SELECT s.id, {stamp(PLAN_END.format('starts_at', 'tier_months'))} AS plan_end FROM subscriptions s
    JOIN (SELECT id AS uid, time_zone FROM users) u ON u.uid = s.user_id""",
)
_ACTIVE = f"""SELECT * FROM subscriptions WHERE {SQL_AT} BETWEEN starts_at AND ends_at
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ends_at DESC, id DESC) = 1"""
R.add(
    "j18_active_plan",
    lambda s, d: bill.active_plan(src.users(s, d), src.subscriptions(s, d), AT).select(
        "id", F.coalesce("plan_id", F.lit(-1)).alias("plan_id"), "plan_ends_at"
    ),
    f"""SELECT u.id, coalesce(a.id, -1) AS plan_id, {stamp('a.ends_at')} AS plan_ends_at FROM users u
    LEFT JOIN ({_ACTIVE}) a ON a.user_id = u.id""",
)
R.add(
    "p13_plan_expiry_preview",
    lambda s, d: bill.plan_expiry_preview(src.users(s, d), src.subscriptions(s, d), AT),
    f"""SELECT user_id, tier_months, {stamp(PLAN_END.format('st', 'tier_months'))} AS projected_ends_at FROM (
      SELECT u.id AS user_id, u.time_zone, t.tier_months, coalesce(a.ends_at, {SQL_AT}) AS st FROM users u
      LEFT JOIN ({_ACTIVE}) a ON a.user_id = u.id, (VALUES (1), (2), (4)) AS t(tier_months))""",
)
_AVAIL = f"""SELECT u.id AS user_id, (ok AND a.id IS NOT NULL AND coalesce(50 - g.downloads_used, 50) > 0) AS plan_included,
    (ok AND a.id IS NOT NULL AND coalesce(50 - g.downloads_used, 50) <= 0) AS quota_exhausted
    FROM (SELECT *, confirmed_at IS NOT NULL AND suspended_at IS NULL AS ok FROM users) u
    LEFT JOIN ({_ACTIVE}) a ON a.user_id = u.id
    LEFT JOIN usages g ON g.subscription_id = a.id AND g.period_year = 1997 AND g.period_month = 6"""
R.add(
    "j9_plan_availability",
    lambda s, d: bill.plan_availability(src.users(s, d), src.subscriptions(s, d), src.usages(s, d), AT),
    f"SELECT *, NOT plan_included AS single_checkout_allowed FROM ({_AVAIL})",
)
R.add(
    "j8_can_download",
    lambda s, d: bill.can_download(
        src.downloads(s, d).select("user_id", "nesting_run_id").distinct(),
        src.users(s, d),
        src.runs(s, d),
        src.download_grants(s, d),
        src.subscriptions(s, d),
        src.usages(s, d),
        AT,
    ),
    f"""SELECT q.user_id, q.nesting_run_id, g.id IS NOT NULL AS by_grant, v.plan_included AS by_plan,
    (b.id IS NOT NULL AND (g.id IS NOT NULL OR v.plan_included)) AS can_download
    FROM (SELECT DISTINCT user_id, nesting_run_id FROM downloads) q
    LEFT JOIN (SELECT * FROM users WHERE confirmed_at IS NOT NULL AND suspended_at IS NULL) b ON b.id = q.user_id
    LEFT JOIN (SELECT * FROM download_grants WHERE kind = 'single_purchase' AND retained_until > {SQL_AT}) g
      ON g.user_id = q.user_id AND g.nesting_run_id = q.nesting_run_id
    LEFT JOIN ({_AVAIL}) v ON v.user_id = q.user_id""",
)
R.add(
    "g9_exhausted_quotas",
    lambda s, d: bill.exhausted_quotas(src.usages(s, d), "1996-01-01", "1997-12-31"),
    """SELECT count(*) FILTER (downloads_used >= quota_limit) AS exhausted_quotas FROM usages
    WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1998-01-01'""",
)
_QUOTA = """SELECT x.*, year(downloaded_at) AS period_year, month(downloaded_at) AS period_month,
      row_number() OVER (PARTITION BY plan_id, year(downloaded_at), month(downloaded_at) ORDER BY downloaded_at, id) AS use_no
    FROM (SELECT d.*, s.id AS plan_id FROM downloads d JOIN subscriptions s ON s.user_id = d.user_id
      AND d.downloaded_at BETWEEN s.starts_at AND s.ends_at
      WHERE NOT via_token AND NOT EXISTS (SELECT 1 FROM download_grants g WHERE g.user_id = d.user_id
        AND g.nesting_run_id = d.nesting_run_id AND g.kind = 'single_purchase' AND g.retained_until > d.downloaded_at)
      AND EXISTS (SELECT 1 FROM runs r WHERE r.id = d.nesting_run_id)
      QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY s.ends_at DESC, s.id DESC) = 1) x QUALIFY use_no <= {limit}"""


def _counted(s, d, limit):
    return bill.quota_downloads(src.downloads(s, d), src.download_grants(s, d), src.subscriptions(s, d), src.runs(s, d), limit)


R.add(
    "g12_quota_downloads",
    lambda s, d: _counted(s, d, 50).select("id", "plan_id", "use_no"),
    f"SELECT id, plan_id, use_no FROM ({_QUOTA.format(limit=50)})",
)
R.add(
    "g11_monthly_usage",
    lambda s, d: bill.monthly_usage(_counted(s, d, 50)),
    f"""SELECT plan_id AS subscription_id, period_year, period_month, count(*) AS downloads_used, 50 AS quota_limit,
    50 - count(*) AS remaining, count(*) >= 50 AS exhausted FROM ({_QUOTA.format(limit=50)}) GROUP BY 1, 2, 3""",
)
R.add(
    "w13_extend_subscriptions",
    lambda s, d: bill.extend_subscriptions(
        src.subscriptions(s, d).selectExpr("user_id", "id", "starts_at as paid_at", "tier_months"), src.users(s, d)
    ),
    f"""WITH RECURSIVE buy AS (SELECT user_id, starts_at AS paid_at, tier_months AS t, u.time_zone,
        row_number() OVER (PARTITION BY user_id ORDER BY starts_at, s.id) AS n FROM subscriptions s
        JOIN (SELECT id AS uid, time_zone FROM users) u ON u.uid = s.user_id),
    fold(user_id, n, starts_at, tier_months, ends_at, k, time_zone) AS (
      SELECT user_id, n, paid_at, t, {PLAN_END.format('paid_at', 't')}, 1, time_zone FROM buy WHERE n = 1
      UNION ALL SELECT b.user_id, b.n, CASE WHEN b.paid_at <= f.ends_at THEN f.starts_at ELSE b.paid_at END,
        CASE WHEN b.paid_at <= f.ends_at THEN f.tier_months ELSE b.t END,
        {PLAN_END.format('(CASE WHEN b.paid_at <= f.ends_at THEN f.ends_at ELSE b.paid_at END)', 'b.t').replace('time_zone', 'b.time_zone')},
        CASE WHEN b.paid_at <= f.ends_at THEN f.k + 1 ELSE 1 END, b.time_zone
      FROM fold f JOIN buy b ON b.user_id = f.user_id AND b.n = f.n + 1)
    SELECT user_id, tier_months, {stamp('s0')} AS starts_at, {stamp('e1')} AS ends_at, n_purchases
    FROM (SELECT user_id, any_value(tier_months) AS tier_months, starts_at AS s0, max(ends_at) AS e1, max(k) AS n_purchases
      FROM fold GROUP BY user_id, starts_at)""",
)
R.add(
    "p25_validate_cart",
    lambda s, d: bill.validate_cart(src.carts(s, d)).select("id", "errors"),
    """SELECT id, CASE WHEN (nesting_run_id IS NULL) = (tier_months IS NULL) THEN 'product' ELSE '' END AS errors FROM carts""",
)
R.add(
    "j28_merge_carts",
    lambda s, d: bill.merge_carts(src.carts(s, d), src.logins(s, d)).select(
        "id", F.coalesce("user_id", F.lit(-1)).alias("user_id"), "guest_token"
    ),
    """SELECT id, user_id, guest_token FROM carts WHERE user_id IS NOT NULL
    UNION ALL SELECT g.id, coalesce(l.user_id, -1), CASE WHEN l.user_id IS NULL THEN g.guest_token END FROM carts g
    LEFT JOIN logins l ON l.guest_token = g.guest_token
    WHERE g.user_id IS NULL AND NOT EXISTS (SELECT 1 FROM carts o WHERE o.user_id = l.user_id)""",
)
R.add(
    "j28_lost_carts",
    lambda s, d: bill.lost_carts(src.carts(s, d), src.logins(s, d)).select("id", "user_id", "reason"),
    """SELECT g.id, l.user_id, 'user_has_cart' AS reason FROM carts g JOIN logins l ON l.guest_token = g.guest_token
    WHERE g.user_id IS NULL AND EXISTS (SELECT 1 FROM carts o WHERE o.user_id = l.user_id)""",
)
R.add(
    "w25_current_cart",
    lambda s, d: bill.current_cart(
        src.payments(s, d).selectExpr("id", "if(id % 4 = 0, null, user_id) as user_id", "concat('g-', user_id) as guest_token", "created_at")
    ).select("owner", "id"),
    """SELECT owner, max_by(id, struct_pack(c := created_at, i := id)) AS id FROM (SELECT *,
      CASE WHEN id % 4 = 0 THEN 'g:g-' || user_id ELSE 'u:' || user_id END AS owner FROM payments) GROUP BY 1""",
)
