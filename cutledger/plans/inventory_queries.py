"""Registered queries over stocks, layers, checks and table rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutledger.operators import inventory as inv
from cutledger.operators import quality as qa
from cutledger.plans.oracle import stamp
from cutledger.plans.registry import Registry
from cutledger.session import shared_path
from cutledger.sources import documents as docs
from cutledger.sources import driver as src
from cutledger.sources import tables as tab
from cutledger.sources.versioned import VersionedTable

R = Registry()

R.add(
    "w1_consumption_rank",
    lambda s, d: inv.consumption_rank(src.stocks(s, d)).select("project_id", "id", "consumption_rank"),
    """SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY quantity IS NULL, sort_order, id) - 1
    AS consumption_rank FROM stocks""",
)
R.add(
    "x7_finite_then_unlimited",
    lambda s, d: inv.finite_then_unlimited(src.stocks(s, d)).select("project_id", "id", F.coalesce("quantity", F.lit(-1)).alias("quantity")),
    "SELECT project_id, id, coalesce(quantity, -1) AS quantity FROM stocks",
)
R.add(
    "g29_stock_violations",
    lambda s, d: inv.stock_violations(src.stocks(s, d)),
    """SELECT project_id, n_stocks, n_unlimited, 'unlimited_not_last' AS violation FROM (SELECT project_id, count(*) AS n_stocks,
      count(*) FILTER (quantity IS NULL) AS n_unlimited, max(sort_order) AS m, max(sort_order) FILTER (quantity IS NULL) AS u
      FROM stocks GROUP BY 1) WHERE n_unlimited = 1 AND u <> m""",
)
R.add(
    "w24_keep_one_stock",
    lambda s, d: inv.keep_one_stock(src.stocks(s, d), keep_id=7).select("project_id", "id"),
    """SELECT project_id, id FROM stocks QUALIFY row_number() OVER (PARTITION BY project_id
      ORDER BY id = 7 DESC, sort_order, id) = 1""",
)
R.add(
    "r3_expand_bins",
    lambda s, d: inv.expand_bins(
        src.stocks(s, d), src.pieces(s, d).groupBy("project_id").agg(F.count("*").alias("bins_needed"))
    ).select("project_id", "id", "copy_no"),
    """SELECT s.project_id, s.id, c AS copy_no FROM stocks s LEFT JOIN (SELECT project_id, count(*) AS n FROM pieces GROUP BY 1) p
      ON p.project_id = s.project_id, unnest(range(1, 1 + coalesce(s.quantity, p.n, 0))) AS t(c)""",
)
R.add(
    "j15_without_drafts",
    lambda s, d: inv.without_drafts(
        src.proposals(s, d), src.resolutions(s, d), src.layers(s, d).selectExpr("project_id as id")
    ).select("id", "status"),
    """SELECT id, status FROM proposals WHERE NOT (status = 'draft' AND orphan_resolution_id IN
      (SELECT id FROM resolutions WHERE project_id IN (SELECT project_id FROM layers)))""",
)
R.add(
    "j16_stale_rows",
    lambda s, d: inv.stale_rows(
        src.layers(s, d), src.layers(s, d).where("included").select("attachment_id").distinct(), ["attachment_id"]
    ).select("id", F.coalesce("attachment_id", F.lit(-1)).alias("attachment_id")),
    """SELECT id, coalesce(attachment_id, -1) AS attachment_id FROM layers l WHERE NOT EXISTS (SELECT 1 FROM layers k
      WHERE k.included AND k.attachment_id = l.attachment_id)""",
)
R.add(
    "x3_key_difference",
    lambda s, d: inv.key_difference(
        src.layers(s, d).where("attachment_id is not null"), src.layers(s, d).where("included"), ["project_id", "attachment_id"]
    ),
    """SELECT project_id, attachment_id FROM layers WHERE attachment_id IS NOT NULL
    EXCEPT SELECT project_id, attachment_id FROM layers WHERE included""",
)
R.add(
    "x5_either",
    lambda s, d: inv.either(
        src.layers(s, d), F.col("attachment_id").isNull(), F.col("attachment_id") > 300
    ).select("id"),
    "SELECT id FROM layers WHERE attachment_id IS NULL OR attachment_id > 300",
)
R.add(
    "x6_distinct_parents",
    lambda s, d: inv.distinct_parents(src.derived(s, d)),
    "SELECT DISTINCT project_id, parent_piece_key FROM derived",
)
R.add(
    "g32_project_snapshot",
    lambda s, d: inv.project_snapshot(src.projects(s, d), src.stocks(s, d), src.layers(s, d)).select(
        "project_id", "part", F.coalesce("layers_count", F.lit(-1)).alias("layers_count"), "width_mm",
        F.coalesce("quantity", F.lit(-1)).alias("quantity"), "layer_name",
    ),
    """SELECT p.id AS project_id, 'project' AS part, coalesce(n, 0) AS layers_count, NULL::DOUBLE AS width_mm, -1 AS quantity,
      NULL AS layer_name FROM (SELECT o_orderkey AS id FROM orders) p LEFT JOIN (SELECT project_id, count(*) AS n FROM layers GROUP BY 1) l ON l.project_id = p.id
    UNION ALL SELECT project_id, 'stock', -1, width_mm, coalesce(quantity, -1), NULL FROM stocks
    UNION ALL SELECT DISTINCT project_id, 'layer', -1, NULL, -1, layer_name FROM layers
      WHERE included AND project_id IN (SELECT o_orderkey FROM orders)""",
)


def _primary(s, d):
    clicks = src.layers(s, d).where("layer_role is null").selectExpr(
        "project_id", "attachment_id", "id as layer_id", "timestamp_seconds(id % 97) as set_at"
    )
    return inv.primary_layer(src.layers(s, d), clicks)


R.add(
    "w19_primary_layer",
    lambda s, d: _primary(s, d).select("id", "layer_role", "included"),
    """SELECT l.id, CASE WHEN w.id = l.id THEN 'primary' WHEN w.id IS NOT NULL AND layer_role = 'primary' THEN NULL
      ELSE layer_role END AS layer_role, included OR coalesce(w.id = l.id, false) AS included
    FROM layers l LEFT JOIN (SELECT project_id AS pid, attachment_id AS aid, id FROM layers
      WHERE layer_role IS NULL AND attachment_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY project_id, attachment_id ORDER BY id % 97 DESC, id DESC) = 1) w
      ON w.pid = l.project_id AND w.aid = l.attachment_id""",
)
R.add(
    "f14_gap_layers",
    lambda s, d: inv.gap_layers(src.layers(s, d)).select("id"),
    "SELECT id FROM layers WHERE layer_role = 'primary' OR (layer_role IS NULL AND included)",
)
_COUNTING = """SELECT * FROM layers l WHERE included AND (layer_role = 'primary' OR NOT EXISTS (SELECT 1 FROM layers k
    WHERE k.included AND k.layer_role = 'primary' AND k.attachment_id = l.attachment_id AND k.project_id = l.project_id))"""
R.add(
    "f18_counting_layers",
    lambda s, d: inv.counting_layers(
        src.layers(s, d).where("attachment_id is not null"), ["project_id", "attachment_id"]
    ).select("id"),
    f"SELECT id FROM ({_COUNTING}) WHERE attachment_id IS NOT NULL",
)
_MISSING = """SELECT project_id, attachment_id FROM layers WHERE included AND attachment_id IS NOT NULL GROUP BY 1, 2
    HAVING bool_or(coalesce(layer_role = 'auxiliary', false)) AND NOT bool_or(coalesce(layer_role = 'primary', false))"""
R.add("j12_missing_primary", lambda s, d: inv.missing_primary(src.layers(s, d)), _MISSING)
_GAPS = """SELECT l.id, l.project_id, l.layer_role, l.included,
    coalesce(bool_or(distance_mm > 2 AND distance_mm <= 15), false) AS warnable,
    coalesce(bool_or(distance_mm > 15), false) AS ignored, max(distance_mm) FILTER (distance_mm > 2 AND distance_mm <= 15)
      AS max_warnable_mm, coalesce(bool_and(distance_mm <= 15), true) AS auto_closeable,
    coalesce(bool_or(distance_mm > 2 AND distance_mm <= 15), false) AND NOT l.auto_close_gaps AS unresolved
    FROM layers l LEFT JOIN layer_gaps g ON g.id = l.id
    GROUP BY l.id, l.project_id, l.layer_role, l.included, l.auto_close_gaps"""
R.add(
    "g20_gap_report",
    lambda s, d: inv.gap_report(src.layers(s, d)).select(
        "id", "warnable", "ignored", "max_warnable_mm", "auto_closeable", "unresolved"
    ),
    f"SELECT id, warnable, ignored, max_warnable_mm, auto_closeable, unresolved FROM ({_GAPS})",
)
R.add(
    "p19_gap_class",
    lambda s, d: src.layers(s, d).select("id", F.explode("gaps_detected").alias("g")).groupBy(
        inv.gap_class(F.col("g.distance_mm")).alias("gap_class")
    ).agg(F.count("*").alias("n"), F.max("g.distance_mm").alias("widest")),
    """SELECT CASE WHEN distance_mm <= 2 THEN 'silent' WHEN distance_mm <= 15 THEN 'consent' ELSE 'ignored' END AS gap_class,
    count(*) AS n, max(distance_mm) AS widest FROM layer_gaps GROUP BY 1""",
)
R.add(
    "r6_auto_close",
    lambda s, d: inv.auto_close(src.layers(s, d)).select(
        "layer_id", "gap_no", "gap_class", "distance_mm", F.get(F.get("segment", 1), 0).alias("end_x")
    ),
    """SELECT g.id AS layer_id, gap_no - 1 AS gap_no, CASE WHEN distance_mm <= 2 THEN 'silent' ELSE 'consent' END AS gap_class,
    distance_mm, gap_no + 1.0::DOUBLE AS end_x FROM layer_gaps g JOIN layers l ON l.id = g.id
    WHERE distance_mm <= 2 OR (distance_mm <= 15 AND auto_close_gaps)""",
)
R.add(
    "g19_readiness",
    lambda s, d: inv.readiness(src.projects(s, d), src.stocks(s, d), src.layers(s, d), src.layer_pieces(s, d)),
    f"""SELECT p.id AS project_id, coalesce(m.n, 0) AS files_without_primary, concat_ws(',',
      CASE WHEN NOT coalesce(f.sel, false) THEN 'no_layers_selected' END,
      CASE WHEN coalesce(m.n, 0) > 0 THEN 'primary_layer_required' END,
      CASE WHEN f.sel AND coalesce(c.n, 0) = 0 THEN 'no_extractable_pieces' END,
      CASE WHEN f.sel AND coalesce(g.u, false) THEN 'unresolved_gaps' END) AS errors
    FROM (SELECT o_orderkey AS id FROM orders) p
    LEFT JOIN (SELECT project_id, bool_or(included) AS sel FROM layers GROUP BY 1) f ON f.project_id = p.id
    LEFT JOIN (SELECT project_id, count(*) AS n FROM ({_MISSING}) GROUP BY 1) m ON m.project_id = p.id
    LEFT JOIN (SELECT project_id, bool_or(unresolved) AS u FROM ({_GAPS})
      WHERE layer_role = 'primary' OR (layer_role IS NULL AND included) GROUP BY 1) g ON g.project_id = p.id
    LEFT JOIN (SELECT x.project_id, count(*) AS n FROM (SELECT x.*, max(attachment_id) OVER (PARTITION BY x.project_id) IS NULL AS unfiled
        FROM ({_COUNTING}) x) x JOIN lineitem ON l_partkey = x.id AND l_returnflag = 'A'
      WHERE x.attachment_id IS NOT NULL OR x.unfiled GROUP BY 1) c ON c.project_id = p.id""",
)
R.add(
    "s10_validate_uploads",
    lambda s, d: docs.validate_uploads(src.uploads(s, d)).select("id", "errors"),
    """SELECT page_id AS id, concat_ws(',', CASE WHEN big THEN 'too_large' END, CASE WHEN page_id % 2 <> 0 THEN 'invalid_extension' END,
      CASE WHEN NOT big AND NOT contains(substr(body, 1, 1024), 'SECTION') THEN 'corrupt_dxf' END) AS errors
    FROM (SELECT page_id, body, page_id % 50 = 0 AND strlen(body) * 100000 > 10485760 AS big FROM
      (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '0 SECTION ' || html ELSE html END AS body FROM pages))""",
)
R.add(
    "f6_search_users",
    lambda s, d: inv.search_users(src.users(s, d), " USER1").select("id", "email"),
    "SELECT id, email FROM users WHERE contains(lower(email), 'user1') OR contains(lower(name), 'user1')",
)
R.add(
    "f8_filter_feedback",
    lambda s, d: inv.filter_feedback(src.feedbacks(s, d), "reviewed", "bug").select("id", "created_at"),
    f"SELECT id, {stamp('created_at')} AS created_at FROM feedbacks WHERE status = 'reviewed' AND feedback_type = 'bug'",
)
R.add(
    "p24_validate_feedback",
    lambda s, d: inv.validate_feedback(src.feedbacks(s, d)).select("id", "email", "errors"),
    """SELECT id, e AS email, concat_ws(',', CASE WHEN feedback_type = 'praise' THEN 'feedback_type' END,
      CASE WHEN length(m) < 5 THEN 'message_too_short' END, CASE WHEN length(m) > 5000 THEN 'message_too_long' END,
      CASE WHEN user_id IS NULL AND e IS NULL THEN 'email_required' END) AS errors
    FROM (SELECT *, CASE WHEN user_id IS NULL THEN lower(trim(email)) END AS e, trim(message, ' ') AS m FROM feedbacks)""",
)
R.add(
    "j2_orphan_blobs",
    lambda s, d: inv.orphan_blobs(src.blobs(s, d), src.attachments(s, d)).select("id", "byte_size"),
    "SELECT doc_id AS id, n_chars AS byte_size FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
R.add(
    "p27_validate_projects",
    lambda s, d: qa.validate_rows(src.projects(s, d), "projects").select("id", "errors"),
    """SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_orderkey % 43 = 0 THEN 'title' END,
      CASE WHEN o_custkey % 5 = 0 THEN 'kerf_mm' END, CASE WHEN o_orderkey % 12 = 0 THEN 'curve_tolerance_mm' END) AS errors
    FROM orders""",
)
R.add(
    "p27_validate_stocks",
    lambda s, d: qa.validate_rows(
        src.stocks(s, d).withColumn("quantity", F.expr("quantity - 1")), "sheet_stocks"
    ).select("id", "errors"),
    "SELECT id, CASE WHEN quantity = 1 THEN 'quantity' ELSE '' END AS errors FROM stocks",
)
R.add(
    "p27_validate_subscriptions",
    lambda s, d: qa.validate_rows(
        src.subscriptions(s, d).withColumn("ends_at", F.expr("if(id % 8 = 0, starts_at, ends_at)")), "subscriptions"
    ).select("id", "errors"),
    "SELECT id, CASE WHEN id % 8 = 0 THEN 'ends_at' ELSE '' END AS errors FROM subscriptions",
)
R.add(
    "p27_validate_usages",
    lambda s, d: qa.validate_rows(
        src.usages(s, d).withColumn("quota_limit", F.lit(20)), "plan_monthly_usages"
    ).groupBy("errors").agg(F.count("*").alias("n")),
    """SELECT CASE WHEN downloads_used > 20 THEN 'downloads_used' ELSE '' END AS errors, count(*) AS n FROM usages
    GROUP BY 1""",
)
R.add(
    "j31_broken_links",
    lambda s, d: qa.broken_links(
        {
            "payments": src.payments(s, d),
            "users": src.users(s, d).where("suspended_at is null"),
            "subscriptions": src.subscriptions(s, d),
            "plan_monthly_usages": src.usages(s, d),
            "user_events": src.user_events(s, d),
        }
    ).groupBy("child", "link").agg(F.count("*").alias("n"), F.countDistinct("missing_id").alias("n_missing")),
    """SELECT child, link, count(*) AS n, count(DISTINCT k) AS n_missing FROM (
      SELECT 'payments' AS child, 'user_id' AS link, user_id AS k FROM payments WHERE user_id NOT IN (SELECT id FROM users WHERE suspended_at IS NULL)
      UNION ALL SELECT 'subscriptions', 'user_id', user_id FROM subscriptions WHERE user_id NOT IN (SELECT id FROM users WHERE suspended_at IS NULL)
      UNION ALL SELECT 'user_events', 'user_id', user_id FROM user_events WHERE user_id NOT IN (SELECT id FROM users WHERE suspended_at IS NULL)
      UNION ALL SELECT 'plan_monthly_usages', 'subscription_id', subscription_id FROM usages WHERE subscription_id NOT IN (SELECT id FROM subscriptions)
      UNION ALL SELECT 'payments', 'subscription_id', subscription_id FROM payments WHERE subscription_id NOT IN (SELECT id FROM subscriptions))
    GROUP BY 1, 2""",
)
R.add(
    "g33_duplicate_keys",
    lambda s, d: qa.duplicate_keys(src.user_events(s, d), ["idempotency_key"], "idempotency_key is not null"),
    """SELECT idempotency_key, count(*) AS n FROM user_events WHERE idempotency_key IS NOT NULL GROUP BY 1
    HAVING count(*) > 1""",
)
for _name, _table, _keys in (
    ("grants", src.download_grants, "user_id, nesting_run_id"),
    ("usages", src.usages, "subscription_id, period_year, period_month"),
    ("carts_of_users", src.carts, "user_id"),
    ("carts_of_guests", src.carts, "guest_token"),
    ("resolutions", src.resolutions, "project_id, piece_key"),
):
    _all = [k.strip() for k in _keys.split(",")]
    _given = " AND ".join(f"{k} IS NOT NULL" for k in _all)
    _view = {"grants": "download_grants"}.get(_name, _name.split("_")[0])
    R.add(
        f"g33_{_name}",
        lambda s, d, t=_table, k=_all, w=_given: qa.duplicate_keys(t(s, d), k, w).groupBy("n").agg(F.count("*").alias("n_keys")),
        f"""SELECT n, count(*) AS n_keys FROM (SELECT {_keys}, count(*) AS n FROM {_view} WHERE {_given} GROUP BY {_keys} HAVING count(*) > 1)
        GROUP BY n""",
    )
R.add(
    "s11_upsert",
    lambda s, d: tab.upsert(
        src.payments(s, d).select("id", "status"),
        src.gateway_events(s, d).where("type = 'payment-intent.succeeded'")
        .selectExpr("cast(substr(payment_intent_id, 4) as bigint) as id", "'succeeded' as status").distinct(),
        ["id"],
    ),
    """WITH good AS (SELECT DISTINCT CAST(substr(payment_intent_id, 4) AS BIGINT) AS k FROM gateway_events
      WHERE type = 'payment-intent.succeeded')
    SELECT id, status FROM payments WHERE id NOT IN (SELECT k FROM good) UNION ALL SELECT k, 'succeeded' FROM good""",
)


def _written(s, d):
    """The same upsert against a stored, versioned table, rewriting only the touched partitions."""
    table = VersionedTable(s, shared_path(s, "payments"))
    rows = src.payments(s, d).select("id", "status", "currency")
    table.create(rows, "currency")
    tab.write_upsert(table.root, rows.where("currency = 'usd' and status = 'failed'").withColumn("status", F.lit("pending")), ["id"])
    return table


R.add(
    "s11_write_upsert",
    lambda s, d: _written(s, d).read(),
    """SELECT id, CASE WHEN currency = 'usd' AND status = 'failed' THEN 'pending' ELSE status END AS status, currency
    FROM payments""",
)


R.add(
    "s11_changed_rows",
    lambda s, d: (t := _written(s, d)).read().exceptAll(t.read(0)).groupBy("currency", "status").agg(F.count("*").alias("n")),
    "SELECT currency, 'pending' AS status, count(*) AS n FROM payments WHERE currency = 'usd' AND status = 'failed' GROUP BY currency",
)


def _cascade(s, d):
    doomed = src.projects(s, d).where("kerf_mm < 0").select("id")
    left = tab.cascade_delete(
        {
            "projects": src.projects(s, d),
            "sheet_stocks": src.stocks(s, d),
            "orphan_resolutions": src.resolutions(s, d),
            "split_proposals": src.proposals(s, d),
        },
        "projects",
        doomed,
    )
    parts = [df.select(F.lit(n).alias("table_name"), "id") for n, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_DOOMED = "SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 0"
R.add(
    "s12_cascade_delete",
    _cascade,
    f"""SELECT 'projects' AS table_name, o_orderkey AS id FROM orders WHERE o_custkey % 5 <> 0
    UNION ALL SELECT 'sheet_stocks', id FROM stocks WHERE project_id NOT IN ({_DOOMED})
    UNION ALL SELECT 'orphan_resolutions', id FROM resolutions WHERE project_id NOT IN ({_DOOMED})
    UNION ALL SELECT 'split_proposals', id FROM proposals WHERE orphan_resolution_id NOT IN
      (SELECT id FROM resolutions WHERE project_id IN ({_DOOMED}))""",
)


def _erased(s, d):
    left = tab.erase_users(
        {"payments": src.payments(s, d), "user_events": src.user_events(s, d), "users": src.users(s, d)},
        src.users(s, d).where("suspended_at is not null"),
    )
    out = left["payments"].select(F.lit("payments").alias("t"), "id", "user_id")
    out = out.unionByName(left["user_events"].select(F.lit("user_events").alias("t"), "id", "user_id"))
    return out.unionByName(left["users"].select(F.lit("users").alias("t"), "id", F.col("id").alias("user_id")))


R.add(
    "s13_erase_users",
    lambda s, d: _erased(s, d).withColumn("user_id", F.coalesce("user_id", F.lit(-1))),
    """WITH gone AS (SELECT id AS g FROM users WHERE suspended_at IS NOT NULL)
    SELECT 'payments' AS t, id, user_id FROM payments WHERE user_id NOT IN (SELECT g FROM gone)
    UNION ALL SELECT 'users', id, id FROM users WHERE id NOT IN (SELECT g FROM gone)
    UNION ALL SELECT 'user_events', id, CASE WHEN user_id IN (SELECT g FROM gone) THEN -1 ELSE coalesce(user_id, -1) END
    FROM user_events""",
)
