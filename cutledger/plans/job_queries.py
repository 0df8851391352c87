"""Registered queries over cutting jobs and their documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutledger.operators import jobs
from cutledger.plans.oracle import stamp
from cutledger.plans.registry import Registry
from cutledger.session import shared_path
from cutledger.sources import documents as docs
from cutledger.sources import driver as src
from cutledger.sources import schemas

R = Registry()
NOW = "2024-02-01"


def _stored_runs(s, d):
    root = shared_path(s, "scan")
    schemas.store(src.runs(s, d), root, "nesting_runs")
    return schemas.load(s, root, "nesting_runs")


R.add(
    "s1_table_scan",
    lambda s, d: _stored_runs(s, d).groupBy("status").agg(F.count("*").alias("n"), F.max("created_at").alias("newest")),
    f"SELECT status, count(*) AS n, {stamp('max(created_at)')} AS newest FROM runs GROUP BY 1",
)

for _name, _rows, _view in (
    ("user_events", src.user_events, "user_events"),
    ("payments", src.payments, "payments"),
    ("subscriptions", src.subscriptions, "subscriptions"),
    ("download_grants", src.download_grants, "download_grants"),
    ("carts", src.carts, "carts"),
    ("users", src.users, "users"),
    ("feedbacks", src.feedbacks, "feedbacks"),
    ("sheet_stocks", src.stocks, "stocks"),
    ("project_layers", src.layers, "layers"),
    ("orphan_resolutions", src.resolutions, "resolutions"),
    ("split_proposals", src.proposals, "proposals"),
    ("derived_pieces", src.derived, "derived"),
):

    def _stored(s, d, name=_name, rows=_rows):
        root = shared_path(s, "scan")
        schemas.store(rows(s, d), root, name)
        found = schemas.load(s, root, name)
        return found.agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.max("id").alias("top"))

    R.add(f"s1_scan_{_name}", _stored, f"SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, max(id) AS top FROM {_view}")


for _name, _rows, _columns, _view in (
    ("plan_monthly_usages", src.usages, ("subscription_id", "downloads_used"), "usages"),
    ("projects", src.projects, ("id", "nesting_time_limit_sec"), "(SELECT o_orderkey AS id, 600 AS nesting_time_limit_sec FROM orders)"),
    ("blobs", src.blobs, ("id", "byte_size"), "(SELECT doc_id AS id, n_chars AS byte_size FROM documents)"),
    ("attachments", src.attachments, ("id", "blob_id"), "(SELECT doc_id AS id, doc_id AS blob_id FROM labels)"),
):

    def _scanned(s, d, name=_name, rows=_rows, columns=_columns):
        root = shared_path(s, "scan")
        schemas.store(rows(s, d), root, name)
        found = schemas.load(s, root, name)
        return found.agg(F.count("*").alias("n"), *[F.sum(c).cast("bigint").alias(f"sum_{c}") for c in columns])

    _sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS sum_{c}" for c in _columns)
    R.add(f"s1_scan_{_name}", _scanned, f"SELECT count(*) AS n, {_sums} FROM {_view}")


def _report_docs(s, d):
    text = F.when(F.col("id") % 37 == 0, F.lit("{broken")).otherwise(F.to_json("report"))
    return docs.parse_reports(src.runs(s, d).select("id", text.alias("report_json")))


R.add(
    "s2_run_reports",
    lambda s, d: _report_docs(s, d).select(
        "id",
        "report.status",
        F.coalesce(F.size("report.orphans"), F.lit(-1)).alias("n_orphans"),
        F.coalesce("report.sheets_used", F.lit(-1)).alias("sheets_used"),
    ),
    """SELECT id, CASE WHEN id % 37 <> 0 THEN report_status END AS status,
    CASE WHEN id % 37 = 0 THEN -1 ELSE n_orphans END AS n_orphans,
    CASE WHEN id % 37 <> 0 AND id % 6 = 0 THEN 2 ELSE -1 END AS sheets_used FROM runs""",
)
R.add(
    "s3_explode_placements",
    lambda s, d: docs.explode_placements(src.placement_docs(s, d)).select(
        "run_id", "sheet_index", "piece_index", "x_mm", "y_mm", "rotation_deg"
    ),
    "SELECT run_id, sheet_index, piece_index, x_mm, y_mm, rotation_deg FROM doc_pieces",
)


def _progress(s, d):
    return docs.read_progress(src.progress(s, d))


R.add(
    "s4_read_progress",
    lambda s, d: _progress(s, d).select("id", "run_id", "version", "phase_id", "percent", "message_key", "eta_sec"),
    """SELECT id, run_id, version, phase_id, percent, 'nesting.phase.' || phase_id AS message_key, eta_sec
    FROM valid_progress""",
)
R.add(
    "f13_downloadable_runs",
    lambda s, d: jobs.downloadable_runs(src.runs(s, d)).select("id", "status"),
    "SELECT id, status FROM runs WHERE status IN ('completed', 'partial')",
)
R.add(
    "p14_map_status",
    lambda s, d: jobs.map_status(src.runs(s, d)).select("id", "mapped_status"),
    """SELECT id, CASE WHEN exit_code <> 0 THEN CASE WHEN has_output AND report_status IN ('partial','completed')
      THEN 'partial' ELSE 'failed' END WHEN report_status = 'unknown' THEN 'failed' ELSE report_status END
      AS mapped_status FROM runs""",
)
_MS = f"CAST((epoch_us(coalesce(finished_at, TIMESTAMP '{NOW}')) - epoch_us(started_at)) // 1000 AS BIGINT)"
R.add(
    "p15_duration_ms",
    lambda s, d: src.runs(s, d).select("id", jobs.duration_ms(NOW).alias("ms")),
    f"SELECT id, coalesce({_MS}, 0) AS ms FROM runs",
)
R.add(
    "p16_fill_percent",
    lambda s, d: _progress(s, d).select("id", jobs.fill_percent(F.col("pieces_placed"), F.col("pieces_total")).alias("pct")),
    """SELECT id, least(55, 12 + CAST(floor(43 * least(1.0, pieces_placed / pieces_total)) AS INTEGER)) AS pct
    FROM valid_progress""",
)


def _with_start(s, d):
    p = _progress(s, d)
    return p.join(p.groupBy("run_id").agg(F.min("at").alias("started_at")), "run_id")


R.add(
    "p17_eta",
    lambda s, d: _with_start(s, d).select(
        "id",
        jobs.eta(F.col("started_at"), F.col("at"), F.lit(600), F.col("pieces_placed"), F.col("pieces_total")).alias("eta"),
    ),
    f"""SELECT id, {stamp('e')} AS eta FROM (SELECT id, CASE WHEN pieces_placed > 0 AND t_at > st THEN
      least(st + to_microseconds(CAST(round((epoch_us(t_at) - epoch_us(st)) / greatest(pieces_placed / pieces_total, 0.01)) AS BIGINT)),
        st + INTERVAL 600 SECOND) ELSE st + INTERVAL 600 SECOND END AS e
      FROM (SELECT *, min(t_at) OVER (PARTITION BY run_id) AS st FROM valid_progress))""",
)
R.add(
    "g15_orphans_by_reason",
    lambda s, d: jobs.orphans_by_reason(src.runs(s, d)),
    "SELECT run_id, reason, count(*) AS n FROM run_orphans GROUP BY 1, 2",
)
R.add(
    "g16_run_sizes",
    lambda s, d: jobs.run_sizes(src.placement_docs(s, d)),
    "SELECT run_id, count(*) AS sheets_used, sum(n_pieces)::BIGINT AS pieces_placed FROM doc_sheets GROUP BY 1",
)
R.add(
    "g17_duration_p95",
    lambda s, d: jobs.duration_p95(src.runs(s, d), NOW).withColumn("p95_ms", F.round("p95_ms", 3)),
    f"""SELECT round(quantile_cont({_MS}, 0.95), 3) AS p95_ms, quantile_cont({_MS}, 0.95) > 600000 AS alert FROM runs
    WHERE started_at IS NOT NULL""",
)
R.add(
    "w2_latest_run",
    lambda s, d: jobs.latest_run(src.runs(s, d)).select("project_id", "id", "status"),
    """SELECT project_id, id, status FROM runs
    QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) = 1""",
)
R.add(
    "w4_latest_proposal",
    lambda s, d: jobs.latest_proposal(src.proposals(s, d)).select("orphan_resolution_id", "id", "version", "status"),
    """SELECT orphan_resolution_id, id, version, status FROM proposals
    QUALIFY row_number() OVER (PARTITION BY orphan_resolution_id ORDER BY version DESC, id DESC) = 1""",
)


def _cards(s, d):
    wide = src.runs(s, d).withColumn("project_id", F.col("id") % 500)
    return jobs.orphan_cards(
        jobs.run_orphans(jobs.latest_run(wide)), src.resolutions(s, d), src.proposals(s, d), src.derived(s, d)
    )


R.add(
    "j11_orphan_cards",
    lambda s, d: _cards(s, d).select(
        "project_id", "piece_index", "piece_key", "reason", "resolution_state",
        F.coalesce("proposal_id", F.lit(-1)).alias("proposal_id"),
    ),
    """SELECT o.project_id, o.piece_index, CAST(o.piece_index AS VARCHAR) AS piece_key, o.reason,
      coalesce(r.resolution_state, 'pending') AS resolution_state, coalesce(p.id, -1) AS proposal_id
    FROM (SELECT r.id % 500 AS project_id, x.piece_index, x.reason FROM run_orphans x JOIN runs r ON r.id = x.run_id
      WHERE r.id IN (SELECT id FROM runs QUALIFY row_number() OVER (PARTITION BY id % 500 ORDER BY created_at DESC, id DESC) = 1)) o
    LEFT JOIN resolutions r ON r.project_id = o.project_id AND r.piece_key = CAST(o.piece_index AS VARCHAR)
    LEFT JOIN (SELECT * FROM proposals QUALIFY row_number() OVER (PARTITION BY orphan_resolution_id ORDER BY version DESC) = 1) p
      ON p.orphan_resolution_id = r.id
    WHERE r.resolution_state IS DISTINCT FROM 'resolved' OR EXISTS (SELECT 1 FROM derived d
      WHERE d.project_id = o.project_id AND d.parent_piece_key = CAST(o.piece_index AS VARCHAR))""",
)


def _failed(s, d):
    queue = src.table(s, d, "orders").selectExpr(
        "o_orderkey as id",
        "if(o_orderpriority like '5%', 'TrackEventJob', 'NestingJob') as class_name",
        """if(o_orderkey % 10 = 0, '[oops', concat('{"job_class":"NestingJob","arguments":[', o_orderkey, ']}')) as arguments""",
        "o_orderpriority",
    )
    failed = queue.where("o_orderpriority like '1%' or o_orderpriority like '5%'").selectExpr("id as job_id")
    return jobs.failed_job_runs(failed, queue, src.runs(s, d))


R.add(
    "j30_failed_job_runs",
    lambda s, d: _failed(s, d).select("id"),
    """SELECT r.id FROM runs r JOIN orders o ON o.o_orderkey = r.id WHERE r.status = 'processing'
    AND o.o_orderpriority LIKE '1%' AND r.id % 10 <> 0""",
)
R.add(
    "w21_abandoned_runs",
    lambda s, d: jobs.abandoned_runs(src.runs(s, d), "2024-01-20").select("id"),
    """SELECT id FROM runs WHERE status = 'processing' AND NOT has_output
    AND coalesce(started_at, created_at) <= TIMESTAMP '2024-01-20' - INTERVAL 90 SECOND""",
)
R.add(
    "w22_project_status",
    lambda s, d: jobs.project_status(src.runs(s, d).selectExpr("project_id as id").distinct(), src.runs(s, d)),
    """SELECT project_id AS id, status, CASE WHEN c THEN 0 ELSE 100 END AS progress_percent,
      CASE WHEN c THEN 'nesting.cancelled' ELSE 'nesting.' || status END AS progress_message
    FROM (SELECT *, cancel_requested_at IS NOT NULL OR warned_cancelled AS c FROM runs
      QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) = 1) WHERE status <> 'processing'""",
)
R.add(
    "j32_completed_events",
    lambda s, d: jobs.completed_events(src.runs(s, d), src.placement_docs(s, d), src.user_events(s, d), NOW).select(
        "run_id", "status", "duration_ms", "sheets_used", "pieces_count", "orphans_oversized", "orphans_no_capacity",
        F.coalesce("user_id", F.lit(-1)).alias("user_id"),
    ),
    f"""WITH hit AS (SELECT r.id AS run_id, e.id AS eid, e.user_id FROM runs r ASOF JOIN user_events e
        ON r.project_id = e.project_id AND coalesce(r.started_at, r.created_at) >= e.occurred_at),
      late AS (SELECT r.id AS run_id, e.user_id FROM (SELECT *, coalesce(finished_at, TIMESTAMP '{NOW}') AS fb FROM runs) r
        ASOF JOIN (SELECT * FROM user_events WHERE event_type IN ('workspace_started','first_dxf_uploaded')) e
        ON r.project_id = e.project_id AND r.fb >= e.occurred_at WHERE r.fb > coalesce(r.started_at, r.created_at))
    SELECT r.id AS run_id, r.status, coalesce({_MS}, 0) AS duration_ms,
      CASE WHEN r.id % 6 = 0 THEN 2 ELSE s.n END AS sheets_used, CASE WHEN r.id % 6 = 0 THEN 9 ELSE s.p END AS pieces_count,
      coalesce(o.a, 0) AS orphans_oversized, coalesce(o.b, 0) AS orphans_no_capacity,
      coalesce(CASE WHEN h.eid IS NULL THEN l.user_id ELSE h.user_id END, -1) AS user_id
    FROM runs r JOIN (SELECT run_id, count(*) AS n, sum(n_pieces)::BIGINT AS p FROM doc_sheets GROUP BY 1) s ON s.run_id = r.id
    LEFT JOIN (SELECT run_id, count(*) FILTER (reason = 'oversized_for_sheet') AS a,
      count(*) FILTER (reason = 'no_sheet_capacity') AS b FROM run_orphans GROUP BY 1) o ON o.run_id = r.id
    LEFT JOIN hit h ON h.run_id = r.id LEFT JOIN late l ON l.run_id = r.id WHERE r.status <> 'processing'""",
)
R.add(
    "w8_monotonic_progress",
    lambda s, d: jobs.monotonic_progress(_progress(s, d)).select("run_id", "id", "percent"),
    """SELECT run_id, id, percent FROM (SELECT *, max(percent) OVER (PARTITION BY run_id ORDER BY t_at, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM valid_progress) WHERE top IS NULL OR percent >= top""",
)
R.add(
    "w9_monotonic_eta",
    lambda s, d: jobs.monotonic_eta(_progress(s, d)).select("id", "estimated_finished_at"),
    f"""SELECT id, {stamp('e')} AS estimated_finished_at FROM (SELECT id, min(t_at + to_seconds(eta_sec)) OVER
      (PARTITION BY run_id ORDER BY t_at, id ROWS UNBOUNDED PRECEDING) AS e FROM valid_progress)""",
)
R.add(
    "w10_ewma_eta",
    lambda s, d: jobs.ewma_eta(_with_start(s, d)).select(
        "id", F.floor(F.col("smoothed") * 1e6 + 0.2718281).alias("smoothed_ppm"), F.coalesce("eta_sec_smoothed", F.lit(-1)).alias("eta")
    ),
    """WITH RECURSIVE seq AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t_at, id) AS n FROM (SELECT *,
        min(t_at) OVER (PARTITION BY run_id) AS st FROM valid_progress)),
    fold(run_id, n, id, sm, eta) AS (
      SELECT run_id, 0::BIGINT, -1::BIGINT, NULL::DOUBLE, NULL::BIGINT FROM seq GROUP BY run_id
      UNION ALL SELECT q.run_id, q.n, q.id, q.sm, CASE WHEN q.percent <= 0 THEN q.eta ELSE least(q.eta, CASE WHEN q.sm >= 99.9 THEN 0
          WHEN q.el >= 3 AND q.sm >= 5 THEN CAST(round_even(q.el * (100 - q.sm) / q.sm, 0) AS BIGINT) END) END
      FROM (SELECT s.run_id, s.n, s.id, s.percent, f.eta, (epoch_us(s.t_at) - epoch_us(s.st)) / 1e6 AS el,
        CASE WHEN s.percent <= 0 THEN f.sm WHEN f.sm IS NULL THEN s.percent::DOUBLE ELSE 0.3 * s.percent + 0.7 * f.sm END AS sm
        FROM fold f JOIN seq s ON s.run_id = f.run_id AND s.n = f.n + 1) q)
    SELECT f.id, CASE WHEN s.percent > 0 THEN CAST(floor(sm * 1e6 + 0.2718281) AS BIGINT) END AS smoothed_ppm, coalesce(eta, -1) AS eta
    FROM fold f JOIN seq s ON s.id = f.id""",
)
R.add(
    "w11_throttle_progress",
    lambda s, d: jobs.throttle_progress(_progress(s, d)).select("run_id", "id", "percent"),
    """WITH RECURSIVE seq AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t_at, id) AS n FROM valid_progress),
    fold(run_id, n, id, pct, last_pct, last_at, kept) AS (
      SELECT run_id, n, id, percent, percent, t_at, true FROM seq WHERE n = 1
      UNION ALL SELECT q.run_id, q.n, q.id, q.e, CASE WHEN q.k THEN q.e ELSE q.last_pct END,
        CASE WHEN q.k THEN q.t_at ELSE q.last_at END, q.k
      FROM (SELECT s.run_id, s.n, s.id, s.t_at, f.last_pct, f.last_at, greatest(s.percent, f.last_pct) AS e,
        (s.t_at >= f.last_at + INTERVAL 1 SECOND OR greatest(s.percent, f.last_pct) > f.last_pct) AS k
        FROM fold f JOIN seq s ON s.run_id = f.run_id AND s.n = f.n + 1) q)
    SELECT run_id, id, pct AS percent FROM fold WHERE kept""",
)
