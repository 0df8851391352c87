"""Fixed schemas of the subject tables, their links and unique keys, and the table scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MONEY = "decimal(12,2)"
RINGS = "array<array<array<double>>>"
SCHEMAS = {
    "user_events": "id bigint, event_type string, priority string, properties string, user_id bigint,"
    " anonymous_session_key string, tab_id string, project_id bigint, nesting_run_id bigint, ip string,"
    " user_agent string, country_code string, locale string, idempotency_key string, occurred_at timestamp",
    "payments": f"id bigint, user_id bigint, created_at timestamp, status string, payment_method string, currency string,"
    f" amount {MONEY}, list_price {MONEY}, discount_amount {MONEY}, subtotal {MONEY}, tax_amount {MONEY},"
    f" total_amount {MONEY}, purpose string, product_description string, nesting_run_id bigint, subscription_id bigint,"
    " purchaser_name string, purchaser_email string, purchase_reference string, sinpe_transfer_identification string,"
    " sinpe_transfer_mobile_number string, gateway_provider string, gateway_status string, onvo_payment_intent_id string,"
    " onvo_mode string, cabys_code string, paid_at timestamp, superseded_at timestamp, checkout_abandoned_at timestamp,"
    " checkout_lock_released_at timestamp, checkout_lock_reason string",
    "subscriptions": "id bigint, user_id bigint, tier_months int, starts_at timestamp, ends_at timestamp",
    "plan_monthly_usages": "subscription_id bigint, period_year int, period_month int, downloads_used int,"
    " quota_limit int, created_at timestamp",
    "download_grants": "id bigint, user_id bigint, nesting_run_id bigint, kind string, retained_until timestamp,"
    " created_at timestamp, updated_at timestamp",
    "carts": "id bigint, user_id bigint, guest_token string, nesting_run_id bigint, tier_months int,"
    " currency_mode string, list_price_cents bigint, sinpe_price_cents bigint",
    "users": "id bigint, email string, name string, time_zone string, confirmed_at timestamp, suspended_at timestamp,"
    " admin boolean",
    "feedbacks": "id bigint, user_id bigint, feedback_type string, status string, message string, email string,"
    " created_at timestamp",
    "projects": "id bigint, title string, status string, kerf_mm double, margin_mm double, curve_tolerance_mm double,"
    " sheet_gap_mm double, nesting_time_limit_sec int, progress_percent int, progress_message string,"
    " estimated_finished_at timestamp, session_workflow_log array<map<string,string>>",
    "sheet_stocks": "id bigint, project_id bigint, width_mm double, height_mm double, quantity int, sort_order int",
    "project_layers": "id bigint, project_id bigint, attachment_id bigint, layer_name string, color string,"
    " layer_role string, included boolean, auto_close_gaps boolean,"
    " gaps_detected array<struct<distance_mm:double,start:array<double>,end:array<double>>>",
    "nesting_runs": "id bigint, project_id bigint, status string, created_at timestamp, started_at timestamp,"
    " finished_at timestamp, cancel_requested_at timestamp, exit_code int, has_output boolean,"
    " report struct<status:string,orphans:array<struct<piece_index:int,piece_key:string,reason:string>>,"
    "warnings:array<string>,sheets_used:int,pieces_count:int>",
    "orphan_resolutions": "id bigint, project_id bigint, piece_key string, resolution_state string",
    "split_proposals": "id bigint, orphan_resolution_id bigint, version int, status string,"
    f" child_piece_geometries array<struct<label:string,rings:{RINGS}>>, cut_segments {RINGS}",
    "derived_pieces": f"id bigint, project_id bigint, parent_piece_key string, label string, sort_order int, rings {RINGS}",
    "blobs": "id bigint, filename string, byte_size bigint, content_type string",
    "attachments": "id bigint, blob_id bigint, record_type string, record_id bigint",
}
# child table, link column, parent table
LINKS = [
    ("attachments", "blob_id", "blobs"),
    ("carts", "nesting_run_id", "nesting_runs"),
    ("carts", "user_id", "users"),
    ("derived_pieces", "project_id", "projects"),
    ("download_grants", "nesting_run_id", "nesting_runs"),
    ("download_grants", "user_id", "users"),
    ("feedbacks", "user_id", "users"),
    ("nesting_runs", "project_id", "projects"),
    ("orphan_resolutions", "project_id", "projects"),
    ("payments", "nesting_run_id", "nesting_runs"),
    ("payments", "subscription_id", "subscriptions"),
    ("payments", "user_id", "users"),
    ("plan_monthly_usages", "subscription_id", "subscriptions"),
    ("project_layers", "project_id", "projects"),
    ("sheet_stocks", "project_id", "projects"),
    ("split_proposals", "orphan_resolution_id", "orphan_resolutions"),
    ("subscriptions", "user_id", "users"),
    ("user_events", "user_id", "users"),
]
# table, key columns, condition under which the key must be unique
UNIQUE_KEYS = [
    ("user_events", ["idempotency_key"], "idempotency_key is not null"),
    ("payments", ["purchase_reference"], "purchase_reference is not null"),
    ("download_grants", ["user_id", "nesting_run_id"], "nesting_run_id is not null"),
    ("plan_monthly_usages", ["subscription_id", "period_year", "period_month"], None),
    ("carts", ["user_id"], "user_id is not null"),
    ("carts", ["guest_token"], "guest_token is not null"),
    ("project_layers", ["project_id", "attachment_id"], "layer_role = 'primary' and attachment_id is not null"),
    ("orphan_resolutions", ["project_id", "piece_key"], None),
]


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan one subject table with its fixed schema (no inference)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")


def store(df: DataFrame, root: str, name: str, partition_by: str | None = None) -> str:
    """Write one subject table with its fixed columns."""
    path = f"{root.rstrip('/')}/{name}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path
