"""Fixed lookup tables: event catalog, funnel stages, prices, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values (must equal the product's settings for right results).
EVENT_CATALOG = {
    "workspace_started": ("low", []),
    "first_dxf_uploaded": ("low", ["filename", "byte_size"]),
    "project_discarded": ("critical", []),
    "nest_completed": ("critical", ["duration_ms", "pieces_count", "sheets_used"]),
    "account_registered": ("critical", []),
    "user_logged_in": ("low", []),
    "user_logged_out": ("low", []),
    "email_confirmed": ("low", []),
    "account_deleted": ("critical", ["historical_email", "historical_name"]),
    "paywall_viewed": ("low", []),
    "payment_succeeded": ("critical", []),
    "payment_failed": ("critical", []),
    "download_completed": ("critical", []),
}
FUNNEL_STAGES = [
    "workspace_started",
    "first_dxf_uploaded",
    "nest_completed",
    "paywall_viewed",
    "payment_succeeded",
    "download_completed",
]
WORKSHOP_TYPES = ["workspace_started", "first_dxf_uploaded"]
CONVERSION_MIN_PERCENT = 15
FAILURE_MAX_PERCENT = 20
DURATION_P95_MAX_SECONDS = 600
LOW_PRIORITY_PER_HOUR = 300
# product, tier, overage -> official crc, sinpe crc, card usd
PRICES = {
    ("single_download", 0, False): (1200, 1000, 2.50),
    ("single_download", 0, True): (600, 500, 1.25),
    ("plan", 1, False): (3250, 3000, 7.00),
    ("plan", 2, False): (5300, 5000, 11.50),
    ("plan", 4, False): (8400, 8000, 18.00),
}
TIERS = [1, 2, 4]
MONTHLY_QUOTA = 50
VAT_RATE = "0.13"
DEFAULT_CABYS_CODE = "8314200000100"
LOCK_MINUTES = 15
RETENTION_HOURS = 24
LOCK_REASONS = ["timeout", "user_abandoned", "superseded", "user_canceled_3ds"]
BUSINESS_ZONE = "America/Costa_Rica"


def catalog(spark: SparkSession) -> DataFrame:
    """Event catalog: one row per registered event type (13 rows, safe to broadcast)."""
    rows = [(k, p, req) for k, (p, req) in EVENT_CATALOG.items()]
    return spark.createDataFrame(
        rows, "event_type string, priority string, required_properties array<string>"
    )


def funnel_stages(spark: SparkSession) -> DataFrame:
    """Ordered funnel stages."""
    return spark.createDataFrame(list(enumerate(FUNNEL_STAGES, 1)), "stage_no int, event_type string")


def price_table(spark: SparkSession) -> DataFrame:
    """Prices by product, tier (0 = none), overage, currency and billing method; only legal pairs exist."""
    rows = []
    for (product, tier, overage), (official, sinpe, usd) in PRICES.items():
        rows.append((product, tier, overage, "crc", "card", str(official)))
        rows.append((product, tier, overage, "crc", "sinpe", str(sinpe)))
        rows.append((product, tier, overage, "usd", "card", str(usd)))
    raw = spark.createDataFrame(
        rows,
        "product string, tier_months int, overage boolean, currency string, billing_method string, price string",
    )
    return raw.withColumn("price", raw.price.cast("decimal(12,2)"))
