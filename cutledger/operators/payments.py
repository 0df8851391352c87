"""Sales reporting and payment-state operators."""

from __future__ import annotations

import calendar
import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutledger.operators.scan import any_of, error_list, page_of, top_one
from cutledger.sources import dims

ZONE = dims.BUSINESS_ZONE
MONEY = ["list_price", "discount_amount", "subtotal", "tax_amount"]

# Display texts of the sales screens.
METHOD_LABELS = {"card_crc": "Tarjeta CRC", "card_usd": "Tarjeta USD", "sinpe_crc": "SINPE Móvil"}
STATUS_LABELS = {"succeeded": "Exitoso", "pending": "Pendiente", "failed": "Fallido"}
PURPOSE_LABELS = {"single_download": "Descarga suelta", "plan_subscription": "Plan"}
SINGLE_PRODUCT = "Procesamiento de anidado DXF"
RUBRIC_13 = "Ventas a 13%"
RUBRIC_EXEMPT = "Exentas crédito pleno"
RUBRIC_NONE = "No declarable"
FORM_BOXES = [
    ("Total ventas a 13%", "CRC"),
    ("Monto de impuesto a 13%", "CRC"),
    ("Total ventas exentas con derecho a crédito pleno", "USD"),
]
LISTING_PAGE = 20


def _lookup(labels: dict[str, str], key: Column, fallback: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.element_at(mapping, key), fallback)


def reporting_scope(payments: DataFrame) -> DataFrame:
    """Payments counted in reports: superseded attempts are left out."""
    return payments.where("superseded_at is null")


def _day(text: str | None) -> dt.date | None:
    try:
        return dt.date.fromisoformat(text.strip()) if text and text.strip() else None
    except ValueError:
        return None


def default_period(now: dt.datetime, tz: str = ZONE) -> tuple[str, str]:
    """First and last day of the month of ``now`` in the business zone."""
    local = now.astimezone(ZoneInfo(tz)).date()
    last = calendar.monthrange(local.year, local.month)[1]
    return str(local.replace(day=1)), str(local.replace(day=last))


def period_bounds(params: dict, now: dt.datetime, tz: str = ZONE) -> tuple[str | None, str | None]:
    """Requested days: an absent bound means the current month, a blank one means no bound."""
    first, last = default_period(now, tz)
    start = params["start_date"] if "start_date" in params else first
    end = params["end_date"] if "end_date" in params else last
    return (start or None), (end or None)


def local_midnight(day: dt.date, tz: str) -> dt.datetime:
    return dt.datetime.combine(day, dt.time(), ZoneInfo(tz)).astimezone(dt.timezone.utc)


def in_local_days(
    payments: DataFrame, start: str | None, end: str | None, column: str = "created_at", tz: str = ZONE
) -> DataFrame:
    """Rows whose time falls in the local days start..end inclusive; a blank or unparsable bound is none.

    Bounds become UTC literals on the raw column, so the scan can skip row groups.
    """
    if column not in ("created_at", "paid_at"):
        raise ValueError(f"invalid date column: {column}")
    first, last = _day(start), _day(end)
    out = payments
    if first:
        out = out.where(F.col(column) >= F.lit(local_midnight(first, tz)))
    if last:
        out = out.where(F.col(column) < F.lit(local_midnight(last + dt.timedelta(days=1), tz)))
    return out


def where_in(df: DataFrame, column: str, values: list[str] | None) -> DataFrame:
    """IN filter; blanks are dropped and an empty list filters nothing."""
    kept = [v for v in values or [] if v and v.strip()]
    return df.where(F.col(column).isin(kept)) if kept else df


SEARCH_COLUMNS = ["purchaser_name", "purchaser_email", "purchase_reference", "sinpe_transfer_identification"]


def search(df: DataFrame, term: str | None, columns: list[str] = SEARCH_COLUMNS) -> DataFrame:
    """Case-insensitive substring search over several columns; wildcards in the term are literal."""
    term = (term or "").strip()
    if not term:
        return df
    return df.where(any_of([F.contains(F.lower(c), F.lower(F.lit(term))) for c in columns]))


def payment_history(payments: DataFrame, n: int = 100) -> DataFrame:
    """Latest ``n`` payments of every user, abandoned checkouts left out (the group limit runs map-side)."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return (
        payments.where("checkout_abandoned_at is null")
        .withColumn("position", F.row_number().over(newest))
        .where(F.col("position") <= n)
    )


def recent(payments: DataFrame, user_id: int, n: int = 100) -> DataFrame:
    """Latest ``n`` payments of one user."""
    mine = payments.where((F.col("user_id") == user_id) & F.col("checkout_abandoned_at").isNull())
    return mine.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def net_collected() -> Column:
    """Total where positive, else the amount."""
    return F.when(F.col("total_amount") > 0, F.col("total_amount")).otherwise(F.col("amount"))


def method_label(method: Column) -> Column:
    return _lookup(METHOD_LABELS, method, F.translate(F.upper(method), "_", " "))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def status_label(status: Column) -> Column:
    return _lookup(STATUS_LABELS, status, capitalize(status))


def purpose_label(purpose: Column) -> Column:
    return _lookup(PURPOSE_LABELS, purpose, capitalize(F.trim(F.translate(purpose, "_", " "))))


def product_label(description: Column, purpose: Column) -> Column:
    """Text of what was bought: the single product, or the plan with its months."""
    months = F.regexp_extract(description, r"^plan_(\d+)_months$", 1)
    number = months.try_cast("bigint")
    plan = F.concat(
        F.lit("Suscripción mensual - Plan de "),
        number.cast("string"),
        F.when(number == 1, F.lit(" mes")).otherwise(F.lit(" meses")),
    )
    single = (description == "single_download") | (purpose == "single_download")
    return F.when(F.coalesce(single, F.lit(False)), F.lit(SINGLE_PRODUCT)).when(months != "", plan).otherwise(
        purpose_label(purpose)
    )


def labels(payments: DataFrame) -> DataFrame:
    """Display labels of method, status, purpose and product."""
    return payments.withColumns(
        {
            "method_label": method_label(F.col("payment_method")),
            "status_label": status_label(F.col("status")),
            "purpose_label": purpose_label(F.col("purpose")),
            "product_label": product_label(F.col("product_description"), F.col("purpose")),
        }
    )


def tier_months(description: Column) -> Column:
    """Plan months named by a product description, NULL unless 1, 2 or 4."""
    n = F.regexp_extract(description, r"^plan_(\d+)_months$", 1).try_cast("int")
    return F.when(n.isin(dims.TIERS), n)


def catalog_code(code: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(code), F.lit("")), F.lit(dims.DEFAULT_CABYS_CODE))


def vat_rubric() -> Column:
    """VAT-form rubric of a payment row."""
    return (
        F.when(F.col("status") != "succeeded", F.lit(RUBRIC_NONE))
        .when(F.col("currency") == "usd", F.lit(RUBRIC_EXEMPT))
        .otherwise(F.lit(RUBRIC_13))
    )


def lock_expires_at(minutes: int = dims.LOCK_MINUTES) -> Column:
    return F.col("created_at") + F.expr(f"interval {minutes} minutes")


def covered_by_grant(payments: DataFrame, grants: DataFrame, at: str) -> DataFrame:
    """Flag payments whose run is covered by an active grant touched at or after the payment.

    Grants shrink to one time per (user, run) first, so the join never multiplies rows.
    """
    moment = F.lit(at).cast("timestamp")
    active = grants.where((F.col("kind") == "single_purchase") & (F.col("retained_until") >= moment))
    newest = active.groupBy("user_id", "nesting_run_id").agg(F.max("updated_at").alias("_granted"))
    return (
        payments.join(newest, ["user_id", "nesting_run_id"], "left")
        .withColumn("covered", F.coalesce(F.col("_granted") >= F.col("created_at"), F.lit(False)))
        .drop("_granted")
    )


def _with_last_success(payments: DataFrame) -> DataFrame:
    wins = payments.where("status = 'succeeded' and purpose = 'single_download' and nesting_run_id is not null")
    last = wins.groupBy("user_id", "nesting_run_id").agg(F.max("created_at").alias("_last_success"))
    return payments.join(last, ["user_id", "nesting_run_id"], "left")


def superseded_by_later(payments: DataFrame) -> DataFrame:
    """Flag payments followed by a successful one of the same user and run (strictly later)."""
    flag = F.coalesce(F.col("_last_success") > F.col("created_at"), F.lit(False))
    return _with_last_success(payments).withColumn("superseded_later", flag).drop("_last_success")


def superseded_for_lock(payments: DataFrame) -> DataFrame:
    """The same test for locks, where a success at the same instant counts too."""
    flag = F.coalesce(F.col("_last_success") >= F.col("created_at"), F.lit(False))
    return _with_last_success(payments).withColumn("superseded_lock", flag).drop("_last_success")


def checkout_lock(payments: DataFrame, grants: DataFrame, at: str, minutes: int = dims.LOCK_MINUTES) -> DataFrame:
    """Lock expiry, expired and active flags of pending transfer payments."""
    moment = F.lit(at).cast("timestamp")
    waiting = (F.col("payment_method") == "sinpe_crc") & (F.col("status") == "pending")
    open_lock = (
        F.col("superseded_at").isNull()
        & F.col("checkout_lock_released_at").isNull()
        & F.col("checkout_abandoned_at").isNull()
        & ~F.col("covered")
    )
    return covered_by_grant(payments, grants, at).withColumns(
        {
            "lock_expires_at": F.when(waiting, lock_expires_at(minutes)),
            "lock_active": waiting & open_lock & (moment < lock_expires_at(minutes)),
            "lock_expired": waiting & (moment >= lock_expires_at(minutes)),
        }
    )


def payment_state(payments: DataFrame, grants: DataFrame, at: str) -> DataFrame:
    """What the checkout page shows: where to send the buyer, and whether retry or release is offered."""
    gate = F.coalesce("gateway_status", F.lit(""))
    card_pending = F.col("payment_method").isin("card_crc", "card_usd") & (F.col("status") == "pending")
    granted = grants.select("user_id", "nesting_run_id").distinct().withColumn("_grant", F.lit(True))
    state = (
        F.when(
            (F.col("status") == "succeeded")
            & (gate == "succeeded")
            & ((F.col("purpose") == "plan_subscription") | F.col("_grant").isNotNull()),
            "ready",
        )
        .when(F.col("status") == "succeeded", "confirming")
        .when(F.col("status") == "failed", "declined")
        .when((gate == "requires_payment_method") & card_pending, "canceled")
        .when(gate == "requires_payment_method", "declined")
        .when(gate.isin("requires_action", "canceled"), "canceled")
        .otherwise("waiting")
    )
    retry = (
        (F.col("payment_method") == "sinpe_crc")
        & (F.col("purpose") == "single_download")
        & F.col("nesting_run_id").isNotNull()
        & (F.col("status") == "pending")
        & ~F.col("lock_active")
    )
    locked = checkout_lock(payments, grants, at).join(granted, ["user_id", "nesting_run_id"], "left")
    return locked.withColumns({"ui_state": state, "can_retry": retry, "can_release": F.col("lock_active")}).drop("_grant")


def incomplete_card(payments: DataFrame, grants: DataFrame, at: str) -> DataFrame:
    """Card attempts left before a charge: superseded by a later success, or open and not covered."""
    flagged = covered_by_grant(superseded_by_later(payments), grants, at)
    card = F.col("payment_method").isin("card_crc", "card_usd") & (F.col("status") != "succeeded")
    return flagged.where(
        card & (F.col("superseded_later") | (F.col("status").isin("pending", "failed") & ~F.col("covered")))
    )


def awaiting_gateway(payments: DataFrame, grants: DataFrame, at: str) -> DataFrame:
    """Single-download payments still waiting for the gateway."""
    card = F.col("payment_method").isin("card_crc", "card_usd")
    open_rows = payments.where(
        (F.col("status") == "pending") & (F.col("purpose") == "single_download") & F.col("superseded_at").isNull()
    ).where(~(F.col("checkout_abandoned_at").isNotNull() & card))
    return covered_by_grant(open_rows, grants, at).where("not covered").drop("covered")


def latest_success(payments: DataFrame) -> DataFrame:
    """Latest succeeded single download per (user, run)."""
    wins = payments.where("status = 'succeeded' and purpose = 'single_download' and nesting_run_id is not null")
    return top_one(wins, ["user_id", "nesting_run_id"], [F.col("created_at"), F.col("id")])


def purchase_rows(grants: DataFrame, payments: DataFrame, at: str) -> DataFrame:
    """Active grants whose run has no waiting payment, each with its latest succeeded payment."""
    moment = F.lit(at).cast("timestamp")
    waiting = awaiting_gateway(payments, grants, at).select("user_id", "nesting_run_id")
    shown = grants.where((F.col("kind") == "single_purchase") & (F.col("retained_until") >= moment)).join(
        waiting, ["user_id", "nesting_run_id"], "left_anti"
    )
    paid = latest_success(payments).select("user_id", "nesting_run_id", F.col("id").alias("display_payment_id"))
    return shown.join(paid, ["user_id", "nesting_run_id"], "left").select(
        "user_id",
        "nesting_run_id",
        F.col("created_at").alias("sort_at"),
        F.col("id").alias("grant_id"),
        "display_payment_id",
    )


def pending_rows(payments: DataFrame, grants: DataFrame, at: str) -> DataFrame:
    return awaiting_gateway(payments, grants, at).select(
        "user_id", "nesting_run_id", F.col("created_at").alias("sort_at"), F.col("id").alias("pending_payment_id")
    )


def purchase_union(grant_rows: DataFrame, pending: DataFrame) -> DataFrame:
    """Grant rows and pending rows in one list per user, newest first."""
    return grant_rows.unionByName(pending, allowMissingColumns=True).orderBy(
        "user_id", F.desc("sort_at"), F.desc("grant_id"), F.desc("pending_payment_id")
    )


def purchase_counters(rows: DataFrame) -> DataFrame:
    """Ready and pending purchases per user."""
    return rows.groupBy("user_id").agg(
        F.count("grant_id").alias("ready"), F.count("pending_payment_id").alias("pending")
    )


def supersede(payments: DataFrame) -> DataFrame:
    """Open transfer checkouts of a (user, run) closed by the next one, oldest first; only the newest stays open."""
    oldest = Window.partitionBy("user_id", "nesting_run_id").orderBy("created_at", "id")
    open_rows = payments.where(
        "status = 'pending' and purpose = 'single_download' and payment_method = 'sinpe_crc'"
        " and superseded_at is null and nesting_run_id is not null"
    ).select("id", "user_id", "nesting_run_id", "created_at")
    return open_rows.withColumns(
        {"position": F.row_number().over(oldest), "new_superseded_at": F.lead("created_at").over(oldest)}
    ).where("new_superseded_at is not null")


def pending_lock(payments: DataFrame, grants: DataFrame, at: str, runs: DataFrame | None = None) -> DataFrame:
    """Newest active lock per user (or per user and project when runs are given)."""
    locked = superseded_for_lock(checkout_lock(payments, grants, at)).where(
        "lock_active and purpose = 'single_download' and not superseded_lock"
    )
    keys = ["user_id"]
    if runs is not None:
        owner = runs.select(F.col("id").alias("nesting_run_id"), "project_id")
        locked = locked.join(owner, "nesting_run_id")
        keys = ["user_id", "project_id"]
    return top_one(locked, keys, [F.col("created_at"), F.col("id")])


def status_counts(payments: DataFrame) -> DataFrame:
    """Succeeded, pending and failed rows in one pass."""
    return payments.agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("succeeded", "failed", "pending")]
    )


def declaration_totals(payments: DataFrame) -> DataFrame:
    """Succeeded totals per currency; the total falls back to the amount when zero or NULL."""
    zero = F.lit(0).cast("decimal(12,2)")
    total = F.coalesce(F.nullif("total_amount", zero), F.col("amount"))
    return (
        payments.where("status = 'succeeded'")
        .groupBy("currency")
        .agg(
            F.count("*").alias("n"),
            *[F.sum(F.coalesce(c, zero)).alias(c) for c in MONEY],
            F.sum(total).alias("total"),
        )
    )


def local_day(column: str, tz: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(column, tz))


def _summary(payments: DataFrame, tz: str, with_total: bool) -> DataFrame:
    rows = payments.where("status = 'succeeded'").select(
        local_day("created_at", tz).alias("day"), "currency", "payment_method", *MONEY, net_collected().alias("net")
    )
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(c) for c in [*MONEY, "net"]]]
    if not with_total:
        return rows.groupBy("day", "currency", "payment_method").agg(*sums)
    sets = [[F.col("day"), F.col("currency"), F.col("payment_method")], [F.col("currency")]]
    return rows.groupingSets(sets, "day", "currency", "payment_method").agg(
        (F.grouping("day") == 1).alias("is_total"), *sums
    )


def daily_summary(payments: DataFrame, tz: str = ZONE) -> DataFrame:
    """Succeeded payments per local day, currency and method (the day follows created_at)."""
    return _summary(payments, tz, with_total=False)


def daily_summary_with_total(payments: DataFrame, tz: str = ZONE) -> DataFrame:
    """The daily summary with one grand-total row per currency, from one aggregation."""
    return _summary(payments, tz, with_total=True)


def purpose_counts(payments: DataFrame) -> DataFrame:
    won = F.col("status") == "succeeded"
    return payments.agg(
        F.count_if(won & (F.col("purpose") == "single_download")).alias("single_count"),
        F.count_if(won & (F.col("purpose") == "plan_subscription")).alias("plan_count"),
    )


def tier_join(payments: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Succeeded payments with the tier of the subscription they paid."""
    tiers = subscriptions.select(F.col("id").alias("subscription_id"), "tier_months")
    return payments.where("status = 'succeeded' and subscription_id is not null").join(tiers, "subscription_id")


def plans_by_tier(payments: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Succeeded plan payments per tier, as three columns."""
    return tier_join(payments, subscriptions).agg(
        *[F.count_if(F.col("tier_months") == t).alias(f"plans_{t}_month") for t in dims.TIERS]
    )


def vat_boxes(payments: DataFrame) -> DataFrame:
    """The three boxes of the VAT form."""
    rubric = vat_rubric()
    sums = payments.agg(
        F.sum(F.when(rubric == RUBRIC_13, F.col("subtotal"))).alias("b0"),
        F.sum(F.when(rubric == RUBRIC_13, F.col("tax_amount"))).alias("b1"),
        F.sum(F.when(rubric == RUBRIC_EXEMPT, F.col("subtotal"))).alias("b2"),
    )
    zero = F.lit(0).cast("decimal(22,2)")
    boxes = [
        F.struct(F.lit(i).alias("box_no"), F.lit(n).alias("box"), F.lit(c).alias("currency"), F.coalesce(f"b{i}", zero).alias("amount"))
        for i, (n, c) in enumerate(FORM_BOXES)
    ]
    return sums.select(F.inline(F.array(*boxes)))


def failure_rate(payments: DataFrame, max_pct: float = dims.FAILURE_MAX_PERCENT) -> DataFrame:
    """Share of failed payments in percent against the alert limit."""
    rate = F.coalesce(F.count_if(F.col("status") == "failed") * 100.0 / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))
    return payments.agg(rate.alias("failure_rate")).withColumn("alert", F.col("failure_rate") > max_pct)


def page(payments: DataFrame, page_no: int, direction: str = "desc", per: int = LISTING_PAGE) -> DataFrame:
    """One listing page with total rows and pages (at least one page; the page number is clamped to 1)."""
    ends = [F.asc("created_at"), F.asc("id")] if direction == "asc" else [F.desc("created_at"), F.desc("id")]
    total = payments.select(F.count("*")).scalar()
    return page_of(payments, ends, page_no, per).withColumns(
        {
            "total_count": total,
            "total_pages": F.greatest(F.ceil(total / F.lit(per)), F.lit(1).cast("bigint")),
            "page": F.lit(max(int(page_no), 1)),
        }
    )


def currency_pages(payments: DataFrame, pages: dict[str, int], direction: str = "desc") -> DataFrame:
    """The CRC and the USD listing page side by side, each a bounded top-k."""
    crc = page(payments.where("currency = 'crc'"), pages.get("crc", 1), direction)
    usd = page(payments.where("currency = 'usd'"), pages.get("usd", 1), direction)
    return crc.unionByName(usd)


def sort_for_vat(payments: DataFrame, direction: str = "desc") -> DataFrame:
    """Payments by paid time and id."""
    turn = F.asc if direction == "asc" else F.desc
    return payments.orderBy(turn("paid_at"), turn("id"))


def sort_summary(summary: DataFrame, direction: str = "desc") -> DataFrame:
    """Summary rows by day and method."""
    turn = F.asc if direction == "asc" else F.desc
    return summary.orderBy(turn("day"), turn("payment_method"))


def match_webhooks(events: DataFrame, payments: DataFrame) -> DataFrame:
    """Gateway events with their payment; unknown intents get an error for the dead letter."""
    known = payments.where("onvo_payment_intent_id is not null").select(
        F.col("onvo_payment_intent_id").alias("payment_intent_id"), F.col("id").alias("payment_id"), "status"
    )
    return events.join(known, "payment_intent_id", "left").withColumn(
        "error", F.when(F.col("payment_id").isNull(), F.lit("payment not found"))
    )


def validate_payments(payments: DataFrame) -> DataFrame:
    """Row checks as an array of error names."""
    gateway = F.coalesce(F.col("gateway_provider") == "onvo", F.lit(False))

    def blank(c: str) -> Column:
        return F.coalesce(F.trim(c), F.lit("")) == ""

    rules = [
        (~F.coalesce(F.col("amount") > 0, F.lit(False)), "amount"),
        ((F.col("status") == "succeeded") & F.col("paid_at").isNull(), "paid_at"),
        (gateway & blank("onvo_payment_intent_id"), "onvo_payment_intent_id"),
        (gateway & blank("onvo_mode"), "onvo_mode"),
        (gateway & blank("gateway_status"), "gateway_status"),
        (~F.col("purchase_reference").rlike("^[0-9]{12}$"), "purchase_reference"),
        (~F.col("checkout_lock_reason").isin(dims.LOCK_REASONS), "checkout_lock_reason"),
        (
            gateway
            & (F.col("status") == "succeeded")
            & (F.coalesce("gateway_status", F.lit("")) != "succeeded"),
            "gateway_unconfirmed",
        ),
        (~F.coalesce(F.col("cabys_code") == dims.DEFAULT_CABYS_CODE, F.lit(False)), "cabys_code"),
    ]
    return payments.withColumn("errors", error_list(rules))
