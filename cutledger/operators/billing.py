"""Prices, plans, quotas, entitlements, carts and countries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutledger.functions.clock import plan_end
from cutledger.functions.money import to_major, vat
from cutledger.operators.scan import DAY_US, Running, error_list, running, time_block, top_one
from cutledger.sources import dims


def active_at(subscriptions: DataFrame, at: str) -> DataFrame:
    """Subscriptions whose closed interval holds ``at``."""
    moment = F.lit(at).cast("timestamp")
    return subscriptions.where((F.col("starts_at") <= moment) & (F.col("ends_at") >= moment))


def retention_active(grants: DataFrame, at: str) -> DataFrame:
    """Single purchases kept at least until ``at`` (the display rule)."""
    return grants.where((F.col("kind") == "single_purchase") & (F.col("retained_until") >= F.lit(at).cast("timestamp")))


def retained_active(grants: DataFrame, at: str) -> DataFrame:
    """Single purchases kept beyond ``at`` (the download rule)."""
    return grants.where((F.col("kind") == "single_purchase") & (F.col("retained_until") > F.lit(at).cast("timestamp")))


def purge_list(grants: DataFrame, at: str) -> DataFrame:
    """Single purchases whose retention ended before ``at``."""
    return grants.where((F.col("kind") == "single_purchase") & (F.col("retained_until") < F.lit(at).cast("timestamp")))


def extend_retention(grants: DataFrame, paid: DataFrame, hours: int = dims.RETENTION_HOURS) -> DataFrame:
    """Move the retention end to paid_at + 24 h, never backwards."""
    last = paid.groupBy("user_id", "nesting_run_id").agg(F.max("paid_at").alias("_paid_at"))
    window_end = F.col("_paid_at") + F.expr(f"interval {hours} hours")
    return (
        grants.join(last, ["user_id", "nesting_run_id"], "left")
        .withColumn("retained_until", F.greatest("retained_until", window_end))
        .drop("_paid_at")
    )


def billable_users(users: DataFrame) -> DataFrame:
    """Confirmed and not suspended."""
    return users.where("confirmed_at is not null and suspended_at is null")


def with_price(df: DataFrame) -> DataFrame:
    """Price by product, currency, billing method, overage and tier; refusals carry an error instead."""
    table = dims.price_table(df.sparkSession)
    tier = F.when(F.col("product") == "plan", F.col("tier_months")).otherwise(F.lit(0))
    keys = ["product", "currency", "billing_method", "overage"]
    error = (
        F.when(~F.col("currency").isin("usd", "crc"), "currency must be usd or crc")
        .when(~F.col("billing_method").isin("card", "sinpe"), "payment_method must be card or sinpe")
        .when((F.col("billing_method") == "sinpe") & (F.col("currency") != "crc"), "sinpe requires crc currency")
        .when((F.col("product") == "plan") & F.col("tier_months").isNull(), "tier_months required for plan")
        .when((F.col("product") == "plan") & F.col("overage"), "plan overage is not supported")
        .when((F.col("product") == "plan") & ~F.col("tier_months").isin(dims.TIERS), "unknown plan tier_months")
        .when(~F.col("product").isin("single_download", "plan"), "unsupported product")
    )
    prices = table.withColumnRenamed("tier_months", "_tier")
    return (
        df.withColumn("_tier", tier)
        .join(F.broadcast(prices), [*keys, "_tier"], "left")
        .withColumn("price_error", error)
        .withColumn("price", F.when(F.col("price_error").isNull(), F.col("price")))
        .drop("_tier")
    )


def checkout_breakdown(df: DataFrame) -> DataFrame:
    """Discount (transfer only, never negative), subtotal, tax where it applies, and total."""
    zero = F.lit(0).cast("decimal(12,2)")
    discount = F.when(
        (F.col("billing_method") == "sinpe") & F.col("sinpe_price").isNotNull(),
        F.greatest(F.col("list_price") - F.col("sinpe_price"), zero),
    ).otherwise(zero)
    out = df.withColumn("discount_amount", discount.cast("decimal(12,2)"))
    out = out.withColumn("subtotal", (F.col("list_price") - F.col("discount_amount")).cast("decimal(12,2)"))
    out = out.withColumn("tax_amount", F.when(F.col("iva_applicable"), vat(F.col("subtotal"))).otherwise(zero))
    return out.withColumn("total_amount", (F.col("subtotal") + F.col("tax_amount")).cast("decimal(12,2)"))


def cart_breakdown(carts: DataFrame) -> DataFrame:
    """Tax breakdown of carts from their own list and transfer prices, stored in cents.

    Carts have list_price_cents, sinpe_price_cents, country_code and billing_method. Currency and tax are those of the country's policy; a price
    that is missing counts as nothing, so a transfer without its own price is discounted in full.
    """
    ruled = regional_policy(carts)
    price = lambda c: to_major(F.coalesce(F.col(c), F.lit(0)), F.col("policy_currency")).cast("decimal(12,2)")
    return checkout_breakdown(ruled.withColumns({"list_price": price("list_price_cents"), "sinpe_price": price("sinpe_price_cents")}))


def regional_policy(df: DataFrame) -> DataFrame:
    """Currency, tax and payment methods of a country; an ill-formed code gets an error."""
    code = F.nullif(F.upper(F.trim("country_code")), F.lit(""))
    home = F.coalesce(code == "CR", F.lit(False))
    return df.withColumns(
        {
            "policy_country": code,
            "policy_currency": F.when(home, "crc").otherwise("usd"),
            "iva_applicable": home,
            "available_methods": F.when(home, F.array(F.lit("sinpe"), F.lit("card"))).otherwise(F.array(F.lit("card"))),
            "default_method": F.when(home, "sinpe").otherwise("card"),
            "policy_error": F.when(~code.rlike("^[A-Z]{2}$"), F.lit("invalid country_code")),
        }
    )


def _present(column: str) -> Column:
    return F.when(F.trim(column) != "", F.col(column))


def resolve_country(df: DataFrame, override: str | None = None) -> DataFrame:
    """Billing country and where it came from.

    Expects header_country, ip_country, time_zone and session_country columns.
    """
    steps = [
        ("override", F.lit((override or "").strip().upper() or None).cast("string")),
        ("cloudflare", _present("header_country")),
        ("geolite2", _present("ip_country")),
        ("user_time_zone", F.when(F.trim("time_zone") == dims.BUSINESS_ZONE, F.lit("CR"))),
        ("session", _present("session_country")),
    ]
    code = F.coalesce(*[c for _, c in steps])
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in steps], F.lit("default_international"))
    return df.withColumns({"country_code": F.upper(F.trim(code)), "resolution_source": source})


def ip_to_long(ip: Column) -> Column:
    """IPv4 text as a number, NULL if malformed."""
    text = F.trim(ip)
    parts = F.transform(F.split(text, r"\."), lambda p: p.try_cast("bigint"))
    good = text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & ~F.exists(parts, lambda p: p > 255)
    return F.when(good, F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p))


def is_private(number: Column) -> Column:
    """Loopback and private address blocks."""
    return (
        number.between(0x0A000000, 0x0AFFFFFF)
        | number.between(0x7F000000, 0x7FFFFFFF)
        | number.between(0xAC100000, 0xAC1FFFFF)
        | number.between(0xC0A80000, 0xC0A8FFFF)
    )


def country_for_ip(df: DataFrame, ip_ranges: DataFrame) -> DataFrame:
    """Country of each address from disjoint (ip_from, ip_to, country_code) ranges.

    Addresses shrink to the distinct ones (2^32 at most, and 65 536 per block of high 16 bits), are put
    on one number line with the range starts, and take the latest start at or below them.
    """
    numbered = df.withColumn("_ip", ip_to_long(F.col("ip")))
    wanted = numbered.select(F.col("_ip").alias("at")).where(F.col("at").isNotNull() & ~is_private(F.col("at"))).distinct()
    line = wanted.withColumn("kind", F.lit(1)).unionByName(
        ip_ranges.select(
            F.col("ip_from").alias("at"), F.lit(0).alias("kind"), F.struct("ip_to", "country_code").alias("range")
        ),
        allowMissingColumns=True,
    )
    found = (
        running(
            line.withColumn("_all", F.lit(1)),
            ["_all"],
            [F.col("at"), F.col("kind")],
            [F.floor(F.col("at") / 65_536)],
            [Running("hit", "last", F.col("range"))],
        )
        .where("kind = 1 and at <= hit.ip_to")
        .select(F.col("at").alias("_ip"), F.col("hit.country_code").alias("ip_country"))
    )
    return numbered.join(found, "_ip", "left").drop("_ip")


def with_active_plan(df: DataFrame, subscriptions: DataFrame, at: str) -> DataFrame:
    """Add the subscription in force at each row's time ``at`` (the one ending last among those started).

    Rows and subscription starts are merged on one time line per user; a running maximum of (end, id)
    finds the latest end, so no user's rows are multiplied by their subscriptions.
    """
    line = df.withColumn("_kind", F.lit(1)).withColumn("_t", F.col(at)).unionByName(
        subscriptions.select(
            "user_id",
            F.lit(0).alias("_kind"),
            F.col("starts_at").alias("_t"),
            F.struct("ends_at", F.col("id").alias("subscription_id"), "tier_months").alias("_sub"),
        ),
        allowMissingColumns=True,
    )
    seen = running(
        line,
        ["user_id"],
        [F.col("_t"), F.col("_kind")],
        [time_block(F.col("_t"), 30 * DAY_US)],
        [Running("_plan", "max", F.col("_sub"))],
    ).where("_kind = 1")
    alive = F.col("_plan.ends_at") >= F.col("_t")
    return seen.withColumns(
        {
            "plan_id": F.when(alive, F.col("_plan.subscription_id")),
            "plan_ends_at": F.when(alive, F.col("_plan.ends_at")),
        }
    ).drop("_kind", "_t", "_sub", "_plan")


def active_plan(users: DataFrame, subscriptions: DataFrame, at: str) -> DataFrame:
    """Each user's subscription in force at ``at``, the one ending last."""
    best = top_one(active_at(subscriptions, at), ["user_id"], [F.col("ends_at"), F.col("id")])
    plans = best.select(F.col("user_id").alias("_u"), F.col("id").alias("plan_id"), F.col("ends_at").alias("plan_ends_at"))
    return users.join(plans, F.col("id") == F.col("_u"), "left").drop("_u")


def plan_expiry_preview(users: DataFrame, subscriptions: DataFrame, now: str, tiers: list[int] = dims.TIERS) -> DataFrame:
    """End a plan would have if bought now, per user and tier: counted from the current end if active."""
    start = F.coalesce("plan_ends_at", F.lit(now).cast("timestamp"))
    zone = F.coalesce("time_zone", F.lit("UTC"))
    return (
        active_plan(users, subscriptions, now)
        .withColumn("tier_months", F.explode(F.array(*[F.lit(t) for t in tiers])))
        .select(
            F.col("id").alias("user_id"),
            "tier_months",
            plan_end(start, F.col("tier_months"), zone).alias("projected_ends_at"),
        )
    )


def month_usage(usage: DataFrame, at: str) -> DataFrame:
    """Usage rows of the calendar month of ``at``."""
    moment = F.lit(at).cast("timestamp")
    return usage.where((F.col("period_year") == F.year(moment)) & (F.col("period_month") == F.month(moment)))


def plan_availability(users: DataFrame, subscriptions: DataFrame, usage: DataFrame, at: str) -> DataFrame:
    """Per user: plan included, quota exhausted, and whether a single purchase is offered."""
    used = month_usage(usage, at).select(
        F.col("subscription_id").alias("plan_id"), (F.col("quota_limit") - F.col("downloads_used")).alias("_left")
    )
    ready = F.col("confirmed_at").isNotNull() & F.col("suspended_at").isNull()
    has_plan = ready & F.col("plan_id").isNotNull()
    left = F.coalesce("_left", F.lit(dims.MONTHLY_QUOTA))
    return (
        active_plan(users, subscriptions, at)
        .join(used, "plan_id", "left")
        .select(
            F.col("id").alias("user_id"),
            (has_plan & (left > 0)).alias("plan_included"),
            (has_plan & (left <= 0)).alias("quota_exhausted"),
            (~(has_plan & (left > 0))).alias("single_checkout_allowed"),
        )
    )


def can_download(
    requests: DataFrame,
    users: DataFrame,
    runs: DataFrame,
    grants: DataFrame,
    subscriptions: DataFrame,
    usage: DataFrame,
    at: str,
) -> DataFrame:
    """Entitlement of (user, run) requests: billable, and a live grant or a plan with quota on a project's run.

    Each branch is a flag from its own join on unique keys; the OR is taken afterwards.
    """
    grant = (
        retained_active(grants, at).select("user_id", "nesting_run_id").distinct().withColumn("by_grant", F.lit(True))
    )
    included = plan_availability(users, subscriptions, usage, at).select("user_id", "plan_included")
    owned = runs.where("project_id is not null").select(F.col("id").alias("nesting_run_id")).withColumn("_run", F.lit(True))
    billable = billable_users(users).select(F.col("id").alias("user_id")).withColumn("_ok", F.lit(True))
    no = F.lit(False)
    by_grant = F.coalesce("by_grant", no)
    by_plan = F.coalesce("plan_included", no) & F.coalesce("_run", no)
    return (
        requests.join(billable, "user_id", "left")
        .join(grant, ["user_id", "nesting_run_id"], "left")
        .join(included, "user_id", "left")
        .join(owned, "nesting_run_id", "left")
        .select(
            *requests.columns,
            by_grant.alias("by_grant"),
            by_plan.alias("by_plan"),
            (F.coalesce("_ok", no) & (by_grant | by_plan)).alias("can_download"),
        )
    )


def exhausted_quotas(usage: DataFrame, start: str, end: str) -> DataFrame:
    """Usage rows created in the UTC days start..end that reached their limit."""
    first = F.lit(start).cast("timestamp")
    after = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")
    return usage.where((F.col("created_at") >= first) & (F.col("created_at") < after)).agg(
        F.count_if(F.col("downloads_used") >= F.col("quota_limit")).alias("exhausted_quotas")
    )


def quota_downloads(
    downloads: DataFrame, grants: DataFrame, subscriptions: DataFrame, runs: DataFrame, limit: int = dims.MONTHLY_QUOTA
) -> DataFrame:
    """Downloads that consume plan quota: not by token, no live single grant, a plan in force, a project's run,
    and the month's quota not yet used up (the first ``limit`` by time)."""
    kept = grants.where("kind = 'single_purchase'").groupBy("user_id", "nesting_run_id").agg(
        F.max("retained_until").alias("_kept")
    )
    owned = runs.where("project_id is not null").select(F.col("id").alias("nesting_run_id"))
    candidates = (
        downloads.where("not via_token")
        .join(kept, ["user_id", "nesting_run_id"], "left")
        .where("_kept is null or _kept <= downloaded_at")
        .drop("_kept")
        .join(owned, "nesting_run_id", "left_semi")
    )
    month = Window.partitionBy("plan_id", "period_year", "period_month").orderBy("downloaded_at", "id")
    return (
        with_active_plan(candidates, subscriptions, "downloaded_at")
        .where("plan_id is not null")
        .withColumns({"period_year": F.year("downloaded_at"), "period_month": F.month("downloaded_at")})
        .withColumn("use_no", F.row_number().over(month))
        .where(F.col("use_no") <= limit)
    )


def monthly_usage(counted: DataFrame, limit: int = dims.MONTHLY_QUOTA) -> DataFrame:
    """Usage rows per subscription and month from quota-consuming downloads."""
    used = counted.groupBy(F.col("plan_id").alias("subscription_id"), "period_year", "period_month").agg(
        F.count("*").alias("downloads_used")
    )
    return used.withColumns(
        {
            "quota_limit": F.lit(limit),
            "remaining": F.lit(limit) - F.col("downloads_used"),
            "exhausted": F.col("downloads_used") >= limit,
        }
    )


def _months_later(day: dt.date, months: int) -> dt.date:
    first = dt.date(day.year + (day.month - 1 + months) // 12, (day.month - 1 + months) % 12 + 1, 1)
    after = dt.date(first.year + first.month // 12, first.month % 12 + 1, 1)
    return first.replace(day=min(day.day, (after - first).days))


FOLDED = "user_id bigint, tier_months int, starts_at timestamp, ends_at timestamp, n_purchases int"


def _fold_purchases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk purchases sorted by (user, time), holding one open subscription at a time."""
    utc = dt.timezone.utc
    names = ["user_id", "tier_months", "starts_at", "ends_at", "n_purchases"]

    def frame(rows: list[list]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        for c in ("starts_at", "ends_at"):
            out[c] = pd.to_datetime(out[c], utc=True).dt.tz_localize(None)
        return out

    current: list | None = None
    for batch in batches:
        done = []
        for user, zone_name, paid, tier in zip(
            batch["user_id"], batch["time_zone"], batch["paid_at"].dt.to_pydatetime(), batch["tier_months"]
        ):
            zone, paid = ZoneInfo(zone_name or "UTC"), paid.replace(tzinfo=utc)
            active = current is not None and current[0] == user and paid <= current[3]
            anchor = current[3] if active else paid
            day = _months_later(anchor.astimezone(zone).date(), int(tier)) + dt.timedelta(days=1)
            end = dt.datetime.combine(day, dt.time(), zone).astimezone(utc) - dt.timedelta(microseconds=1)
            if active:
                current[3:] = [end, current[4] + 1]
                continue
            if current is not None:
                done.append(current)
            current = [user, tier, paid, end, 1]
        if done:
            yield frame(done)
    if current is not None:
        yield frame([current])


def extend_subscriptions(purchases: DataFrame, users: DataFrame) -> DataFrame:
    """Fold a user's paid plans: a purchase while active extends the end, otherwise starts a new row.

    Whether a purchase extends depends on the end computed so far, so the walk is sequential per user; it
    keeps one open row in memory. A user's purchases are few by nature: each moves the end a month or
    more, and dates stop at the year 9999.
    """
    zones = users.select(F.col("id").alias("user_id"), "time_zone")
    return (
        purchases.select("user_id", "id", "paid_at", "tier_months")
        .join(zones, "user_id", "left")
        .repartition("user_id")
        .sortWithinPartitions("user_id", "paid_at", "id")
        .mapInPandas(_fold_purchases, FOLDED)
    )


def validate_cart(carts: DataFrame) -> DataFrame:
    """An owner, and exactly one of run or tier."""
    no_owner = F.col("user_id").isNull() & (F.coalesce(F.trim("guest_token"), F.lit("")) == "")
    both_or_none = F.col("nesting_run_id").isNotNull() == F.col("tier_months").isNotNull()
    return carts.withColumn("errors", error_list([(no_owner, "owner"), (both_or_none, "product")]))


def _claimed(carts: DataFrame, logins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(guest carts nobody claims, claimed ones with the user and whether they are that user's first and the user has no cart)."""
    when = F.col("logged_in_at") if "logged_in_at" in logins.columns else F.lit(None).cast("timestamp")
    token = logins.select(F.trim("guest_token").alias("guest_token"), F.col("user_id").alias("_login"), when.alias("_when"))
    guests = carts.where("user_id is null").join(token.where("guest_token <> ''"), "guest_token", "left")
    claimed = guests.where("_login is not null")
    first = claimed.groupBy("_login").agg(F.min(F.struct(F.coalesce("_when", F.lit("9999-12-31").cast("timestamp")), "guest_token", "id"))["id"].alias("_first"))
    own = carts.where("user_id is not null").select(F.col("user_id").alias("_login")).distinct().withColumn("_own", F.lit(True))
    claimed = claimed.join(first, "_login").join(own, "_login", "left")
    takes = F.col("_own").isNull() & (F.col("id") == F.col("_first"))
    return guests.where("_login is null"), claimed.withColumn("_takes", takes)


def merge_carts(carts: DataFrame, logins: DataFrame) -> DataFrame:
    """Carts after logins: a user's own cart wins, otherwise the cart of the first login (by logged_in_at, else token) becomes the user's.

    ``lost_carts`` gives the guest carts that go.
    """
    stay, claimed = _claimed(carts, logins)
    adopt = claimed.where("_takes").withColumn("user_id", F.col("_login")).withColumn("guest_token", F.lit(None).cast("string"))
    own = carts.where("user_id is not null")
    return own.unionByName(stay.select(own.columns)).unionByName(adopt.select(own.columns))


def lost_carts(carts: DataFrame, logins: DataFrame) -> DataFrame:
    """Guest carts dropped at login, with the user and the reason."""
    reason = F.when(F.col("_own"), "user_has_cart").otherwise("later_login")
    return _claimed(carts, logins)[1].where("not _takes").select("id", F.col("_login").alias("user_id"), "guest_token", reason.alias("reason"))


def current_cart(adds: DataFrame) -> DataFrame:
    """Latest add per owner (user, else guest)."""
    owner = F.coalesce(F.concat(F.lit("u:"), F.col("user_id").cast("string")), F.concat(F.lit("g:"), "guest_token"))
    return top_one(
        adds.withColumn("owner", owner).where("owner is not null"), ["owner"], [F.col("created_at"), F.col("id")]
    )
