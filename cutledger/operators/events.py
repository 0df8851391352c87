"""Event-log operators: filters, funnel, conversion, de-duplication, as-of context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutledger.operators.scan import HOUR_US, Running, running, time_block, top_one
from cutledger.sources import dims


def json_text(column: str, key: str) -> Column:
    """Text value of one key of a JSON object column."""
    return F.get_json_object(column, f"$.{key}")


def filter_events(
    events: DataFrame,
    start: str,
    end: str,
    locale: str | None = None,
    payment_method: str | None = None,
    currency: str | None = None,
) -> DataFrame:
    """Events of the UTC days start..end inclusive, with optional locale and JSON property filters."""
    out = events.where(
        (F.col("occurred_at") >= F.lit(start).cast("timestamp"))
        & (F.col("occurred_at") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    )
    if locale:
        out = out.where(F.col("locale") == locale)
    if payment_method:
        out = out.where(json_text("properties", "payment_method") == payment_method)
    if currency:
        out = out.where(json_text("properties", "currency") == currency)
    return out


def funnel(events: DataFrame) -> DataFrame:
    """Event rows per funnel stage, zero where a stage never occurred."""
    counts = (
        events.where(F.col("event_type").isin(dims.FUNNEL_STAGES)).groupBy("event_type").agg(F.count("*").alias("n"))
    )
    stages = dims.funnel_stages(events.sparkSession)
    return stages.join(counts, "event_type", "left").select(
        "stage_no", "event_type", F.coalesce("n", F.lit(0)).alias("n")
    )


def conversion(events: DataFrame, min_pct: float = dims.CONVERSION_MIN_PERCENT) -> DataFrame:
    """Succeeded payments per paywall view in percent, with the low-conversion alert."""
    seen = events.agg(
        F.count_if(F.col("event_type") == "paywall_viewed").alias("paywall_count"),
        F.count_if(F.col("event_type") == "payment_succeeded").alias("succeeded_count"),
    )
    pct = F.when(
        F.col("paywall_count") > 0, F.round(F.col("succeeded_count") / F.col("paywall_count") * 100, 1)
    ).otherwise(F.lit(0.0))
    return seen.withColumn("conversion_percent", pct).withColumn(
        "conversion_alert", F.col("conversion_percent") < min_pct
    )


def bot_flag(events: DataFrame, at: str, limit: int = dims.LOW_PRIORITY_PER_HOUR) -> DataFrame:
    """Low-priority events of the hour before ``at``, flagged above the limit."""
    moment = F.lit(at).cast("timestamp")
    return (
        events.where((F.col("priority") == "low") & (F.col("occurred_at") >= moment - F.expr("interval 1 hour")))
        .where(F.col("occurred_at") <= moment)
        .agg(F.count("*").alias("low_priority_count"))
        .withColumn("bot_heuristic", F.col("low_priority_count") > limit)
    )


def facets(events: DataFrame) -> DataFrame:
    """Distinct locales, payment methods and currencies, as (facet, value) rows from one scan."""
    pairs = F.create_map(
        F.lit("locale"),
        F.col("locale"),
        F.lit("payment_method"),
        json_text("properties", "payment_method"),
        F.lit("currency"),
        json_text("properties", "currency"),
    )
    return events.select(F.explode(pairs).alias("facet", "value")).where("value is not null").distinct()


def dedup_events(events: DataFrame) -> DataFrame:
    """First event (lowest id) per idempotency key; events without a key are all kept."""
    keyed = events.where("idempotency_key is not null")
    first = top_one(keyed, ["idempotency_key"], [F.col("id")], lowest=True)
    return first.unionByName(events.where("idempotency_key is null"))


def principal() -> Column:
    """Who an event counts against: the user, else the anonymous session."""
    return F.coalesce(
        F.concat(F.lit("u:"), F.col("user_id").cast("string")), F.concat(F.lit("s:"), "anonymous_session_key")
    )


def trailing_hour_count(events: DataFrame) -> DataFrame:
    """Low-priority events per principal in the hour up to and including each event.

    An event at time t only looks at its own hour slice and the one before, so each row is also sent to
    the next slice as context; a busy principal is thus spread over its hours.
    """
    low = events.where(F.col("priority") == "low").select(
        "id", principal().alias("principal"), "occurred_at", F.unix_micros("occurred_at").alias("_us")
    )
    low = low.where("principal is not null")
    own = time_block(F.col("occurred_at"))
    sliced = low.withColumn("_slice", F.explode(F.array(own, own + 1)))
    recent = Window.partitionBy("principal", "_slice").orderBy("_us").rangeBetween(-HOUR_US, 0)
    return (
        sliced.withColumn("low_in_hour", F.count("*").over(recent))
        .where(F.col("_slice") == own)
        .select("id", "principal", "occurred_at", "low_in_hour")
    )


CONTEXT = ["user_id", "anonymous_session_key", "tab_id", "ip", "user_agent", "country_code", "locale"]


def event_context(runs: DataFrame, events: DataFrame, now: str, default_locale: str = "es") -> DataFrame:
    """Who started each run: the project's latest event at or before the start, else its latest workshop
    event at or before the finish (open runs finish at ``now``).

    Runs and events are merged on one time line per project; a running last value picks the event.
    """
    primary = F.coalesce("started_at", "created_at")
    fallback = F.coalesce("finished_at", F.lit(now).cast("timestamp"))
    context = F.struct("occurred_at", F.col("id").alias("event_id"), *CONTEXT)
    lane = events.select(
        "project_id",
        F.col("occurred_at").alias("t"),
        F.lit(0).alias("kind"),
        F.col("id").alias("no"),
        context.alias("any_event"),
        F.when(F.col("event_type").isin(dims.WORKSHOP_TYPES), context).alias("workshop_event"),
    )
    anchors = runs.select(
        "project_id",
        F.col("id").alias("no"),
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(primary.alias("t"), F.lit(1).alias("kind")),
                    F.when(fallback > primary, F.struct(fallback.alias("t"), F.lit(2).alias("kind"))),
                )
            )
        ).alias("anchor"),
    ).select("project_id", F.col("anchor.t").alias("t"), F.col("anchor.kind").alias("kind"), "no")
    line = lane.unionByName(anchors, allowMissingColumns=True).where("project_id is not null")
    seen = running(
        line,
        ["project_id"],
        [F.col("t"), F.col("kind"), F.col("no")],
        [time_block(F.col("t"))],
        [Running("near", "last", F.col("any_event")), Running("workshop", "last", F.col("workshop_event"))],
    ).where("kind > 0")
    found = seen.groupBy(F.col("no").alias("run_id")).agg(
        F.max(F.when(F.col("kind") == 1, F.col("near"))).alias("near"),
        F.max(F.when(F.col("kind") == 2, F.col("workshop"))).alias("workshop"),
    )
    chosen = found.select("run_id", F.coalesce("near", "workshop").alias("c"))
    return chosen.select(
        "run_id",
        F.col("c.event_id").alias("event_id"),
        *[F.col(f"c.{c}").alias(c) for c in CONTEXT[:-1]],
        F.coalesce("c.locale", F.lit(default_locale)).alias("locale"),
    )


def user_timeline(events: DataFrame, user_ids: list[int] | None = None) -> DataFrame:
    """Events of the given users (all users if none given), newest first."""
    picked = events.where("user_id is not null") if user_ids is None else events.where(F.col("user_id").isin(user_ids))
    return picked.orderBy("user_id", F.desc("occurred_at"), F.desc("id"))


def validate_events(events: DataFrame) -> DataFrame:
    """Catalog check: sets the catalog priority and a reason for every row that must be refused.

    Works on tables and streams alike; the catalog has a fixed 13 rows and is broadcast.
    """
    known = dims.catalog(events.sparkSession).select(
        F.col("event_type").alias("_type"), F.col("priority").alias("_priority"), "required_properties"
    )
    trimmed = events.withColumn("event_type", F.trim("event_type"))
    props = F.from_json("properties", "map<string,string>")
    joined = trimmed.join(F.broadcast(known), F.col("event_type") == F.col("_type"), "left").withColumn("_props", props)
    missing = F.filter(
        "required_properties", lambda k: F.coalesce(F.trim(F.element_at(F.col("_props"), k)), F.lit("")) == ""
    )
    reason = F.when(F.coalesce("event_type", F.lit("")) == "", "event_type required").when(
        F.col("_type").isNull(), "not registered"
    ).when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))
    return (
        joined.withColumn("reject_reason", reason)
        .withColumn("priority", F.col("_priority"))
        .drop("_type", "_priority", "_props", "required_properties")
    )


#: Where a login without a time stands.
NO_TIME = "9999-12-31"


def first_logins(logins: DataFrame) -> DataFrame:
    """First user of each session: by logged_in_at if there is one, then the lower user."""
    last = F.lit(NO_TIME).cast("timestamp")
    when = F.coalesce("logged_in_at", last) if "logged_in_at" in logins.columns else last
    place = F.struct(when.alias("at"), F.col("user_id"))
    return logins.groupBy("anonymous_session_key").agg(F.min_by("user_id", place).alias("user_id"))


def backfill_users(events: DataFrame, logins: DataFrame) -> DataFrame:
    """Give anonymous events the user who later logged in with their session.

    The first login by ``logged_in_at`` wins; logins at the same time, or without that column, go by the lower user.
    """
    who = first_logins(logins).withColumnRenamed("user_id", "_login_user")
    return (
        events.join(who, "anonymous_session_key", "left")
        .withColumn("user_id", F.coalesce("user_id", "_login_user"))
        .drop("_login_user")
        .select(events.columns)
    )


def resolve_event_country(df: DataFrame) -> DataFrame:
    """Event country: the edge header (upper-cased) if given, else the address lookup."""
    header = F.upper(F.when(F.trim("header_country") != "", F.col("header_country")))
    return df.withColumn("country_code", F.coalesce(header, "ip_country"))


