"""Streaming event operators: ingestion, de-duplication, limits, alerts, live counts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cutledger.operators.events import NO_TIME, backfill_users, first_logins, principal, validate_events
from cutledger.operators.scan import HOUR_US, top_one
from cutledger.session import shared_path
from cutledger.sources import dims
from cutledger.streaming.ordered import InOrder, bucketed, in_order
from cutledger.streaming.runtime import DEFAULT_DELAY, Closing, finish, nullable, watermarked

THROTTLED_PATHS = {
    "auth": r"^(/iniciar-sesion|/crear-cuenta|/)$",
    "payment": r"^/checkout/(pagar|pagos/[^/]+/(sinpe|tarjeta))$",
}


def _read_or_none(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame | None:
    """A table that does not exist before the first batch; it may have no file yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else None


KEY_BUCKETS = 256
#: Folder columns of the stored events.
PLACED = [T.StructField("batch_id", T.IntegerType()), T.StructField("day", T.DateType())]


def ingest(stream: DataFrame, root: str, delay: str = DEFAULT_DELAY, received: str | None = None) -> None:
    """Validate, de-duplicate for ever and store events under ``root``; refused rows go to the dead letter.

    Tables: events and dead_letter (one folder per batch, partitioned by day), keys (seen idempotency keys, in folders by a hash of the
    key), high_water (latest time per batch). A batch overwrites its own folders and never reads a clock, so a replayed batch gives the
    same tables. An event without a time takes that of the column ``received``, else it is refused. Within a batch the lowest id of a key
    wins; keys of earlier batches are found in the key folders that the batch hits.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = f"batch_id < {int(batch_id)}"
        timed = batch.withColumn("occurred_at", F.coalesce("occurred_at", received)) if received else batch
        checked = validate_events(timed)
        marks = _read_or_none(spark, f"{root}/high_water", "latest timestamp, batch_id int")
        seen = marks.where(earlier).agg(F.max("latest")).first()[0] if marks is not None else None
        late = F.lit(False)
        if seen is not None:
            late = F.col("occurred_at") < F.lit(seen) - F.expr(f"interval {delay}")
        untimed = F.when(F.col("occurred_at").isNull(), F.lit("missing: occurred_at"))
        reason = F.coalesce("reject_reason", untimed, F.when(late, F.lit("late")))
        checked = checked.withColumn("reject_reason", reason).persist()
        try:
            good = checked.where("reject_reason is null").drop("reject_reason")
            key = F.coalesce(
                F.concat(F.lit("k:"), "idempotency_key"), F.concat(F.lit("id:"), F.col("id").cast("string"))
            )
            good = top_one(good.withColumn("_key", key), ["_key"], [F.col("id")], lowest=True)
            good = good.withColumn("bucket", F.pmod(F.xxhash64("idempotency_key"), F.lit(KEY_BUCKETS)).cast("int"))
            stored = _read_or_none(spark, f"{root}/keys", "idempotency_key string, batch_id int, bucket int")
            if stored is not None:
                hit = [r.bucket for r in good.where("idempotency_key is not null").select("bucket").distinct().collect()]
                known = stored.where(earlier).where(F.col("bucket").isin(hit)).select("idempotency_key")
                good = good.join(known, "idempotency_key", "left_anti")
            good = good.persist()

            def write(df: DataFrame, name: str) -> None:
                dated = df.withColumn("day", F.to_date("occurred_at"))
                dated.write.mode("overwrite").partitionBy("day").parquet(f"{root}/{name}/batch_id={batch_id}")

            keys = good.where("idempotency_key is not null").select("idempotency_key", "bucket")
            # the keys go last: a batch that fails before is replayed as if it had not been seen
            write(good.select(batch.columns), "events")
            write(checked.where("reject_reason is not null"), "dead_letter")
            latest = checked.agg(F.max("occurred_at").alias("latest"))
            latest.write.mode("overwrite").parquet(f"{root}/high_water/batch_id={batch_id}")
            keys.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/keys/batch_id={batch_id}")
            good.unpersist()
        finally:
            checked.unpersist()

    finish(stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{root}/state"))


def ingested(stream: DataFrame, delay: str = DEFAULT_DELAY) -> tuple[DataFrame, DataFrame]:
    """Run ``ingest`` into a new shared folder; returns the stored events and the dead letter."""
    spark = stream.sparkSession
    root = shared_path(spark, "ingest")
    ingest(stream, root, delay)
    kept = nullable(stream.schema)
    refused = T.StructType([*kept.fields, T.StructField("reject_reason", T.StringType())])

    def stored(name: str, schema: T.StructType) -> DataFrame:
        found = _read_or_none(spark, f"{root}/{name}", T.StructType([*schema.fields, *PLACED]))
        return spark.createDataFrame([], schema) if found is None else found

    return stored("events", kept), stored("dead_letter", refused)


class FirstOfKey(StatefulProcessor):
    """Lowest id of each key among the rows of a batch, unless an earlier batch had the key; a key is known until ``expires_ms`` of its row."""

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "block binary")

    def _keep(self, known: dict[str, int]) -> None:
        if known:
            self.known.update((pickle.dumps(known),))
            self.handle.registerTimer(min(known.values()))
        else:
            self.known.clear()

    def _load(self) -> dict[str, int]:
        return pickle.loads(self.known.get()[0]) if self.known.exists() else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, best = self._load(), None
        for batch in rows:
            fresh = batch[~batch["idempotency_key"].isin(known)]
            best = fresh if best is None else pd.concat([best, fresh])
            best = best.sort_values("id", kind="stable").drop_duplicates("idempotency_key")
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        mark = timerValues.getCurrentWatermarkInMs()
        known.update(zip(best["idempotency_key"].tolist(), (max(int(t), mark + 1) for t in best["expires_ms"].tolist())))
        self._keep(known)
        yield best[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self._keep({k: t for k, t in self._load().items() if t > mark})
        yield pd.DataFrame([], columns=self.columns)

    def close(self) -> None:
        pass


def dedup_stream(stream: DataFrame, delay: str = DEFAULT_DELAY, closing: Closing | None = None) -> DataFrame:
    """First event per idempotency key within the delay; events without a key all pass.

    Of the events of a key that come in one batch the lowest id passes, wherever they lie in it. Keys are held in hash groups.
    """
    rows = watermarked(stream.where("idempotency_key is not null"), "occurred_at", delay, closing)
    # whole numbers with nulls would become floats on their way through pandas
    text = [f.name for f in stream.schema.fields if isinstance(f.dataType, T.LongType) and f.name != "id"]
    packed = [F.col(c).cast("string").alias(c) if c in text else F.col(c) for c in stream.columns]
    ends = F.coalesce(F.unix_millis(F.col("occurred_at") + F.expr(f"interval {delay}")), F.lit(0))
    keyed = rows.select(*packed, ends.alias("expires_ms"))
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in text else f.dataType) for f in stream.schema.fields])
    first = bucketed(keyed, "idempotency_key").transformWithStateInPandas(FirstOfKey(stream.columns), schema, "Append", "EventTime")
    plain = [F.col(c).cast("long").alias(c) if c in text else F.col(c) for c in stream.columns]
    return first.select(*plain).unionByName(stream.where("idempotency_key is null"))


class AcceptedInHour(InOrder):
    """Keeps the times of the events accepted from one principal in the last hour (at most the limit)."""

    ROW, STATE = "at_us bigint, id bigint", "accepted array<bigint>"
    OUT = ["id", "principal", "at_us", "accepted"]
    keep_ms = HOUR_US // 1000

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def step(self, key, row, state):
        at, event_id = row
        kept = [t for t in (state[0] if state else []) if t >= at - HOUR_US]
        ok = len(kept) < self.limit
        return ([*kept, at] if ok else kept,), [(event_id, key[0], at, ok)]


def rate_limit(
    stream: DataFrame, limit: int = dims.LOW_PRIORITY_PER_HOUR, delay: str = DEFAULT_DELAY, closing: Closing | None = None
) -> DataFrame:
    """Accepted flag per event: a low-priority one is refused once the limit was accepted in the hour before.

    Only low-priority events with a principal reach the keyed state, which decides on them once the watermark has passed them; the others
    pass straight on. The state is kept per user, else per session, so sessions should be resolved to users first.
    """
    rows = stream.select("id", "priority", "occurred_at", principal().alias("principal"), F.unix_micros("occurred_at").alias("at_us"))
    held = (F.col("priority") == "low") & F.col("principal").isNotNull()
    limited = in_order(
        watermarked(rows.where(held).drop("priority"), "occurred_at", delay, closing),
        "principal",
        AcceptedInHour(limit),
        "id bigint, principal string, at_us bigint, accepted boolean",
    )
    free = rows.where(~held).select("id", "principal", "at_us", F.lit(True).alias("accepted"))
    return limited.unionByName(free)


def bot_alerts(
    stream: DataFrame, limit: int = dims.LOW_PRIORITY_PER_HOUR, delay: str = DEFAULT_DELAY, closing: Closing | None = None
) -> DataFrame:
    """Sliding hours (every 5 minutes) with more low-priority events than the limit."""
    return (
        watermarked(stream.where(F.col("priority") == "low"), "occurred_at", delay, closing)
        .groupBy(F.window("occurred_at", "1 hour", "5 minutes").alias("w"))
        .agg(F.count("*").alias("low_priority_count"))
        .where(F.col("low_priority_count") > limit)
        .select(F.col("w.start").alias("window_start"), "low_priority_count")
    )


def request_throttle(stream: DataFrame, limit: int = 5, delay: str = DEFAULT_DELAY, closing: Closing | None = None) -> DataFrame:
    """Addresses with more than ``limit`` posts to sign-in or payment paths within a minute.

    Requests have at, method, path and ip.
    """
    rule = F.coalesce(*[F.when(F.col("path").rlike(p), F.lit(n)) for n, p in THROTTLED_PATHS.items()])
    posts = stream.where(F.upper("method") == "POST").withColumn("rule", rule).where("rule is not null")
    return (
        watermarked(posts, "at", delay, closing)
        .groupBy(F.window("at", "1 minute").alias("w"), "rule", "ip")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > limit)
        .select(F.col("w.start").alias("window_start"), "rule", "ip", "n")
    )


class LastAlert(InOrder):
    """Time of the last alert let through for one key."""

    ROW, STATE = "at_us bigint, id bigint", "let_us bigint"
    OUT = ["alert_key", "id", "at_us"]

    def __init__(self, gap_us: int) -> None:
        self.gap_us = gap_us
        self.keep_ms = gap_us // 1000

    def step(self, key, row, state):
        at, alert_id = row
        if state is None or at - state[0] >= self.gap_us:
            return (at,), [(key[0], alert_id, at)]
        return state, []


def alert_throttle(stream: DataFrame, minutes: int = 5, delay: str = DEFAULT_DELAY, closing: Closing | None = None) -> DataFrame:
    """First alert per key, then none for ``minutes`` after each one let through; alerts have alert_key, id, at."""
    rows = watermarked(stream, "at", delay, closing).select("alert_key", "id", "at", F.unix_micros("at").alias("at_us"))
    return in_order(rows, "alert_key", LastAlert(minutes * 60_000_000), "alert_key string, id bigint, at_us bigint")


def live_funnel(stream: DataFrame, width: str = "1 day", delay: str = DEFAULT_DELAY, closing: Closing | None = None) -> DataFrame:
    """Event rows per funnel stage and time window."""
    return (
        watermarked(stream.where(F.col("event_type").isin(dims.FUNNEL_STAGES)), "occurred_at", delay, closing)
        .groupBy(F.window("occurred_at", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n")
    )


def live_status(stream: DataFrame, width: str = "1 day", delay: str = DEFAULT_DELAY, closing: Closing | None = None) -> DataFrame:
    """Payments per status and time window."""
    return (
        watermarked(stream, "created_at", delay, closing)
        .groupBy(F.window("created_at", width).alias("w"), "status")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "status", "n")
    )


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = DEFAULT_DELAY, closing: Closing | None = None) -> DataFrame:
    """Stretches of activity per anonymous session, ended by a pause longer than the gap."""
    return (
        watermarked(stream.where("anonymous_session_key is not null"), "occurred_at", delay, closing)
        .groupBy(F.session_window("occurred_at", gap).alias("w"), "anonymous_session_key")
        .agg(F.count("*").alias("n"))
        .select("anonymous_session_key", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n")
    )


LOGIN = T.StructType(
    [T.StructField("anonymous_session_key", T.StringType()), T.StructField("user_id", T.LongType()), T.StructField("logged_in_at", T.TimestampType())]
)


def record_logins(logins: DataFrame, root: str) -> None:
    """Keep who logged in with which anonymous session, for reading events with ``identified``.

    Logins have anonymous_session_key, user_id and, to tell the first one, logged_in_at; those without a session or user are passed over. The
    stored events are not touched: each batch has a folder of its own under ``root``/logins with its first logins, and a replayed batch
    overwrites that folder with the same rows.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        timed = batch if "logged_in_at" in batch.columns else batch.withColumn("logged_in_at", F.lit(None))
        given = timed.where("trim(anonymous_session_key) <> '' and user_id is not null").select(*[F.col(f.name).cast(f.dataType) for f in LOGIN.fields])
        place = F.struct(F.coalesce("logged_in_at", F.lit(NO_TIME).cast("timestamp")), "user_id")
        first = given.groupBy("anonymous_session_key").agg(F.min_by(F.struct("user_id", "logged_in_at"), place).alias("login"))
        first.select("anonymous_session_key", "login.*").write.mode("overwrite").parquet(f"{root}/logins/batch_id={batch_id}")

    finish(logins.writeStream.foreachBatch(store).option("checkpointLocation", f"{root}/state"))


def identities(spark: SparkSession, root: str) -> DataFrame:
    """First user of each session over all recorded logins, whatever order they came in."""
    found = _read_or_none(spark, f"{root}/logins", T.StructType([*LOGIN.fields, PLACED[0]]))
    return first_logins(spark.createDataFrame([], LOGIN) if found is None else found)


def identified(events: DataFrame, root: str) -> DataFrame:
    """Events as they read once sessions are known: an anonymous event has the user who first logged in with its session."""
    return backfill_users(events, identities(events.sparkSession, root))
