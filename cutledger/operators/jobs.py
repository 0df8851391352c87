"""Cutting-job operators: status, duration, orphans, progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutledger.operators.events import event_context
from cutledger.operators.scan import HOUR_US, Running, running, time_block, top_one
from cutledger.operators.spatial import streamed
from cutledger.sources import dims

TERMINAL = ["completed", "partial", "failed"]
DOWNLOADABLE = ["completed", "partial"]
ABANDON_SECONDS = 90


def downloadable_runs(runs: DataFrame) -> DataFrame:
    """Runs whose result may be downloaded."""
    return runs.where(F.col("status").isin(DOWNLOADABLE))


def map_status(runs: DataFrame) -> DataFrame:
    """Terminal status from exit code, report and presence of output."""
    told = F.coalesce("report.status", F.lit(""))
    kept = F.col("has_output") & told.isin(DOWNLOADABLE)
    mapped = (
        F.when(F.col("exit_code") != 0, F.when(kept, "partial").otherwise("failed"))
        .when(told.isin(TERMINAL), told)
        .otherwise("failed")
    )
    return runs.withColumn("mapped_status", mapped)


def duration_ms(now: str) -> Column:
    """Run time in whole milliseconds; 0 if never started, counted to ``now`` if unfinished."""
    end = F.coalesce("finished_at", F.lit(now).cast("timestamp"))
    spent = ((F.unix_micros(end) - F.unix_micros("started_at")) / 1000).cast("bigint")
    return F.coalesce(spent, F.lit(0).cast("bigint"))


def fill_percent(placed: Column, total: Column) -> Column:
    """Percent shown while filling sheets: 12 up to 55."""
    part = F.least(F.lit(1.0), placed / total)
    return F.when(total <= 0, F.lit(12)).otherwise(F.least(F.lit(55), F.lit(12) + (part * 43).cast("int")))


def eta(started: Column, now: Column, limit_sec: Column, placed: Column, total: Column) -> Column:
    """Expected end from the placed fraction (at least 1 %), never after the time limit."""
    limit_at = F.timestamp_micros(F.unix_micros(started) + (limit_sec * 1_000_000).cast("bigint"))
    elapsed = F.unix_micros(now) - F.unix_micros(started)
    part = F.least(F.greatest(placed / total, F.lit(0.01)), F.lit(1.0))
    projected = F.timestamp_micros(F.unix_micros(started) + F.round(elapsed / part).cast("bigint"))
    usable = (F.coalesce(total, F.lit(0)) > 0) & (F.coalesce(placed, F.lit(0)) > 0) & (elapsed > 0)
    return F.when(started.isNull(), None).when(usable, F.least(projected, limit_at)).otherwise(limit_at)


def run_orphans(runs: DataFrame) -> DataFrame:
    """One row per orphan piece of a run's report."""
    return runs.select(F.col("id").alias("run_id"), "project_id", F.explode("report.orphans").alias("orphan")).select(
        "run_id", "project_id", "orphan.*"
    )


def orphans_by_reason(runs: DataFrame) -> DataFrame:
    """Orphan count per run and reason."""
    return run_orphans(runs).groupBy("run_id", "reason").agg(F.count("*").alias("n"))


def run_sizes(docs: DataFrame) -> DataFrame:
    """Sheets used and pieces placed per placement document, without exploding it."""
    placed = F.aggregate(
        "sheets", F.lit(0), lambda acc, s: acc + F.when(s["pieces"].isNull(), F.lit(0)).otherwise(F.size(s["pieces"]))
    )
    return docs.select("run_id", F.size("sheets").alias("sheets_used"), placed.alias("pieces_placed"))


def exact_quantile(df: DataFrame, value: str, p: float) -> DataFrame:
    """Interpolated quantile of an integer column, exact and without collecting it.

    Values shrink to a histogram, whose running count locates the two rows around the position.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    cum = running(
        hist.withColumn("_all", F.lit(1)),
        ["_all"],
        [F.col("v")],
        [F.floor(F.col("v") / 4096), F.floor(F.col("v") / 16_777_216)],
        [Running("upto", "sum", F.col("n"))],
    )
    total = hist.select(F.sum("n")).scalar()
    at = (total - 1) * F.lit(p)
    low, high = F.floor(at), F.ceil(at)

    def value_at(position: Column) -> Column:
        return F.max(F.when((F.col("upto") > position) & (F.col("upto") - F.col("n") <= position), F.col("v")))

    picked = cum.withColumns({"_low": low, "_high": high, "_part": at - low})
    return picked.agg(
        value_at(F.col("_low")).alias("a"), value_at(F.col("_high")).alias("b"), F.max("_part").alias("f")
    ).select((F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("quantile"))


def duration_p95(runs: DataFrame, now: str, max_s: int = dims.DURATION_P95_MAX_SECONDS) -> DataFrame:
    """95th percentile of run time against the limit."""
    spent = runs.where("started_at is not null").select(duration_ms(now).alias("ms"))
    return exact_quantile(spent, "ms", 0.95).select(
        F.col("quantile").alias("p95_ms"), (F.col("quantile") > max_s * 1000).alias("alert")
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest run per project."""
    return top_one(runs, ["project_id"], [F.col("created_at"), F.col("id")])


def latest_proposal(proposals: DataFrame) -> DataFrame:
    """Highest version per orphan."""
    return top_one(proposals, ["orphan_resolution_id"], [F.col("version"), F.col("id")])


def orphan_cards(orphans: DataFrame, resolutions: DataFrame, proposals: DataFrame, derived: DataFrame) -> DataFrame:
    """Orphans still to show: unresolved ones, and resolved ones whose split pieces exist."""
    newest = latest_proposal(proposals).select(
        F.col("orphan_resolution_id").alias("resolution_id"),
        F.col("id").alias("proposal_id"),
        F.col("version").alias("proposal_version"),
    )
    state = resolutions.select(F.col("id").alias("resolution_id"), "project_id", "piece_key", "resolution_state")
    split = derived.select("project_id", F.col("parent_piece_key").alias("piece_key")).distinct()
    named = orphans.withColumn(
        "piece_key", F.coalesce(F.nullif("piece_key", F.lit("")), F.col("piece_index").cast("string"))
    )
    return (
        named.join(state, ["project_id", "piece_key"], "left")
        .join(newest, "resolution_id", "left")
        .join(split.withColumn("_split", F.lit(True)), ["project_id", "piece_key"], "left")
        .where("resolution_state is null or resolution_state <> 'resolved' or _split")
        .withColumn("resolution_state", F.coalesce("resolution_state", F.lit("pending")))
        .drop("_split")
    )


def failed_job_runs(failed: DataFrame, jobs: DataFrame, runs: DataFrame, job_class: str = "NestingJob") -> DataFrame:
    """Processing runs whose queue job has failed; the run id is the job's first argument."""
    wanted = jobs.where(F.col("class_name") == job_class).join(
        failed.select(F.col("job_id").alias("id")).distinct(), "id", "left_semi"
    )
    args = F.from_json("arguments", "arguments array<string>")["arguments"]
    ids = wanted.select(F.get(args, 0).try_cast("bigint").alias("id")).where("id is not null").distinct()
    return runs.where("status = 'processing'").join(ids, "id", "left_semi")


def abandoned_runs(runs: DataFrame, at: str, secs: int = ABANDON_SECONDS) -> DataFrame:
    """Processing runs started ``secs`` or more ago without any output."""
    anchor = F.coalesce("started_at", "created_at")
    limit = F.lit(at).cast("timestamp") - F.expr(f"interval {secs} seconds")
    return runs.where((F.col("status") == "processing") & (anchor <= limit) & ~F.col("has_output"))


def project_status(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """Status, percent and message of each project from its latest finished run."""
    last = latest_run(runs).select(
        F.col("project_id").alias("id"),
        F.col("status").alias("run_status"),
        (
            F.col("cancel_requested_at").isNotNull()
            | F.coalesce(F.array_contains("report.warnings", "cancelled"), F.lit(False))
        ).alias("cancelled"),
    )
    ended = last.where("run_status <> 'processing'")
    message = (
        F.when(F.col("cancelled"), "nesting.cancelled")
        .when(F.col("run_status") == "completed", "nesting.completed")
        .when(F.col("run_status") == "partial", "nesting.partial")
        .otherwise("nesting.failed")
    )
    return projects.select("id").join(ended, "id").select(
        "id",
        F.col("run_status").alias("status"),
        F.when(F.col("cancelled"), 0).otherwise(100).alias("progress_percent"),
        message.alias("progress_message"),
    )


def completed_events(runs: DataFrame, docs: DataFrame, events: DataFrame, now: str) -> DataFrame:
    """Completion event of every ended run: metrics from report or placements, and who started it."""
    reasons = (
        orphans_by_reason(runs)
        .groupBy("run_id")
        .agg(
            F.sum(F.when(F.col("reason") == "oversized_for_sheet", F.col("n"))).alias("oversized"),
            F.sum(F.when(F.col("reason") == "no_sheet_capacity", F.col("n"))).alias("no_capacity"),
        )
    )
    sizes = run_sizes(docs).withColumnsRenamed({"sheets_used": "_sheets", "pieces_placed": "_pieces"})
    ended = runs.where("status <> 'processing'")
    zero = F.lit(0)
    return (
        ended.select(
            F.col("id").alias("run_id"),
            "project_id",
            "status",
            duration_ms(now).alias("duration_ms"),
            F.col("report.sheets_used").alias("_rs"),
            F.col("report.pieces_count").alias("_rp"),
        )
        .join(sizes, "run_id", "left")
        .join(reasons, "run_id", "left")
        .join(event_context(ended, events, now), "run_id", "left")
        .select(
            "run_id",
            "project_id",
            F.lit("nest_completed").alias("event_type"),
            "status",
            "duration_ms",
            F.coalesce("_rs", "_sheets", zero).alias("sheets_used"),
            F.coalesce("_rp", "_pieces", zero).alias("pieces_count"),
            F.coalesce("oversized", zero.cast("bigint")).alias("orphans_oversized"),
            F.coalesce("no_capacity", zero.cast("bigint")).alias("orphans_no_capacity"),
            "user_id",
            "anonymous_session_key",
            "locale",
        )
    )


def _along(progress: DataFrame, measures: list[Running]) -> DataFrame:
    """Running measures of progress rows per run, along time."""
    return running(progress, ["run_id"], [F.col("at"), F.col("id")], [time_block(F.col("at"), HOUR_US)], measures)


def monotonic_progress(progress: DataFrame) -> DataFrame:
    """Snapshots whose percent is not below the last kept one (which is the maximum so far)."""
    seen = _along(progress, [Running("_top", "max", F.col("percent"), False)])
    return seen.where("_top is null or percent >= _top").drop("_top")


def monotonic_eta(progress: DataFrame) -> DataFrame:
    """Expected end that never moves later within a run."""
    due = F.timestamp_micros(F.unix_micros("at") + F.col("eta_sec").cast("bigint") * 1_000_000)
    return _along(progress, [Running("estimated_finished_at", "min", due)])


def _fold_mean(alpha: float) -> Callable:
    """Fold a run's (at, id, run, value, share) rows, in order, into (run, id, mean): each mean is share + (1 - alpha) * the one before, in that order of rounding."""
    keep = float(1 - Decimal(str(alpha)))

    def fold(rows: Iterator[tuple]) -> Iterator[tuple[int, float]]:
        mean = None
        for _, own, run, value, share in rows:
            mean = value if mean is None else share + keep * mean
            yield run, own, mean

    return fold


def _smoothed(moved: DataFrame, alpha: float) -> DataFrame:
    """Exponential mean of ``_x`` per run, starting at its first value.

    Every mean is rounded from the one before, so a run is walked by one task. Its rows stream through with one number held; sums over stretches
    would differ in the last bits, and with them at the limits of the estimate.
    """
    if alpha >= 1:
        return moved.withColumn("smoothed", F.col("_x"))
    share = (F.col("_x").cast("decimal(10,0)") * F.lit(Decimal(str(alpha)))).cast("double")
    rows = moved.select("run_id", F.unix_micros("at").alias("at"), "id", F.col("run_id").alias("run"), F.col("_x").alias("value"), share.alias("share"))
    means = streamed(rows, ["run_id"], ["at", "id"], _fold_mean(alpha), "run_id long, id long, smoothed double")
    return moved.join(means, ["run_id", "id"])


def ewma_eta(progress: DataFrame, alpha: float = 0.3, time_limit_sec: float | None = None) -> DataFrame:
    """Smoothed percent and remaining seconds; needs a started_at column."""
    moved = progress.where("percent > 0").withColumn("_x", F.least(F.col("percent"), F.lit(100)).cast("double"))
    smoothed = _smoothed(moved, alpha).drop("_x")
    rows = smoothed.unionByName(progress.where("percent <= 0"), allowMissingColumns=True)
    elapsed = (F.unix_micros("at") - F.unix_micros("started_at")) / 1e6
    if time_limit_sec is not None:
        raw = F.greatest(F.lit(0.0), F.lit(float(time_limit_sec)) - elapsed)
    else:
        raw = F.when(
            (elapsed >= 3.0) & (F.col("smoothed") >= 5.0), elapsed * (100.0 - F.col("smoothed")) / F.col("smoothed")
        )
    guess = F.when(F.col("smoothed") >= 99.9, F.lit(0)).when(raw.isNotNull(), F.greatest(F.rint(raw), F.lit(0.0)).cast("bigint"))
    return _along(rows, [Running("eta_sec_smoothed", "min", guess)])


KEPT = "run_id bigint, id bigint, at timestamp, percent int"


def _keep_spaced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Within a stretch, keep the first row and then each one a second or more after the last kept."""
    stretch, last = None, 0
    for batch in batches:
        times = batch["at"].astype("datetime64[us]").astype("int64").to_numpy()
        keep = []
        for i, key in enumerate(zip(batch["run_id"].to_numpy(), batch["stretch"].to_numpy())):
            if key != stretch or times[i] - last >= 1_000_000:
                stretch, last = key, times[i]
                keep.append(i)
        yield batch.iloc[keep][["run_id", "id", "at", "percent"]]


def throttle_progress(progress: DataFrame) -> DataFrame:
    """Snapshots a throttled writer would write: percent lifted to the last kept, kept on a rise or after 1 s.

    Percents are whole, so every rise is kept and the last kept percent is the running maximum. A rise, or
    a row a second after the one before it, starts a stretch of its own whatever came earlier; only the
    rows inside a stretch have to be walked in order, with one timestamp of memory.
    """
    seen = _along(
        progress.select("run_id", "id", "at", "percent"),
        [Running("_top", "max", F.col("percent"), False), Running("_prev", "max", F.unix_micros("at"), False)],
    )
    fresh = (
        F.col("_top").isNull()
        | (F.col("percent") > F.col("_top"))
        | (F.unix_micros("at") - F.col("_prev") >= 1_000_000)
    )
    lifted = seen.withColumns({"percent": F.greatest("percent", "_top"), "_head": F.when(fresh, F.col("id"))})
    marked = _along(lifted, [Running("stretch", "last", F.col("_head"))])
    return (
        marked.select("run_id", "stretch", "id", "at", "percent")
        .repartition("run_id", "stretch")
        .sortWithinPartitions("run_id", "stretch", "at", "id")
        .mapInPandas(_keep_spaced, KEPT)
    )
