"""Streaming progress and run time-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.operators.jobs import ABANDON_SECONDS
from cutledger.sources.documents import read_progress
from cutledger.streaming.ordered import DAY_MS, InOrder, in_order
from cutledger.streaming.runtime import DEFAULT_DELAY, Closing, watermarked


class RunProgress(InOrder):
    """Highest percent and earliest expected end of one run."""

    ROW = "at_us bigint, id bigint, phase_id string, percent int, eta_sec bigint"
    STATE = "percent int, due_us bigint"
    OUT = ["run_id", "id", "phase_id", "percent", "due_us"]

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def step(self, key, row, state):
        at, snapshot, phase, percent, eta = row
        top, due = state or (None, None)
        if top is not None and percent < top:
            return state, []
        if eta is not None:
            guess = at + eta * 1_000_000
            due = guess if due is None else min(due, guess)
        return (percent, due), [(key[0], snapshot, phase, percent, due)]


def progress_stream(stream: DataFrame, delay: str = DEFAULT_DELAY, keep_days: int = 2, closing: Closing | None = None) -> DataFrame:
    """Valid progress documents in order of percent, with an expected end that never moves later.

    The stream has run_id, id, at and the document text in ``doc``. A run without a snapshot for ``keep_days`` is forgotten.
    """
    rows = watermarked(read_progress(stream), "at", delay, closing).select(
        "run_id", "id", "at", F.unix_micros("at").alias("at_us"), "phase_id", "percent", F.col("eta_sec").cast("bigint").alias("eta_sec")
    )
    return in_order(
        rows, "run_id", RunProgress(keep_days * DAY_MS), "run_id bigint, id bigint, phase_id string, percent int, due_us bigint"
    )


RANKS = {"started": 0, "output": 1, "cancel": 2, "finished": 3}


class RunClock(InOrder):
    """Watches one run: no output after the abandon delay, or the time limit reached."""

    ROW = "at_us bigint, rank int, limit_sec bigint, eta_sec bigint"
    STATE = "started_ms bigint, limit_ms bigint, has_output boolean, eta_ms bigint, told_ms bigint"
    OUT = ["run_id", "status", "warning", "at_us"]

    def __init__(self, abandon_ms: int) -> None:
        self.abandon_ms = abandon_ms

    def due(self, state):
        started, limit, has_output, eta, told = state
        ahead = [started + limit, None if has_output else started + self.abandon_ms, eta]
        return min((t for t in ahead if t is not None and t > told), default=None)

    def ring(self, key, at_ms, state):
        started, limit, has_output, eta, _ = state
        if at_ms >= started + limit:
            return None, [(key[0], "partial", "time_limit_reached", at_ms * 1000)]
        if at_ms == started + self.abandon_ms and not has_output:
            return None, [(key[0], "failed", "abandoned", at_ms * 1000)]
        return (started, limit, has_output, eta, at_ms), [(key[0], "processing", "eta_overrun", at_ms * 1000)]

    def step(self, key, row, state):
        at, rank, limit, eta = row
        ms = at // 1000
        if rank == RANKS["started"]:
            return (ms, limit * 1000, False, None if eta is None else ms + eta * 1000, ms), []
        if state is None or rank == RANKS["finished"]:
            return None, []
        if rank == RANKS["cancel"]:
            return None, [(key[0], "failed", "cancelled", at)]
        started, limit_ms, _, eta_ms, told = state
        return (started, limit_ms, True, eta_ms, told), []


def run_timeouts(stream: DataFrame, secs: int = ABANDON_SECONDS, delay: str = DEFAULT_DELAY, closing: Closing | None = None) -> DataFrame:
    """Status changes forced by the clock or by a cancel request.

    The stream has run_id, kind (started, output, cancel, finished), at, limit_sec and eta_sec. A time-out counts before what happens later,
    and after what happens at the same millisecond.
    """
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in RANKS.items()])
    known = stream.withColumn("rank", rank).where("rank is not null")
    rows = watermarked(known, "at", delay, closing).select(
        "run_id", "at", F.unix_micros("at").alias("at_us"), "rank",
        F.col("limit_sec").cast("bigint").alias("limit_sec"), F.col("eta_sec").cast("bigint").alias("eta_sec"),
    )
    return in_order(rows, "run_id", RunClock(secs * 1000), "run_id bigint, status string, warning string, at_us bigint")
