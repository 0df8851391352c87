"""Streaming checkout locks and gateway state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.operators.payments import match_webhooks
from cutledger.sources import dims
from cutledger.streaming.ordered import DAY_MS, InOrder, in_order
from cutledger.streaming.runtime import DEFAULT_DELAY, Closing, watermarked


class LockClock(InOrder):
    """Releases one payment's lock when its window passes without another row closing it."""

    ROW, STATE = "at_us bigint, closing int", "due_ms bigint"
    OUT = ["payment_id", "released_us", "reason"]

    def __init__(self, window_ms: int) -> None:
        self.window_ms = window_ms

    def due(self, state):
        return state[0]

    def ring(self, key, at_ms, state):
        return None, [(key[0], at_ms * 1000, "timeout")]

    def step(self, key, row, state):
        at, closing = row
        if state is None:
            return (None if closing else (at // 1000 + self.window_ms,)), []
        return (None if closing and at // 1000 < state[0] else state), []


def lock_timeouts(
    stream: DataFrame, minutes: int = dims.LOCK_MINUTES, delay: str = DEFAULT_DELAY, closing: Closing | None = None
) -> DataFrame:
    """Releases of pending transfer checkouts left alone for ``minutes``.

    The stream has payment_id, at and waiting: true when a pending transfer checkout opens, false when
    it is released, superseded, abandoned or settled.
    """
    rows = watermarked(stream, "at", delay, closing).select(
        "payment_id", "at", F.unix_micros("at").alias("at_us"), (~F.col("waiting")).cast("int").alias("closing")
    )
    return in_order(rows, "payment_id", LockClock(minutes * 60_000), "payment_id bigint, released_us bigint, reason string")


def gateway_step(status: str, abandoned: bool, card: bool, kind: str) -> tuple[str, bool, str]:
    """Next (status, abandoned) of a payment and what happened, for one gateway event."""
    if kind == "payment-intent.succeeded":
        return ("succeeded", abandoned, "already_fulfilled") if status == "succeeded" else ("succeeded", False, "fulfilled")
    if kind != "payment-intent.failed":
        return status, abandoned, "ignored"
    if abandoned:
        return status, True, "already_abandoned"
    if card and status != "succeeded":
        return "pending", True, "abandoned"
    return ("failed", False, "already_terminal") if status == "failed" else ("failed", False, "failed")


class GatewayState(InOrder):
    """Status of one payment as its gateway events arrive."""

    ROW = "at_us bigint, event_no bigint, type string, status string, abandoned boolean, card boolean"
    STATE = "status string, abandoned boolean"
    OUT = ["payment_intent_id", "event_no", "status", "abandoned", "outcome"]

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def step(self, key, row, state):
        _, event_no, kind, status, abandoned, card = row
        status, abandoned, what = gateway_step(*(state or (status, bool(abandoned))), bool(card), kind)
        return (status, abandoned), [(key[0], event_no, status, abandoned, what)]


def payment_states(
    gateway: DataFrame, payments: DataFrame, delay: str = DEFAULT_DELAY, keep_days: int = 90, closing: Closing | None = None
) -> DataFrame:
    """State of payments along their gateway events; repeats change nothing.

    A failed card attempt counts as abandoned, not failed, and a late success still fulfils. Events of
    unknown intents are left out here; ``match_webhooks`` reports them. An intent without an event for ``keep_days`` is forgotten and
    starts again from the stored payment.
    """
    known = payments.where("onvo_payment_intent_id is not null").select(
        F.col("onvo_payment_intent_id").alias("payment_intent_id"),
        "status",
        F.col("checkout_abandoned_at").isNotNull().alias("abandoned"),
        F.col("payment_method").isin("card_crc", "card_usd").alias("card"),
    )
    rows = watermarked(gateway, "at", delay, closing).select("payment_intent_id", "type", "event_no", "at", F.unix_micros("at").alias("at_us"))
    return in_order(
        rows.join(known, "payment_intent_id"),
        "payment_intent_id",
        GatewayState(keep_days * DAY_MS),
        "payment_intent_id string, event_no bigint, status string, abandoned boolean, outcome string",
    )


def unmatched_webhooks(gateway: DataFrame, payments: DataFrame) -> DataFrame:
    """Gateway events without a payment, for the dead letter."""
    return match_webhooks(gateway, payments).where("error is not null").select("payment_intent_id", "event_no", "error")
