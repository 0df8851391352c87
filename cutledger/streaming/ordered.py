"""Keyed state that sees the rows of a key in event-time order, whatever batches and chunks they come in."""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
#: Keys are dealt into so many groups by hash; a group keeps its keys' rows and states together, as a call of the state store costs more than a row.
BUCKETS = 2_048


def _plain(value):
    """Values as the state store takes them: whole numbers as int, missing as None."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value.item() if hasattr(value, "item") else value


def plain_rows(batch: pd.DataFrame, columns: list[str]) -> list[tuple]:
    """Rows of a batch as plain tuples."""
    cells = [batch[c] for c in columns]
    return list(zip(*[c.tolist() if c.dtype.kind in "iub" else list(map(_plain, c.tolist())) for c in cells]))


def bucketed(rows: DataFrame, key: str):
    """The rows grouped by the hash group of ``key``, for a processor that holds many keys."""
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).groupBy("_bucket")


class InOrder(StatefulProcessor):
    """Rows wait in state until the watermark has passed them, then meet ``step`` in order of time and tie-break.

    A subclass names ROW (columns kept per row, starting with at_us and the tie-break), STATE (what its state holds) and OUT, and
    defines ``step(key, row, state) -> (state, rows)``. With ``due(state)`` it may ask to be woken at a time of its own:
    ``ring(key, at_ms, state) -> (state, rows)`` runs then, before any later row. State without new rows for ``keep_ms`` of event
    time is dropped. The keys of a hash group share one call, one stored list of waiting rows (a block per batch) and one timer: at the
    earliest waiting row, own time or end of retention of any of them.
    """

    ROW = STATE = ""
    OUT: list[str] = []
    keep_ms: int | None = None
    key_column = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.columns = [self.key_column, *(part.split()[0] for part in self.ROW.split(","))]
        self.waiting = handle.getListState("waiting", "block binary")
        self.states = handle.getValueState("states", "block binary")

    def step(self, key, row, state):
        raise NotImplementedError

    def due(self, state) -> int | None:
        return None

    def ring(self, key, at_ms: int, state):
        return state, []

    def _wake(self, at_ms: int) -> None:
        timers = list(self.handle.listTimers())
        if not timers or at_ms < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            came = plain_rows(batch, self.columns)
            if came:
                self.waiting.appendValue((pickle.dumps(came),))
                least = min(r[1] for r in came)
                first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first // 1000)
        yield pd.DataFrame([], columns=self.OUT)

    def _advance(self, key, rows: list[tuple], mark: int, state, last):
        """Take one key's ready rows and its own times up to the watermark; returns (state, last, rows to give out)."""
        out = []
        for row in [*rows, None]:
            upto = mark if row is None else row[0] // 1000
            while state is not None and (at := self.due(state)) is not None and (at <= upto if row is None else at < upto):
                state, more = self.ring(key, at, state)
                out += more
            if row is not None:
                if state is not None and self.keep_ms is not None and upto > last + self.keep_ms:
                    state = None
                last = upto
                state, more = self.step(key, row, state)
                out += more
        if state is not None and self.keep_ms is not None and last + self.keep_ms <= mark:
            state = None
        return state, last, out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        states = pickle.loads(self.states.get()[0]) if self.states.exists() else {}
        ready, later = defaultdict(list), []
        if self.waiting.exists():
            for (block,) in self.waiting.get():
                for row in pickle.loads(block):
                    if row[1] // 1000 <= mark:
                        ready[row[0]].append(row[1:])
                    else:
                        later.append(row)
        out, kept, wake = [], {}, None if not later else min(r[1] for r in later) // 1000
        for own in {**states, **ready}:
            rows = sorted(ready.get(own, ()), key=lambda r: r[:2])
            state, last, more = self._advance((own,), rows, mark, *states.get(own, (None, None)))
            out += more
            if state is None:
                continue
            kept[own] = (state, last)
            for t in (self.due(state), last + self.keep_ms if self.keep_ms is not None else None):
                if t is not None:
                    wake = t if wake is None else min(wake, t)
        if later:
            self.waiting.put([(pickle.dumps(later),)])
        else:
            self.waiting.clear()
        if kept:
            self.states.update((pickle.dumps(kept),))
        else:
            self.states.clear()
        if wake is not None:
            self.handle.registerTimer(max(wake, mark + 1))
        yield pd.DataFrame(out, columns=self.OUT).astype("object")

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, processor: InOrder, schema: str) -> DataFrame:
    """Run the processor over a watermarked stream, keyed by ``key``."""
    processor.key_column = key
    return bucketed(rows, key).transformWithStateInPandas(processor, schema, "Append", "EventTime")
