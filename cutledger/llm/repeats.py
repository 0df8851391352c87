"""Removal of repeated byte strings by a blockwise, difference-cover suffix index.

Wanted are all suffixes whose first 200 bytes start another suffix too. Suffixes are dealt into buckets (ranges of the hash of their leading
string) and one bucket is sorted at a time; equal neighbours repeat. What bounds memory is that few suffixes enter a bucket:

* A prefilter keeps the windows whose least 64-byte string (their minimiser) occurs twice; equal windows have equal minimisers.
* Long ties are resolved on a difference-cover sample first. A cover of period v holds, for any two positions, a common shift below v that
  takes both into the sample. So of a repeat that is longer than 200 + v - 1 bytes, sample suffixes alone, compared over 200 + v - 1 bytes,
  mark all windows but fewer than v at each end (v = 133, 12 of 133 suffixes).
* The sample ranks then decide who enters the last, exhaustive round (v = 1). Of equal sample strings one text leads; the others' windows
  under such a string stand for nothing new and stay out. A leader's resolved windows enter only where another text still has an open window
  with the same minimiser. (Whoever stays out has a smaller leader with the same bytes, so every open window meets its equal.)

Texts are keyed by a 64-bit hash; copies of a text are one text with a count. Strings are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.llm.common import parts_for, ready, stored, text_of, volume
from cutledger.llm.numeric import PACKED, U, gather, prefix_sums, scatter, span_hashes

LENGTH = 200
ANCHOR = 64
# Perfect difference sets, every residue is a difference of two members.
COVERS = {
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}
FLUSH = 400_000
BUCKET_BYTES = 16_000_000


def cover_positions(n: int, period: int) -> np.ndarray:
    """Positions below n that lie in the difference cover."""
    base = np.arange(0, n, period)[:, None] + np.array(COVERS[period])[None, :]
    return base.ravel()[base.ravel() < n]


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every `width` neighbours."""
    pick, pad = (np.minimum, U(2**64 - 1)) if least else (np.maximum, U(0))
    n = len(values)
    blocks = -(-n // width)
    grid = np.full(blocks * width, pad, U)
    grid[:n] = values
    grid = grid.reshape(blocks, width)
    ahead = pick.accumulate(grid, axis=1).ravel()
    back = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])


class Text:
    """Bytes of a text with their prefix sums."""

    def __init__(self, data: bytes, length: int) -> None:
        self.data = np.frombuffer(data, np.uint8)
        self.length = length
        self.windows = max(len(data) - length + 1, 0)
        self.sums = prefix_sums(self.data) if self.windows else None

    def strings(self, at: np.ndarray, size: int) -> np.ndarray:
        return span_hashes(self.sums, at, at + size)

    def minimisers(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the minimiser of each window, hash at each place that is some window's minimiser)."""
        wide = self.length - ANCHOR + 1
        h = self.strings(np.arange(len(self.data) - ANCHOR + 1), ANCHOR)
        of_window = sliding(h, wide, True)
        # a place is a minimiser if the largest minimum of the windows around it is its own hash
        around = np.concatenate([np.zeros(wide - 1, U), of_window, np.zeros(wide - 1, U)])
        return of_window, h[sliding(around, wide, False) == h]


def candidates(text: Text, named: np.ndarray) -> np.ndarray:
    """Windows whose minimiser is in the sorted array `named`."""
    return _in(text.minimisers()[0] & ~FLAG, named & ~FLAG)


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    return known[np.minimum(at, len(known) - 1)] == values


def _count(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def sampled(text: Text, cand: np.ndarray, period: int) -> np.ndarray:
    """Cover positions whose string of length + period - 1 bytes spans candidate windows only."""
    at = cover_positions(text.windows - period + 1, period)
    off = _count(~cand)
    return at[off[at + period] == off[at]]


def under(text: Text, at: np.ndarray, period: int) -> np.ndarray:
    """Windows that lie in a string of length + period - 1 bytes from one of the positions."""
    step = np.zeros(text.windows + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + period, -1)
    return np.cumsum(step)[:-1] > 0


def removed(windows: np.ndarray, n: int, length: int) -> np.ndarray:
    """Bytes covered by the marked windows."""
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(windows)
    step[at] += 1
    step[at + length] -= 1
    return np.cumsum(step)[:-1] > 0


# ---- tasks -------------------------------------------------------------------------------------------------------------------------------


class _Dealer:
    """Gathers (key, owner) records of a task and deals them out packed."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.keys, self.owners, self.held = buckets, [], [], 0

    def add(self, owner: int, keys: np.ndarray) -> Iterator[pd.DataFrame]:
        if len(keys):
            self.keys.append(keys)
            self.owners.append(owner)
            self.held += len(keys)
        if self.held >= FLUSH:
            yield from self.rest()

    def rest(self) -> Iterator[pd.DataFrame]:
        if self.held:
            refs = np.repeat(np.arange(len(self.keys)), [len(k) for k in self.keys])
            yield scatter(np.concatenate(self.keys), refs, np.array(self.owners, np.int64), self.buckets)
            self.keys, self.owners, self.held = [], [], 0


def _anchors(length: int, buckets: int) -> Callable:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = _Dealer(buckets)
        for batch in batches:
            for owner, text in zip(batch["owner"], batch["text"]):
                t = Text(text.encode("utf-8", "replace"), length)
                if t.windows:
                    yield from out.add(owner, t.minimisers()[1] & ~FLAG)
        yield from out.rest()

    return run


REPEATED = "owner long, keys binary"
#: Lowest bit of a key: a flag of the record, and in an answer, that the text leads the group.
FLAG = U(1)


def _answer(keys: np.ndarray, owners: np.ndarray, buckets: int) -> pd.DataFrame:
    """Keys on their way back to their texts, packed by text."""
    own, refs = np.unique(owners, return_inverse=True)
    return scatter(keys, refs, own, buckets, by_owner=True)


def _collect(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per text with all its keys."""
    keys, owners = gather(rows)
    order = np.argsort(owners, kind="stable")
    keys, owners = keys[order], owners[order]
    first = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
    ends = np.concatenate([first[1:], [len(owners)]])
    return pd.DataFrame({"owner": owners[first], "keys": [np.unique(keys[a:b]).tobytes() for a, b in zip(first, ends)]})


def _repeats(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Sort one bucket of suffixes; per text, the strings that occur twice or more, flagged where the text is the least of its group."""
    keys, owners = gather(rows)
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    same = keys[1:] == keys[:-1]
    twice = np.zeros(len(keys), bool)
    twice[1:] |= same
    twice[:-1] |= same
    first = np.flatnonzero(np.concatenate([[True], ~same])) if len(keys) else np.zeros(0, np.int64)
    leads = owners == np.repeat(owners[first], np.diff(np.concatenate([first, [len(keys)]])))
    return _answer((keys | np.where(leads, FLAG, U(0)))[twice], owners[twice], buckets)


def _contested(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Per text, its unflagged minimisers that another text has flagged."""
    keys, owners = gather(rows)
    order = np.argsort(keys, kind="stable")
    keys, owners = keys[order], owners[order]
    plain = keys & ~FLAG
    first = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(keys)]]))
    open_ = np.repeat(np.maximum.reduceat(keys & FLAG, first), size) if len(keys) else keys
    wanted = (open_ == FLAG) & (keys & FLAG == U(0))
    return _answer(keys[wanted], owners[wanted], buckets)


def _known(blobs: Iterable[bytes]) -> np.ndarray:
    found = [np.frombuffer(b, U) for b in blobs]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, U)


def _pack_texts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield batch.assign(text=[squeeze.compress(t.encode("utf-8", "replace")) for t in batch["text"]])


OPEN = "owner long, copies long, text binary, named binary"


def _open(length: int) -> Callable:
    """Texts with a candidate window, each with its repeated minimisers."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for owner, copies, data, blobs in zip(batch["owner"], batch["copies"], batch["text"], batch["lists"]):
                named = _known(blobs)
                t = Text(unpack.decompress(data), length)
                if t.windows and candidates(t, named).any():
                    rows.append((owner, copies, data, named.tobytes()))
            yield pd.DataFrame(rows, columns=["owner", "copies", "text", "named"])

    return run


LONG = 133


def _state(row, length: int, unpack) -> tuple[Text, np.ndarray, np.ndarray, np.ndarray]:
    """Text, minimisers and candidate flag of its windows, windows that the sample has marked, and those that a leader stands for."""
    t = Text(unpack.decompress(row.text), length)
    least = t.minimisers()[0] & ~FLAG
    cand = _in(least, np.frombuffer(row.named, U) & ~FLAG)
    long_ = _known(x["keys"] for x in row.lists if x["round"] == "long") if row.lists is not None else np.zeros(0, U)
    at = sampled(t, cand, LONG)
    keys = t.strings(at, length + LONG - 1) & ~FLAG
    known = long_ & ~FLAG
    marked = under(t, at[_in(keys, known)], LONG)
    stands = under(t, at[_in(keys, known[long_ & FLAG == U(0)])], LONG)
    return t, np.where(cand, least, U(0)), cand, marked, stands


def _records(length: int, round_: str, buckets: int) -> Callable:
    """Keys of one exchange: sample strings (long), minimisers of open and of led windows (contest), single windows (each)."""

    def keys_of(row, unpack) -> np.ndarray:
        t, least, cand, marked, stands = _state(row, length, unpack)
        if round_ == "long":
            return t.strings(sampled(t, cand, LONG), length + LONG - 1) & ~FLAG
        open_, led = cand & ~marked, marked & ~stands
        if round_ == "contest":
            return np.concatenate([np.unique(least[open_]) | FLAG, np.unique(least[led])])
        contested = _known(x["keys"] for x in row.lists if x["round"] == "contest") if row.lists is not None else np.zeros(0, U)
        at = np.flatnonzero(open_ | (led & _in(least, contested)))
        return t.strings(at, length) & ~FLAG

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, unpack = _Dealer(buckets), zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.itertuples():
                yield from out.add(row.owner, keys_of(row, unpack))
        yield from out.rest()

    return run


DONE = "owner long, n_removed long, n_spans long, kept_sha256 string"


def _finish(length: int) -> Callable:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                t, _, cand, marked, _ = _state(row, length, unpack)
                each = _known(x["keys"] for x in row.lists if x["round"] == "each") & ~FLAG
                at = np.flatnonzero(cand & ~marked)
                marked[at] = _in(t.strings(at, length) & ~FLAG, each)
                gone = removed(marked, len(t.data), length)
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((row.owner, int(gone.sum()), spans, hashlib.sha256(t.data[~gone].tobytes()).hexdigest()))
            yield pd.DataFrame(rows, columns=["owner", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes that stay).

    Removed is each byte covered by a string of `length` bytes (over 128) that also starts anywhere else, in this text or another; strings
    are judged on the input. Null texts count as empty; shorter texts lose nothing. Repeated rows are copies of each other, so long enough
    ones are removed whole. Other columns are ignored; an empty table gives no rows.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    thin = rows.select("doc_id", F.xxhash64("text").alias("owner"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    thin = stored(thin, "repeats-docs")
    long_enough = rows.filter(F.octet_length("text") >= length).withColumn("owner", F.xxhash64("text"))
    buckets = parts_for(volume(rows)[1], bucket_bytes)
    groups = thin.filter(F.col("n_bytes") >= length).groupBy("owner").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"))

    def deal(records: DataFrame, how: Callable = _repeats) -> DataFrame:
        sorted_ = records.groupBy("bucket").applyInPandas(lambda rows: how(rows, buckets), PACKED)
        return sorted_.groupBy("bucket").applyInPandas(_collect, REPEATED)

    anchors = deal(long_enough.select("owner", "text").mapInPandas(_anchors(length, buckets), PACKED))
    lists = anchors.groupBy("owner").agg(F.collect_list("keys").alias("lists")).join(groups, "owner")
    # one row of each text: found by key and id together, so that the copies of a hot text spread
    texts = long_enough.select("doc_id", "owner", "text").mapInPandas(_pack_texts, "doc_id long, owner long, text binary")
    met = texts.join(lists.withColumnRenamed("owner", "__owner"), (F.col("owner") == F.col("__owner")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    opened = met.select("owner", "copies", "text", "lists").mapInPandas(_open(length), OPEN)
    state = stored(opened.dropDuplicates(["owner"]), "repeats-open")
    found = state.sparkSession.createDataFrame([], "owner long, round string, keys binary")
    gathered = lambda: found.groupBy("owner").agg(F.collect_list(F.struct("round", "keys")).alias("lists"))
    for round_, how in (("long", _repeats), ("contest", _contested), ("each", _repeats)):
        records = state.join(gathered(), "owner", "left").mapInPandas(_records(length, round_, buckets), PACKED)
        answer = deal(records, how).select("owner", F.lit(round_).alias("round"), "keys")
        found = found.unionByName(stored(answer, f"repeats-{round_}"))
    single = state.filter(F.col("copies") == 1).join(gathered(), "owner")
    done = single.mapInPandas(_finish(length), DONE)
    whole = groups.filter(F.col("copies") > 1).select(F.col("owner"), F.col("copies"))
    done = done.join(whole, "owner", "full")
    out = thin.join(done, "owner", "left")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id", "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"),
    )
