"""Exact duplicates through a cuckoo-filter index of live digests.

Digests (SHA-256 of the text, computed by Spark) pass through a `CuckooIndex` twice: once per map task, which folds the copies
that meet there before anything is shuffled (so a text that makes up a third of all rows leaves a task as one row), and once per
digest range, which folds the tasks' rows. The filter answers "surely new" or "perhaps seen"; a hit is verified against the entry
kept in the bucket (whole digest and byte length). A full filter is rebuilt at twice the size from the stored keys. `delete`
withdraws a digest again.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.llm.common import ready, text_of, unused

SLOTS = 4
KICKS = 200


class CuckooFilter:
    """16-bit fingerprints, four slots a bucket, two buckets a key (partial-key cuckoo hashing)."""

    def __init__(self, buckets: int = 64) -> None:
        self.mask = buckets - 1
        self.slots = array("H", bytes(2 * SLOTS * buckets))

    def _spots(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        one = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _swap(self, bucket: int, old: int, new: int) -> bool:
        base = bucket * SLOTS
        for s in range(base, base + SLOTS):
            if self.slots[s] == old:
                self.slots[s] = new
                return True
        return False

    def __contains__(self, digest: bytes) -> bool:
        mark, one, two = self._spots(digest)
        return mark in self.slots[one * SLOTS : one * SLOTS + SLOTS] or mark in self.slots[two * SLOTS : two * SLOTS + SLOTS]

    def insert(self, digest: bytes) -> bool:
        """False when the filter is full; a mark has then been pushed out and the filter has to be rebuilt."""
        mark, one, two = self._spots(digest)
        if self._swap(one, 0, mark) or self._swap(two, 0, mark):
            return True
        bucket = two
        for turn in range(KICKS):
            s = bucket * SLOTS + turn % SLOTS
            self.slots[s], mark = mark, self.slots[s]
            bucket = self._other(bucket, mark)
            if self._swap(bucket, 0, mark):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, one, two = self._spots(digest)
        return self._swap(one, mark, 0) or self._swap(two, mark, 0)


class CuckooIndex:
    """Live digests with what is known of each: byte length, largest row id, number of rows."""

    def __init__(self, buckets: int = 64) -> None:
        self._reset(buckets)
        self.live = 0

    def _reset(self, buckets: int) -> None:
        self.buckets = buckets
        self.filter = CuckooFilter(buckets)
        self.content: dict[int, list[list]] = {}

    def _home(self, digest: bytes) -> int:
        return int.from_bytes(digest[10:18], "little") & (self.buckets - 1)

    def find(self, digest: bytes, size: int) -> list | None:
        """The stored entry, or None. Only a hit of the filter looks into the bucket."""
        if digest in self.filter:
            for entry in self.content.get(self._home(digest), ()):
                if entry[0] == digest and entry[1] == size:
                    return entry
        return None

    def add(self, digest: bytes, size: int, row_id: int | None, rows: int = 1) -> None:
        entry = self.find(digest, size)
        if entry is not None:
            entry[2] = row_id if entry[2] is None else entry[2] if row_id is None else max(entry[2], row_id)
            entry[3] += rows
            return
        self.content.setdefault(self._home(digest), []).append([digest, size, row_id, rows])
        self.live += 1
        if not self.filter.insert(digest):
            self._grow()

    def delete(self, digest: bytes, size: int, rows: int = 1) -> bool:
        """Withdraw rows of a digest; the last one takes the digest out of the filter. False if it is not live."""
        entry = self.find(digest, size)
        if entry is None:
            return False
        entry[3] -= rows
        if entry[3] <= 0:
            self.content[self._home(digest)].remove(entry)
            self.filter.delete(digest)
            self.live -= 1
        return True

    def _grow(self) -> None:
        kept = list(self.entries())
        size = self.buckets
        while True:
            size *= 2
            self._reset(size)
            if all(self._put(e) for e in kept):
                return

    def _put(self, entry: list) -> bool:
        self.content.setdefault(self._home(entry[0]), []).append(entry)
        return self.filter.insert(entry[0])

    def entries(self) -> Iterator[list]:
        for bucket in self.content.values():
            yield from bucket


GROUPS = "digest binary, n_bytes long, keep_id long, group_size long"
ENTRY = pa.schema([("digest", pa.binary()), ("n_bytes", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
FLUSH = 200_000


def _fold(batches: Iterable[pa.RecordBatch], flush: int | None) -> Iterator[pa.RecordBatch]:
    """Fold rows into an index. With `flush`, hand the entries on and begin anew at so many, so that memory stays bounded."""
    index = CuckooIndex()

    def out() -> Iterator[pa.RecordBatch]:
        rows = list(index.entries())
        for at in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 20_000]), ENTRY)], schema=ENTRY)

    for batch in batches:
        for digest, size, row_id, rows in zip(*(batch.column(k).to_pylist() for k in range(4))):
            index.add(digest, size, row_id, rows)
        if flush and index.live >= flush:
            yield from out()
            index = CuckooIndex()
    yield from out()


def _fold_some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _fold(batches, FLUSH)


def _fold_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _fold(batches, None)


def with_digest(docs: DataFrame, text: str = "text", name: str = "digest") -> DataFrame:
    return docs.withColumn(name, F.unhex(F.sha2(text_of(text), 256)))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Index table (digest, n_bytes, keep_id, group_size), one row per distinct text; can be stored and added to.

    keep_id is the largest row id of the text (null only if all are null). An empty table gives an empty index.
    """
    ready(docs.sparkSession)
    rows = docs.select(
        F.unhex(F.sha2(text_of(text), 256)).alias("digest"),
        F.octet_length(text_of(text)).cast("long").alias("n_bytes"),
        F.col(doc_id).cast("long").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
    )
    return merge_index(rows.mapInArrow(_fold_some, GROUPS))


def merge_index(entries: DataFrame) -> DataFrame:
    """Fold index rows (of several builds too) into one index, one digest range per task."""
    return entries.repartition("digest").mapInArrow(_fold_shard, GROUPS)


def _withdraw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, gone = CuckooIndex(), []
    for batch in batches:
        for digest, size, row_id, rows in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if rows < 0:
                gone.append((digest, size, -rows))
            else:
                index.add(digest, size, row_id, rows)
    for digest, size, rows in gone:
        index.delete(digest, size, rows)
    rows = list(index.entries())
    for at in range(0, len(rows), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 20_000]), ENTRY)], schema=ENTRY)


def delete_from_index(index: DataFrame, gone: DataFrame, text: str = "text") -> DataFrame:
    """Index without the rows of `gone`, a table of texts; a text whose last row goes leaves the index.

    keep_id of a text that stays is not lowered: an index of digests does not know the other ids. Texts that are not live are ignored.
    """
    minus = (
        gone.groupBy(F.unhex(F.sha2(text_of(text), 256)).alias("digest"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"))
        .agg((-F.count(F.lit(1))).alias("group_size"))
        .select("digest", "n_bytes", F.lit(None).cast("long").alias("keep_id"), "group_size")
    )
    return index.unionByName(minus).repartition("digest").mapInArrow(_withdraw, GROUPS)


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when identical; null counts as empty.

    The row with the largest id stays. Rows that repeat the kept id and text are all marked kept (`keep_one` leaves one of them); with
    only null ids, keep_id is null and the rows are marked kept. Other columns are ignored. The join back is thin (id and digest), so a
    text that fills a third of the table is a skewed join of short rows, which adaptive execution splits.
    """
    groups = build_index(docs, doc_id, text).select("digest", "keep_id", "group_size")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(text), 256)).alias("digest"))
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of `docs`; of rows that repeat id and text one stays.

    Rows meet their group by digest and id together, so the copies of a hot text spread over the tasks.
    """
    digest, keep, own = (unused(docs, n) for n in ("digest", "keep", "own"))
    kept = build_index(docs, doc_id, text).select(F.col("digest").alias(digest), F.col("keep_id").alias(keep))
    rows = with_digest(docs, text, own)
    met = rows.join(kept, (F.col(own) == F.col(digest)) & F.col(doc_id).cast("long").eqNullSafe(F.col(keep)))
    return met.dropDuplicates([own, doc_id]).select(*[F.col(f"`{n}`") for n in docs.columns])
