"""Optimal length buckets and token-budget batches.

Lengths are counted into one global histogram whose bins are at most 1/64 of a length wide (a few thousand bins at any size of
table). Dynamic programming over it chooses the bucket boundaries that waste the least padding; documents then fill batches inside
their bucket. A bucket may hold any share of the rows: it is numbered in blocks of a hash, whose totals are summed up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutledger.llm.common import stored, text_of, word_count

BUCKETS = 16
BATCH_TOKENS = 65_536
#: Bins per doubling of the length; below this length every length has its own bin.
GRAIN = 64


def bin_of(length: Column) -> Column:
    """Bin number, ascending with the length: the length itself up to 2 x GRAIN, then GRAIN bins per doubling."""
    octave = F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - (GRAIN.bit_length() - 1), F.lit(0))
    return (octave * GRAIN + F.floor(length / F.pow(F.lit(2.0), octave))).cast("long")


def histogram(lengths: DataFrame, length: str = "length") -> DataFrame:
    """(bin, top, rows, tokens): longest length, number and sum of the lengths of each bin."""
    return lengths.groupBy(bin_of(F.col(length)).alias("bin")).agg(
        F.max(length).alias("top"), F.count(F.lit(1)).alias("rows"), F.sum(length).alias("tokens")
    )


def optimal_bounds(tops: np.ndarray, rows: np.ndarray, tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Upper ends of at most `buckets` ranges of bins with the least padding, sum of rows x upper end - tokens. Ties: the shorter first range."""
    n = len(tops)
    if n == 0:
        return np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(rows.astype(np.float64))])
    spent = np.concatenate([[0], np.cumsum(tokens.astype(np.float64))])
    # cost[i, j]: bins i..j-1 padded to the top of bin j-1
    cost = np.full((n + 1, n + 1), np.inf)
    for j in range(1, n + 1):
        cost[:j, j] = tops[j - 1] * (ends[j] - ends[:j]) - (spent[j] - spent[:j])
    best, back = np.full(n + 1, np.inf), []
    best[0] = 0
    for _ in range(min(buckets, n)):
        through = best[:, None] + cost
        back.append(np.argmin(through, axis=0))
        best = through[back[-1], np.arange(n + 1)]
        best[0] = 0 if not back[:-1] else best[0]
        back[-1][0] = 0
        best[0] = 0.0
    cuts, j = [], n
    for step in reversed(back):
        if j == 0:
            break
        cuts.append(int(tops[j - 1]))
        j = int(step[j])
    return np.array(sorted(set(cuts)), np.int64)


def choose_bounds(lengths: DataFrame, buckets: int = BUCKETS, length: str = "length") -> list[int]:
    """Bucket boundaries for a table of lengths; the histogram (bounded by GRAIN bins a doubling) comes to the driver."""
    found = sorted(histogram(lengths, length).collect(), key=lambda r: r["top"])
    top, rows, tokens = (np.array([r[k] for r in found], np.int64) for k in ("top", "rows", "tokens"))
    return optimal_bounds(top, rows, tokens, buckets).tolist()


def pack(docs: DataFrame, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, length (words), bucket, pad_to, batch, slot (place in the batch), padding.

    A batch is (bucket, batch): floor(batch_tokens / pad_to) rows, at least one, so a document longer than the budget is alone. Null and
    empty texts have length 0 and share the lowest bucket. Repeated rows take a slot each. Other columns are ignored; an empty table gives
    no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), word_count(text_of(text)).alias("length"))
    rows = stored(rows, "pack-lengths")
    bounds = choose_bounds(rows, buckets) or [0]
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.size(F.filter(edges, lambda b: b < F.col("length")))
    rows = rows.withColumn("bucket", bucket.cast("long")).withColumn("pad_to", F.element_at(edges, (F.col("bucket") + 1).cast("int")))
    rows = rows.withColumn("shuffle", F.xxhash64("doc_id")).withColumn("block", F.shiftrightunsigned("shuffle", 52))
    counts = rows.groupBy("bucket", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("bucket", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carry"))
    inside = Window.partitionBy("bucket", "block").orderBy("shuffle", "doc_id", "length")
    placed = rows.withColumn("at", F.row_number().over(inside) - 1).join(counts, ["bucket", "block"]).withColumn("at", F.col("at") + F.col("carry"))
    per = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(batch_tokens) / F.greatest(F.col("pad_to"), F.lit(1))))
    return placed.select(
        "doc_id", "length", "bucket", "pad_to", F.floor(F.col("at") / per).alias("batch"), (F.col("at") % per).alias("slot"),
        (F.col("pad_to") - F.col("length")).alias("padding"),
    )
