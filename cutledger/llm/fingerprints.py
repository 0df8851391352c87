"""SimHash fingerprints and Hamming search, in DataFrame functions only.

Terms are pairs of neighbouring words (a single word is its own term), weighted by how often they occur. Each term's 64-bit hash votes on
every bit; two bit counters share one long, so 32 sums carry all 64 votes and are combined before the shuffle. The search copies every
fingerprint into one table per choice of blocks that may stay equal: within radius r of 64 bits cut into b blocks, at least b - r blocks
are equal, so a near pair meets in at least one table.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutledger.llm.common import WORD, stored, text_of

RADIUS, BLOCKS = 3, 5
#: Ends of the five blocks of 64 bits.
EDGES = (0, 13, 26, 39, 52, 64)
PAIR = 0x0000000100000001


def terms_of(words: Column) -> Column:
    """Neighbouring word pairs, in order; the last pair of a longer text has no second word and is no term."""
    alone = F.transform(words, lambda w: F.struct(w.alias("a"), F.lit("").alias("b")))
    pairs = F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"))
    return F.when(F.size(words) == 1, alone).otherwise(F.transform(pairs, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"))))


def simhash(texts: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """(keys, fingerprint) from rows (keys, text), equal keys meaning equal texts: one row per key. A text without a word has fingerprint 0.

    Rows of equal texts only scale all votes alike, so copies need not be removed first.
    """
    words = texts.select(*keys, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    terms = words.select(*keys, F.explode_outer(terms_of(F.col("words"))).alias("term"))
    hashed = terms.select(*keys, F.when(F.col("term.b").isNotNull(), F.xxhash64("term.a", "term.b")).alias("h"))
    votes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(PAIR))).alias(f"v{j}") for j in range(32)]
    counted = hashed.groupBy(*keys).agg(F.count("h").alias("n"), *votes)
    value = F.lit(0).cast("long")
    for j in range(64):
        ayes = F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF)) if j < 32 else F.shiftrightunsigned(f"v{j - 32}", 32)
        bit = (1 << j) - (1 << 64) * (j == 63)
        value = value.bitwiseOR(F.when(ayes * 2 > F.col("n"), F.lit(bit)).otherwise(F.lit(0)).cast("long"))
    return counted.select(*keys, value.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _tables(fingerprint: Column, radius: int) -> Column:
    """(table, key) of every choice of blocks that must be equal."""
    block = [F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(EDGES, EDGES[1:])]
    return F.array(*[F.struct(F.lit(t).alias("table"), F.xxhash64(*[block[i] for i in chosen]).alias("spot")) for t, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - radius))])


def near(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All (query, fingerprint, distance) within the radius (at most 4), from two tables of distinct fingerprints in column `fingerprint`."""
    left = queries.select(F.col("fingerprint").alias("query"), F.explode(_tables(F.col("fingerprint"), radius)).alias("at"))
    right = fingerprints.select("fingerprint", F.explode(_tables(F.col("fingerprint"), radius)).alias("at"))
    met = left.select("query", "at.table", "at.spot").join(right.select("fingerprint", "at.table", "at.spot"), ["table", "spot"])
    met = met.withColumn("distance", F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint"))).cast("long"))
    return met.filter(F.col("distance") <= radius).select("query", "fingerprint", "distance").distinct()


def _in_blocks(docs: DataFrame, doc_id: str, blocks: int) -> DataFrame:
    """Block number along the id, by equal shares of the id range."""
    ends = docs.agg(F.min(doc_id).alias("lo"), F.max(doc_id).alias("hi")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    width = max(1, -(-(hi - lo + 1) // blocks))
    return docs.withColumn("__block", F.coalesce(F.floor((F.col(doc_id) - F.lit(lo)) / F.lit(width)), F.lit(-1)))


def _following(rows: DataFrame, value: str, order: list[Column], head: Column) -> DataFrame:
    """Rows with the value of the row behind in their block as __next; after the block's last one that of the next lower block (its `head`), the
    highest after the lowest. The blocks meet in a table of one row per block."""
    heads = rows.groupBy("__block").agg(head.alias("head"))
    ring = Window.orderBy(F.col("__block").desc())
    after = heads.select("__block", F.coalesce(F.lead("head").over(ring), F.first("head").over(ring)).alias("__after"))
    inside = Window.partitionBy("__block").orderBy(*order)
    rows = rows.withColumns({"__next": F.lead(value).over(inside), "__place": F.row_number().over(inside).cast("long")})
    return rows.join(after, "__block").withColumn("__next", F.coalesce("__next", "__after")).drop("__after")


def _placed(docs: DataFrame, blocks: int, doc_id: str, text: str) -> DataFrame:
    rows = _in_blocks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")), "doc_id", blocks)
    return _following(rows, "text", [F.col("doc_id").desc_nulls_last(), F.col("text").desc()], F.max(F.struct("doc_id", "text"))["text"])


def with_next(docs: DataFrame, blocks: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, next_text): the text of the row with the next smaller id; after the last, that of the first (nulls come last).

    Rows meet in blocks of the id; the row after a block's last one is handed over by a table of one row per block. Equal ids are ordered by
    their texts.
    """
    return _placed(docs, blocks, doc_id, text).select("doc_id", "text", F.col("__next").alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - half).cast("int")), F.substring(following, F.lit(1), half))


def hexed(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def fingerprint_documents(docs: DataFrame, blocks: int, doc_id: str = "doc_id", text: str = "text", every: int = 50, radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and for ids divisible by `every`
    n_near, the number of rows whose fingerprint lies within `radius` (the row itself included; null for other ids).

    Null texts count as empty. Repeated rows come out repeated. Other columns are ignored.
    """
    base = _placed(docs, blocks, doc_id, text).withColumn("edit", edited(F.col("text"), F.col("__next")))
    numbers = ["__block", "__place", "doc_id", "n_chars"]
    both = F.explode(F.array(F.struct(F.lit("").alias("sha"), F.col("text")), F.struct(F.sha2("edit", 256).alias("sha"), F.col("edit").alias("text"))))
    base = base.select("__block", "__place", "doc_id", F.char_length("text").cast("long").alias("n_chars"), both.alias("x"))
    # the texts are shuffled once: all that follows goes by the place of a row
    prints = stored(simhash(base.select(*numbers, "x.sha", "x.text"), (*numbers, "sha")), "simhash")
    changed = prints.where("sha <> ''").select("__block", "__place", F.col("sha").alias("edited_sha256"), F.col("fingerprint").alias("changed"))
    own = prints.where("sha = ''").select("__block", F.col("__place").alias("__at"), "doc_id", "n_chars", F.col("fingerprint").alias("own"))
    rows = _following(own, "own", [F.col("__at")], F.min(F.struct("__at", "own"))["own"])
    rows = rows.join(changed, ["__block", "__place"]).withColumn("following", F.col("__next"))
    rows = stored(rows.select("doc_id", "n_chars", "edited_sha256", "own", "changed", "following"), "simhash-rows")
    held = rows.groupBy(F.col("own").alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))
    asked = rows.filter(F.col("doc_id") % every == 0).select(F.col("own").alias("fingerprint")).distinct()
    found = near(asked, held.select("fingerprint"), radius).join(held, "fingerprint").groupBy("query").agg(F.sum("n").alias("n_near"))
    out = rows.join(found, F.when(F.col("doc_id") % every == 0, F.col("own")) == F.col("query"), "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hexed(F.col("own")).alias("fingerprint"), hexed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"), "n_near",
    )
