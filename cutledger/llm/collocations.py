"""Phrase collocations by best-first branch and bound.

A phrase of 2 to 4 words is scored by its weakest cut. Phrases grow to the right, word by word. The count of a prefix bounds the count of
everything that grows from it, and with the count of its first word also their score, so only prefixes whose bound reaches the score that a
language's list still needs are grown. A phrase of the list is settled when every phrase one word longer that could push it out has been
counted (a longer one that pushes it out contains such a phrase with at least the same count). The frontier is grown in waves, best bounds
first, one scan of the texts per wave, until the last place of each list is settled.

Texts are read into words once: chunks of word numbers with their own word lists and hashes, in the shared folder. Words and pairs are first
summed by a 64-bit hash, which travels light; only those whose hash is frequent are counted by their words, as are all longer phrases, exactly,
in numpy, per task. Membership is tested in bitmaps of bounded size (`LARGEST` bits), whose false hits cost counting and nothing else: they
fall to the exact counts and joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutledger.llm.common import ready, stored

#: Longest phrase, least count, places per language, parts of a score.
LONGEST, LEAST, KEEP, PARTS = 4, 30, 2000, 2_000_000
#: Characters read at once, words of a chunk (numbers of 16 bits), words and sums a task holds before it hands them on, bits of a bitmap.
SLICE, CHUNK, WORDS_HELD, SUMS_HELD, SMALLEST, LARGEST = 200_000, 60_000, 150_000, 1_000_000, 20, 28
#: Chunks are long rows, so pages are closed by size and not by a number of rows.
PAGES = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4", "parquet.block.size": str(16 << 20)}

CHUNKS = "lang string, words string, hashes binary, ids binary, carried int"
CHUNKED = pa.schema([("lang", pa.string()), ("words", pa.string()), ("hashes", pa.binary()), ("ids", pa.binary()), ("carried", pa.int32())])
SUMS = "h long, f long"
COUNTS = "lang string, phrase string, f long"
COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
BREAK = b"\xff"
MIX = np.uint64(0x9E3779B97F4A7C15)


def _table() -> bytes:
    """Bytes as they are read: A-Z lower-cased, ends of pieces as BREAK (a byte that UTF-8 does not use), tabs as spaces."""
    table = bytearray(bytes(range(256)).lower())
    for end in b".,;:!?\x0a\x0b\x0c\x0d":
        table[end] = BREAK[0]
    table[0x09] = 0x20
    return bytes(table)


READ = _table()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = made = len(self)
        return made


def _slices(texts: Iterable[str | None]) -> Iterator[bytes]:
    """The texts in turn, in slices that cut no word, with a break after each text."""
    parts, held = [], 0
    for text in texts:
        for at in range(0, len(text or ""), SLICE):
            parts.append(text[at : at + SLICE].encode().translate(READ))
            held += len(parts[-1])
            if held >= SLICE:
                whole = b"".join(parts)
                cut = max(whole.rfind(b" "), whole.rfind(BREAK)) + 1
                if cut:
                    yield whole[:cut]
                parts = [whole[cut:]]
                held = len(parts[0])
        parts.append(BREAK)
    yield b"".join(parts)


def _chunk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) as chunks of one language: word numbers, 0 for an end of a piece, and the words that they number (from 1).

    A chunk begins with the last words of the one before it (`carried` of them), so that every phrase lies whole in one chunk.
    """
    held: dict[str, tuple[_Ids, list[np.ndarray], int]] = {}

    def begin(lang: str, words: list[bytes]) -> None:
        ids = _Ids()
        ids[BREAK]  # the break has number 0
        held[lang] = ids, [np.fromiter(map(ids.__getitem__, words), np.uint16, len(words))], len(words)

    def out(lang: str) -> pa.RecordBatch:
        ids, parts, _ = held.pop(lang)
        numbers, words = np.concatenate(parts), list(ids)
        begin(lang, [words[i] for i in numbers[1 - LONGEST :]])
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words[1:]), np.uint64, len(words) - 1)
        row = lang, b"\n".join(words[1:]).decode(), hashes.tobytes(), numbers.tobytes(), len(parts[0])
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, CHUNKED)], schema=CHUNKED)

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            if lang not in held:
                begin(lang, [])
            for part in _slices(t for t, g in zip(texts, langs) if g == lang):
                words = part.replace(BREAK, b" \xff ").split()
                for at in range(0, len(words), CHUNK // 2):
                    some = words[at : at + CHUNK // 2]
                    if held[lang][2] + len(some) > CHUNK:
                        yield out(lang)
                    ids, parts, n = held[lang]
                    parts.append(np.fromiter(map(ids.__getitem__, some), np.uint16, len(some)))
                    held[lang] = ids, parts, n + len(some)
    for lang, (_, parts, n) in list(held.items()):
        if n > len(parts[0]):
            yield out(lang)


def _fold(keys: list[np.ndarray], n: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal keys (one or more columns) as one, with the sum of their counts (None: of 1 each)."""
    if not len(keys[0]):
        return keys, np.zeros(0, np.int64)
    if n is None and len(keys) == 1:
        keys = [np.sort(keys[0])]
    else:
        order = np.lexsort(keys)
        keys, n = [k[order] for k in keys], n if n is None else n[order]
    new = np.ones(len(keys[0]), bool)
    new[1:] = reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.diff(np.append(at, len(new))) if n is None else np.add.reduceat(n, at)


class _Tally:
    """Phrases of one length as packed word ids, with their counts."""

    def __init__(self) -> None:
        self.parts: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.size = 0

    def add(self, keys: list[np.ndarray], n: np.ndarray | None = None) -> None:
        self.parts.append(_fold(keys, n))
        self.size += len(self.parts[-1][1])
        if self.size > SUMS_HELD:
            self.fold()

    def fold(self) -> tuple[list[np.ndarray], np.ndarray]:
        if len(self.parts) > 1:
            width = len(self.parts[0][0])
            self.parts = [_fold([np.concatenate([p[0][j] for p in self.parts]) for j in range(width)], np.concatenate([p[1] for p in self.parts]))]
            self.size = len(self.parts[0][1])
        return self.parts[0] if self.parts else ([], np.zeros(0, np.int64))


def _packed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Word ids of under 21 bits, three to a key."""
    keys = []
    for at in range(0, len(columns), 3):
        keys.append(reduce(lambda whole, ids: whole << 21 | ids, columns[at : at + 3]))
    return keys


def _unpacked(keys: list[np.ndarray], length: int) -> list[np.ndarray]:
    columns = []
    for j, key in enumerate(keys):
        many = min(3, length - 3 * j)
        columns += [key >> 21 * (many - 1 - i) & (1 << 21) - 1 for i in range(many)]
    return columns


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1))


def phrase_hash(start, words: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases from the hash of their language and those of their words."""
    with np.errstate(over="ignore"):
        h = start
        for w in words:
            h = (h ^ w) * MIX
            h = h ^ (h >> np.uint64(29))
    return h


class Sieve:
    """Bitmap of phrases with two probes; answers "surely not" or "perhaps"."""

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.bits, self.words = bits, words

    @staticmethod
    def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
        return [h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        hit = [self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1) for p in self.probes(h, self.bits)]
        return (hit[0] & hit[1]).astype(bool)


def sieve(hashes: DataFrame) -> Sieve:
    """Bitmap of phrases by their hash (column h); about 16 bits a phrase, at most LARGEST in all, so its size does not follow the data."""
    bits = min(max(hashes.count().bit_length() + 4, SMALLEST), LARGEST)

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = np.concatenate(Sieve.probes(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits))
            one = np.left_shift(np.uint64(1), spots & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((spots >> np.uint64(6)).astype(np.int64)), pa.array(one.view(np.int64))], ["at", "bits"])

    found = hashes.select("h").mapInArrow(places, "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return Sieve(bits, words)


def _hash_phrases(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [
            phrase_hash(lang_hash(lang), [np.uint64(xxhash.xxh64_intdigest(w)) for w in phrase.split(" ")])
            for lang, phrase in zip(*(batch.column(k).to_pylist() for k in range(2)))
        ]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64))], ["h"])


def hashed(phrases: DataFrame) -> DataFrame:
    """Hashes (column h) of phrases (lang, phrase)."""
    return phrases.select("lang", "phrase").mapInArrow(_hash_phrases, "h long")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, str, np.ndarray, np.ndarray, int]]:
    """Chunks as (lang, words, hashes by number, numbers, carried)."""
    for batch in batches:
        for row in range(batch.num_rows):
            lang, words, hashes, ids, carried = (batch.column(c)[row].as_py() for c in range(5))
            by_number = np.concatenate([np.zeros(1, np.uint64), np.frombuffer(hashes, np.uint64)])
            yield lang, words, by_number, np.frombuffer(ids, np.uint16), carried


def _columns(numbers: np.ndarray, carried: int, length: int) -> list[np.ndarray]:
    """The phrases of a length that end behind the carried words, one column per word."""
    begin = max(carried - length + 1, 0)
    many = max(len(numbers) - begin - length + 1, 0)
    columns = [numbers[begin + j : begin + j + many] for j in range(length)]
    whole = reduce(np.logical_and, [c != 0 for c in columns])
    return [c[whole] for c in columns]


def _counter(lengths: tuple[int, ...], wanted: Callable) -> Callable:
    """Task function over chunks: counts of the phrases of these lengths that `wanted(lang hash, hashes by number, columns)` lets pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tallies = _Ids(), {}

        def out() -> Iterator[pa.RecordBatch]:
            names = list(ids)
            for (lang, length), tally in tallies.items():
                keys, n = tally.fold()
                for at in range(0, len(n), 20_000):
                    columns = [c.tolist() for c in _unpacked([k[at : at + 20_000] for k in keys], length)]
                    phrases = [" ".join([names[i] for i in row]) for row in zip(*columns)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), pa.array(phrases), pa.array(n[at : at + 20_000])], schema=COUNTED)
            ids.clear()
            tallies.clear()

        for lang, words, hashes, numbers, carried in _read(batches):
            if len(ids) > WORDS_HELD or sum(t.size for t in tallies.values()) > SUMS_HELD:
                yield from out()
            start, named = lang_hash(lang), None
            for length in lengths:
                columns = _columns(numbers, carried, length)
                if len(columns[0]):
                    passed = wanted(start, hashes, columns)
                    columns = [c[passed] for c in columns]
                if not len(columns[0]):
                    continue
                # words that occur in a passing phrase get a number of the task
                named = named or words.split("\n")
                used = np.flatnonzero(np.bincount(np.concatenate(columns)))
                own = np.zeros(len(hashes), np.int64)
                own[used] = [ids[named[i - 1]] for i in used.tolist()]
                tallies.setdefault((lang, length), _Tally()).add(_packed([own[c] for c in columns]))
        yield from out()

    return run


def _summed(length: int, wanted: Callable | None) -> Callable:
    """Task function over chunks: counts by hash of the words, or of the phrases of a length that `wanted` lets pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()

        def out() -> pa.RecordBatch:
            keys, n = tally.fold()
            return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(n)], ["h", "f"])

        for lang, _, hashes, numbers, carried in _read(batches):
            start, n = lang_hash(lang), None
            if length == 1:
                counted = np.bincount(numbers[carried:], minlength=len(hashes))[1:]
                at = np.flatnonzero(counted)
                h, n = phrase_hash(start, [hashes[at + 1]]), counted[at]
            else:
                columns = _columns(numbers, carried, length)
                passed = wanted(start, hashes, columns)
                h = phrase_hash(start, [hashes[c[passed]] for c in columns])
            if len(h):
                tally.add([h.view(np.int64)], n)
            if tally.size > SUMS_HELD // 2:
                tally.fold()
                if tally.size > SUMS_HELD // 2:
                    yield out()
                    tally = _Tally()
        if tally.size:
            yield out()

    return run


def _word_totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, _, _, numbers, carried in _read(batches):
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([int((numbers[carried:] != 0).sum())])], ["lang", "n"])


def _likely(chunks: DataFrame, scan: Callable) -> Sieve:
    """Bitmap of the hashes whose sum is frequent: that of every frequent phrase is among them."""
    sums = chunks.mapInArrow(scan, SUMS).groupBy("h").agg(F.sum("f").alias("f")).filter(F.col("f") >= LEAST)
    return sieve(stored(sums, "collocation-likely"))


def _counts(chunks: DataFrame, scan: Callable) -> DataFrame:
    return chunks.mapInArrow(scan, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _all_in(phrases):
    """Phrases that a bitmap may hold."""
    return lambda start, hashes, columns: phrases.value(phrase_hash(start, [hashes[c] for c in columns]))


def _both_frequent(words):
    def wanted(start, hashes, columns):
        known = words.value(phrase_hash(start, [hashes]))
        return known[columns[0]] & known[columns[1]]

    return wanted


def _grown_from(prefixes, pairs):
    def wanted(start, hashes, columns):
        of = [hashes[c] for c in columns]
        passed = np.flatnonzero(pairs.value(phrase_hash(start, of[-2:])))
        good = prefixes.value(phrase_hash(start, [h[passed] for h in of[:-1]]))
        out = np.zeros(len(columns[0]), bool)
        out[passed[good]] = True
        return out

    return wanted


def _big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def _share(a: Column | str, whole: Column | str) -> Column:
    """floor(PARTS * a / whole), exact beyond 64 bits."""
    return F.call_function("div", F.lit(PARTS).cast("decimal(8,0)") * _big(a), _big(whole)).cast("long")


def _four_fifths(longer: Column, a: Column) -> Column:
    return _big(longer) * 5 >= _big(a) * 4


def _words(first: Column | int, many: Column | int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, many), " ")


def _scored(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """Phrases (lang, phrase, size, f) with l, r and score of their weakest cut and the count of their first word; all parts are known."""
    cuts = phrases.select("lang", "phrase", "size", "f", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", _words(1, F.col("k")).alias("left"), _words(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    part = lambda side, name: known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", _share("f", F.col("l") + F.col("r")))
    best = cuts.groupBy("lang", "phrase", "size", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"), F.min(F.struct("k", "l")).alias("first"))
    return best.select("lang", "phrase", "size", "f", "best.l", "best.r", "best.score", F.col("first.l").alias("head"))


def _standing(known: DataFrame, pairs: DataFrame, grown: DataFrame) -> DataFrame:
    """Candidates with what is known of them: is_grown, refuted, settled, and the greatest count that a phrase grown from them may have.

    settled: all phrases one word longer that could push the candidate out have been counted.
    """
    marked = known.join(grown.select("lang", "phrase", F.lit(True).alias("is_grown")), ["lang", "phrase"], "left")
    marked = marked.withColumn("is_grown", F.coalesce("is_grown", F.lit(False)))
    inside = F.array(_words(1, F.col("size") - 1), _words(2, F.col("size") - 1))
    above = known.filter("size > 2").select("lang", F.explode(inside).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("above"))
    after = pairs.select("lang", _words(1, 1).alias("last"), "f").groupBy("lang", "last").agg(F.max("f").alias("after"))
    ungrown = marked.filter(~F.col("is_grown") & (F.col("size") < LONGEST)).select("lang", "size", _words(2, F.col("size") - 1).alias("tail"), "f")
    before = ungrown.groupBy("lang", "size", "tail").agg(F.max("f").alias("before"))
    one = before.filter("size = 2").select("lang", F.col("tail").alias("head1"), F.col("before").alias("before1"))
    two = before.filter("size = 3").select("lang", F.col("tail").alias("head2"), F.col("before").alias("before2"))
    rows = marked.select("*", _words(F.col("size"), 1).alias("last"), _words(1, 1).alias("head1"), F.when(F.col("size") > 2, _words(1, 2)).alias("head2"))
    rows = rows.join(above, ["lang", "phrase"], "left").join(after, ["lang", "last"], "left")
    rows = rows.join(one, ["lang", "head1"], "left").join(two, ["lang", "head2"], "left")
    whole = F.col("size") == LONGEST
    reach = lambda c: F.coalesce(_four_fifths(F.col(c), F.col("f")), F.lit(False))
    right = ~F.col("is_grown") & reach("after")
    left = reach("before1") | reach("before2")
    return rows.select(
        "lang", "phrase", "size", "f", "l", "r", "score", "head", "last", "head1", "head2", "is_grown", reach("above").alias("refuted"),
        (~whole & right).alias("open_right"), (~whole & left).alias("open_left"),
        F.when(~whole & ~F.col("is_grown"), F.least("f", F.coalesce("after", F.lit(0)))).alias("most"),
    )


def _goals(standing: DataFrame, keep: int, reach: int) -> DataFrame:
    """(lang, goal): the score that decides what is looked at next.

    The goal is the score at place `keep` among the settled candidates, or that at place `reach` among all not refuted if it is higher; 0
    where there are not so many. Scores are whole numbers up to PARTS / 2, so a language has a bounded histogram.
    """
    alive = standing.filter(~F.col("refuted"))
    steps = alive.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("open_left") & ~F.col("open_right")).alias("sure"))
    upto = Window.partitionBy("lang").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("lang", "score", F.sum("all").over(upto).alias("all"), F.sum("sure").over(upto).alias("sure"))
    at = lambda c, n: F.coalesce(F.max(F.when(F.col(c) >= n, F.col("score"))), F.lit(0))
    return steps.groupBy("lang").agg(F.greatest(at("sure", keep), at("all", reach)).alias("goal"))


def _wave(standing: DataFrame, goals: DataFrame) -> DataFrame:
    """The prefixes (lang, phrase) to grow next: those whose bound reaches the goal, and those that could still push out a candidate of at least
    that score; with a prefix of three words also its last two, whose growth its own phrases are scored with."""
    rows = standing.join(goals, "lang")
    bound = _share("most", F.col("head") + F.col("most"))
    open_ = (F.col("most") >= LEAST) & ~F.col("is_grown")
    promising = rows.filter(open_ & (bound >= F.col("goal")))
    doubtful = rows.filter(~F.col("refuted") & (F.col("score") >= F.col("goal")))
    own = doubtful.filter("open_right")
    left = doubtful.filter("open_left")
    heads = left.select("lang", F.col("head1").alias("tail"), "f").union(left.filter("head2 is not null").select("lang", "head2", "f"))
    heads = heads.groupBy("lang", "tail").agg(F.min("f").alias("least"))
    rivals = rows.filter(~F.col("is_grown") & (F.col("size") < LONGEST)).withColumn("tail", _words(2, F.col("size") - 1)).join(heads, ["lang", "tail"])
    rivals = rivals.filter(_four_fifths(F.col("f"), F.col("least")))
    first = reduce(DataFrame.union, [t.select("lang", "phrase", "size") for t in (promising, own, rivals)]).distinct()
    ends = first.filter("size = 3").select("lang", _words(2, 2).alias("phrase")).distinct()
    ends = ends.join(standing.filter(~F.col("is_grown")), ["lang", "phrase"], "left_semi")
    return first.select("lang", "phrase").union(ends).distinct()


def grow(docs: DataFrame, text: str = "text", lang: str = "lang", keep: int = KEEP) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(candidates with their standing, goal per language, prefixes that were grown, words per language), all in the shared folder."""
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    chunks = stored(rows.mapInArrow(_chunk, CHUNKS), "collocation-chunks", PAGES)
    totals = stored(chunks.mapInArrow(_word_totals, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")), "collocation-totals")
    share = spark.sparkContext.broadcast
    frequent = lambda scan: _counts(chunks, scan).filter(F.col("f") >= LEAST)
    words = stored(frequent(_counter((1,), _all_in(share(_likely(chunks, _summed(1, None)))))), "collocation-words")
    likely = _likely(chunks, _summed(2, _both_frequent(share(sieve(hashed(words))))))
    pairs = stored(frequent(_counter((2,), _all_in(share(likely)))), "collocation-pairs")
    pair_sieve = share(sieve(hashed(pairs)))
    lookup = words.select("lang", "phrase", "f").union(pairs.select("lang", "phrase", "f"))
    known = stored(_scored(pairs.select("lang", "phrase", F.lit(2).alias("size"), "f"), lookup), "collocation-scored")
    grown = known.select("lang", "phrase").limit(0)
    reach = 2 * keep
    while True:
        standing = stored(_standing(known, pairs, grown), "collocation-standing")
        goals = stored(_goals(standing, keep, reach), "collocation-goals")
        wave = stored(_wave(standing, goals), "collocation-wave")
        if wave.isEmpty():
            return standing, goals, grown, totals
        counted = frequent(_counter((3, 4), _grown_from(share(sieve(hashed(wave))), pair_sieve)))
        counted = counted.withColumn("size", F.size(F.split("phrase", " "))).withColumn("prefix", _words(1, F.col("size") - 1))
        counted = counted.join(wave.select("lang", F.col("phrase").alias("prefix")), ["lang", "prefix"], "left_semi")
        counted = stored(counted.select("lang", "phrase", "size", "f"), "collocation-grown")
        lookup = lookup.union(counted.select("lang", "phrase", "f"))
        known = known.union(stored(_scored(counted, lookup), "collocation-scored"))
        grown = grown.union(wave)
        reach *= 2


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", keep: int = KEEP) -> DataFrame:
    """The first `keep` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; pieces end at [.,;:!?\\x0A-\\x0D], words at blanks and tabs. Null texts are empty, a null language is `und`. A phrase
    needs a count of LEAST; l and r are the counts of the parts of its weakest cut (the smallest of equal ones), score the floor of
    PARTS * a / (l + r), n the words of the language. A phrase inside a longer one with at least 80 % of its count is left out. Order: score,
    count, then phrase by bytes. Repeated rows count each; other columns are ignored; an empty table gives none.
    """
    standing, goals, _, totals = grow(docs, text, lang, keep)
    good = standing.filter(~F.col("refuted")).join(goals, "lang").filter(F.col("score") >= F.col("goal"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("f").desc(), "phrase")
    ranked = good.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


OP11_SQL = """
with t as (select coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from t),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
n as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
g as (select lang, array_to_string(w[cast(i as int):cast(i + k - 1 as int)], ' ') as phrase, k as size
      from w, range(1, 5) s(k), lateral (select unnest(range(1, len(w) - k + 2)) as i) u),
f as (select lang, phrase, any_value(size) as size, count(*) as f from g group by lang, phrase),
c as (select lang, phrase, size, f as a, string_split(phrase, ' ') as w from f where size > 1 and f >= 30),
cut as (select c.*, k, l.f as l, r.f as r, cast(cast(2000000 as hugeint) * a // (l.f + r.f) as bigint) as score
        from c, range(1, 4) s(k), f l, f r where k < c.size and l.lang = c.lang and r.lang = c.lang
        and l.phrase = array_to_string(w[1:cast(k as int)], ' ') and r.phrase = array_to_string(w[cast(k + 1 as int):], ' ')),
b as (select lang, phrase, any_value(size) as size, any_value(a) as a, arg_min(l, (score, k)) as l, arg_min(r, (score, k)) as r, min(score) as score
      from cut group by lang, phrase),
inside as (select lang, a, array_to_string(w[cast(i as int):cast(i + k - 1 as int)], ' ') as phrase
           from c, range(2, 4) s(k), range(1, 4) u(i) where k < size and i + k - 1 <= size),
over_ as (select lang, phrase, max(a) as above from inside group by lang, phrase),
kept as (select b.* from b left join over_ o using (lang, phrase) where o.above is null or cast(100 as hugeint) * o.above < cast(80 as hugeint) * b.a),
rk as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, cast(rank as bigint) as rank, phrase, a, l, r, n, score from rk join n using (lang) where rank <= 2000
"""
