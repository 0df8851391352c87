"""Language identification by prediction by partial matching (PPM).

For each language a context tree of bytes, three bytes deep, is learned once and then frozen. The code length of a text is the sum over its
bytes of -log2 p(byte | longest known context), escaping to shorter contexts (method C: a context with n bytes of d kinds escapes with
d / (n + d)) down to 8 bits for a byte never seen. The language with the shortest code wins. All trees are laid out in one table
(context, byte) -> code lengths of all languages, so that a task adds up whole columns of bytes instead of walking a tree.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.llm.common import ready, stored, text_of

DEPTH = 3
#: Expected number of documents per language in the training sample, and the size bounds of the model.
DOCS_PER_LANG = 2_000
MAX_CONTEXTS = 30_000
MIN_CONTEXT = 4
#: Code lengths are held in steps of 1/1024 bit.
UNIT = 1024
CHUNK = 1_000_000
UNKNOWN = "und"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ASCII_LETTER = re.compile("[A-Za-z]")
COUNTS = "lang string, depth int, gram long, n long"


def has_letter(text: str) -> bool:
    return bool(ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text)))


def folded(text: str) -> np.ndarray:
    """The text's bytes with A-Z lower, behind DEPTH blanks as its first context."""
    return np.frombuffer(b" " * DEPTH + text.encode("utf-8", "replace").translate(LOWER), np.uint8)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of several texts, places of the bytes to be coded, and where each text's places begin."""
    parts = [folded(t) for t in texts]
    sizes = np.array([len(p) for p in parts])
    own = np.ones(int(sizes.sum()), bool)
    starts = np.cumsum(sizes) - sizes
    for k in range(DEPTH):
        own[starts + k] = False
    coded = sizes - DEPTH
    return np.concatenate(parts), np.flatnonzero(own), np.cumsum(coded) - coded


def count_grams(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, depth, gram, n): how often each byte follows each context of 0 to DEPTH bytes in the batch."""
    for batch in batches:
        for lang, texts in batch[batch["text"] != ""].groupby("lang")["text"]:
            data, at, _ = _joined(texts.tolist())
            data = data.astype(np.int64)
            gram = data[at]
            for depth in range(DEPTH + 1):
                if depth:
                    gram = gram | data[at - depth] << (8 * depth)
                kinds, n = np.unique(gram, return_counts=True)
                yield pd.DataFrame({"lang": lang, "depth": np.int32(depth), "gram": kinds, "n": n})


def in_training(doc_id: str = "doc_id"):
    """Not held out: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 != 2


@dataclass
class Model:
    """Frozen counts of a bounded sample; the tables are built from them once per worker process."""

    langs: list[str]
    depth: np.ndarray
    lang: np.ndarray
    gram: np.ndarray
    n: np.ndarray
    key: str = field(default_factory=lambda: uuid4().hex)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(class of each byte, state of each context of three classes, code lengths by state x class and language, number of classes)."""
        kinds = len(self.langs)
        seen = np.unique(self.gram[self.depth == 0])
        classes = np.zeros(256, np.int64)
        classes[seen] = np.arange(1, len(seen) + 1)
        a = len(seen) + 1
        rows = np.full((1, a, kinds), 8.0, np.float32)
        state = np.zeros((a,) * DEPTH, np.int32)  # state of the longest known context; last axis: the nearest byte
        for depth in range(DEPTH + 1):
            mine = self.depth == depth
            gram, lang, n = self.gram[mine], self.lang[mine], self.n[mine].astype(np.float64)
            byte, above = classes[gram & 255], gram >> 8
            context = np.zeros(len(gram), np.int64)
            for back in range(depth, 0, -1):  # farthest byte first
                context = context * a + classes[(above >> (8 * (back - 1))) & 255]
            total = np.bincount(np.unique(context, return_inverse=True)[1], n) if len(n) else np.zeros(0)
            known = np.unique(context)
            if depth == DEPTH:
                # the least frequent deep contexts are cut: their bytes are coded in the shorter context
                order = np.argsort(-total, kind="stable")[:MAX_CONTEXTS]
                known = np.sort(known[order][total[order] >= MIN_CONTEXT])
            slot = np.searchsorted(known, context)
            kept = (slot < len(known)) & (known[np.minimum(slot, max(len(known) - 1, 0))] == context) if len(known) else np.zeros(len(context), bool)
            slot, byte, lang, n = slot[kept], byte[kept], lang[kept], n[kept]
            if not len(slot) and depth:
                continue
            shorter = state.reshape(a ** (DEPTH - depth), -1)[0][known] if depth else np.zeros(1, np.int64)
            below = rows[shorter]  # what an escape costs on
            sums, distinct = np.zeros((len(known), kinds)), np.zeros((len(known), kinds))
            np.add.at(sums, (slot, lang), n)
            np.add.at(distinct, (slot, lang), 1)
            has = sums > 0
            escape = np.where(has, np.log2(np.where(has, sums + distinct, 1)) - np.log2(np.where(has, distinct, 1)), 0)
            new = below
            new += escape[:, None, :].astype(np.float32)
            new[slot, byte, lang] = np.log2((sums + distinct)[slot, lang]) - np.log2(n)
            if depth == 0:
                rows = new
            else:
                state.reshape(a ** (DEPTH - depth), -1)[:, known] = len(rows) + np.arange(len(known))
                rows = np.concatenate([rows, new])
        return classes, state.reshape(-1), np.minimum(np.rint(rows * UNIT), 65535).astype(np.uint16).reshape(-1, kinds), a


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Model from the rows of `docs` with a language, of a sample of about `docs_per_lang` whole documents per language (by a hash of the id).

    Rows without a language or text teach nothing; without any row the model has no language and every text is undetermined.
    """
    ready(docs.sparkSession)
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    # stored, so that Spark knows its size and broadcasts it if it is small
    share = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("have")), "language-share")
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.join(share, "lang").filter(place * F.col("have") < docs_per_lang).select("lang", text_of().alias("text"))
    counts = sample.mapInPandas(count_grams, COUNTS).groupBy("lang", "depth", "gram").agg(F.sum("n").alias("n"))
    got = counts.toPandas()  # bounded by the sample
    langs = sorted(got["lang"].unique().tolist())
    code = got["lang"].map({x: i for i, x in enumerate(langs)})
    return Model(langs, got["depth"].to_numpy(np.int8), code.to_numpy(np.int64), got["gram"].to_numpy(np.int64), got["n"].to_numpy(np.int64))


_BUILT: dict[str, tuple] = {}


def code_lengths(model: Model, texts: list[str]) -> np.ndarray:
    """Code length in steps of 1/UNIT bit of each (non-empty) text in each language."""
    if model.key not in _BUILT:
        _BUILT.clear()
        _BUILT[model.key] = model.tables()
    classes, state, lengths, a = _BUILT[model.key]
    data, at, starts = _joined(texts)
    c = classes[data]
    out = np.zeros((len(texts), len(model.langs)), np.int64)
    for lo in range(0, len(at), CHUNK):
        p = at[lo : lo + CHUNK]
        context = (c[p - 3] * a + c[p - 2]) * a + c[p - 1]
        cost = lengths[state[context].astype(np.int64) * a + c[p]]
        first = max(int(np.searchsorted(starts, lo, "right")) - 1, 0)
        cuts = np.maximum(starts[first : int(np.searchsorted(starts, lo + len(p)))] - lo, 0)
        out[first : first + len(cuts)] += np.add.reduceat(cost, cuts, axis=0, dtype=np.int64)
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, bits per byte of the best language) of each text; `und`, 0 and null without text or letter."""
    names, score, rate = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
    todo = [i for i, t in enumerate(texts) if t and has_letter(t)] if model.langs else []
    at = 0
    while at < len(todo):
        upto, size = at, 0
        while upto < len(todo) and size < CHUNK:
            size += len(texts[todo[upto]])
            upto += 1
        part = todo[at:upto]
        bits = code_lengths(model, [texts[i] for i in part]) / UNIT
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(part)), best]
        score[part] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
        rate[part] = least / np.array([len(texts[i].encode("utf-8", "replace")) for i in part])
        for i, b in zip(part, best):
            names[i] = model.langs[b]
        at = upto
    return names, score, rate


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


def _predictor(model) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, rate = predict(model.value, batch.column(2).to_pylist())
            cols = [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(rate, from_pandas=True)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return run


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (share of the best language in the likelihood), bits_per_byte. No shuffle.

    Null texts and texts without a letter are `und` with score 0. Ties go to the first language in code-point order. Repeated rows come out
    repeated; other columns are ignored.
    """
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (~in_training(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(_predictor(sent), SCHEMA)


#: A document that costs this much per byte in its best language (8 bits and an escape for nearly every byte) is in none of them.
MAX_BITS_PER_BYTE = 12.0


def _keeper(model, text: str) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _, rate = predict(model.value, batch.column(batch.schema.names.index(text)).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and r < MAX_BITS_PER_BYTE for n, r in zip(names, rate)], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows in a learned language, with all columns of `docs`: rows that are `und` or cost MAX_BITS_PER_BYTE or more go."""
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keeper(sent, text), docs.schema)
