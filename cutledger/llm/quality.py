"""Quality classifier by co-training.

Two views of a document are learned apart: its words and word endings, and its page metadata (source, language, length, lines, shares of
kinds of characters). From a bounded labelled sample each view learns a logistic regression; over several rounds each hands the documents of
an unlabelled pool that it is surest of, with their predicted labels, to the other. Both views are calibrated on labelled rows kept aside,
combined, and applied to every document in one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutledger.llm.common import ready, text_of
from cutledger.llm.numeric import LOWER, U, prefix_sums, span_hashes, word_edges

#: Bounds of the fit: expected labelled rows and pool rows (chosen by a hash of the id), rounds, documents handed over per class and round.
LABELLED, POOL, ROUNDS, HANDED = 4_000, 8_000, 3, 400
#: Pull of the calibration towards the uncalibrated score.
STIFF = 5.0
#: A view hands over what it is surer of than this.
SURE = 0.9
WORD_CELLS, ENDING_CELLS, ECHO_CELLS, META_CELLS = 1 << 14, 1 << 12, 20, 1 << 12
TEXT_CELLS = WORD_CELLS + ENDING_CELLS + ECHO_CELLS
# Kinds of bytes for word endings and shares. 0 blank, 1 lower, 2 upper, 3 digit, 4 other ASCII, 5 beyond ASCII.
KIND = np.array(
    [0 if b in (9, 10, 11, 12, 13, 32) else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 5 if b >= 128 else 4 for b in range(256)],
    np.uint8,
)


def text_features(data: bytes) -> np.ndarray:
    """Cells of the distinct words (A-Z lower), of the distinct word endings (kinds of the last three bytes), and of how often a word repeats the one before."""
    raw = np.frombuffer(data, np.uint8)
    start, end = word_edges(raw)
    if not len(start):
        return np.zeros(0, np.int32)
    words = span_hashes(prefix_sums(np.frombuffer(data.translate(LOWER), np.uint8)), start, end)
    echo = 20 * int((words[1:] == words[:-1]).sum()) // len(words)
    endings = span_hashes(prefix_sums(KIND[raw]), np.maximum(start, end - 3), end)
    cells = np.concatenate([words % U(WORD_CELLS), endings % U(ENDING_CELLS) + U(WORD_CELLS), [U(WORD_CELLS + ENDING_CELLS + echo)]])
    return np.unique(cells).astype(np.int32)


def meta_features(data: bytes, source: str | None, lang: str | None) -> np.ndarray:
    """Cells of source, language and of the sizes and shares of the page, in steps."""
    n = np.bincount(KIND[np.frombuffer(data, np.uint8)], minlength=6)
    size = len(data)
    lines = data.count(b"\n") + 1
    share = lambda k: int(20 * k / max(size, 1))
    said = [
        f"source={source}", f"lang={lang}", f"size={size.bit_length()}", f"lines={lines.bit_length()}", f"line={(size // lines).bit_length()}",
        f"upper={share(int(n[2]))}", f"digit={share(int(n[3]))}", f"sign={share(int(n[4]))}", f"blank={share(int(n[0]))}", f"far={share(int(n[5]))}",
    ]
    return np.unique([zlib.crc32(x.encode()) % META_CELLS for x in said]).astype(np.int32)


def _features(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        data = [t.encode("utf-8", "replace") for t in batch["text"]]
        yield pd.DataFrame({
            "doc_id": batch["doc_id"], "label": batch["label"], "words": [text_features(d).tobytes() for d in data],
            "meta": [meta_features(d, s, g).tobytes() for d, s, g in zip(data, batch["source"], batch["lang"])],
        })


class View:
    """Logistic regression on sets of cells; a document's cells weigh 1 / sqrt(their number)."""

    def __init__(self, cells: int, steps: int = 80, rate: float = 0.5, decay: float = 1e-4) -> None:
        self.weights, self.bias, self.steps, self.rate, self.decay = np.zeros(cells), 0.0, steps, rate, decay

    @staticmethod
    def stack(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(s) for s in sets], np.int64)
        row = np.repeat(np.arange(len(sets)), size)
        return row, (np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)).astype(np.int64), 1 / np.sqrt(np.maximum(size, 1))

    def fit(self, sets: list[np.ndarray], label: np.ndarray) -> View:
        row, cell, scale = self.stack(sets)
        n = len(self.weights)
        fast, slow = np.zeros(n + 1), np.zeros(n + 1)
        w = np.zeros(n + 1)
        for step in range(1, self.steps + 1):
            z = np.bincount(row, w[cell], len(sets)) * scale + w[n]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / len(sets)
            slope = np.append(np.bincount(cell, (error * scale)[row], n), error.sum()) + self.decay * w / len(sets)
            fast, slow = 0.9 * fast + 0.1 * slope, 0.99 * slow + 0.01 * slope**2
            w -= self.rate * (fast / (1 - 0.9**step)) / (np.sqrt(slow / (1 - 0.99**step)) + 1e-6)
        self.weights, self.bias = w[:n], float(w[n])
        return self

    def logit(self, sets: list[np.ndarray]) -> np.ndarray:
        row, cell, scale = self.stack(sets)
        return np.bincount(row, self.weights[cell], len(sets)) * scale + self.bias


def platt(logit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(slope, shift) of p = 1 / (1 + exp(-(slope * logit + shift))) by Newton steps, with smoothed targets."""
    yes, no = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    x, ab = np.stack([logit, np.ones(len(logit))], 1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        slope = x.T @ (target - p) - STIFF * (ab - [1.0, 0.0])
        ab = ab + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + STIFF * np.eye(2), slope)
    return np.array([max(ab[0], 0.0), ab[1]])


@dataclass
class Model:
    """Both views with their calibration; `known` is False where the labels show one class or none, and every score is `prior`."""

    words: View
    meta: View
    words_fit: np.ndarray
    meta_fit: np.ndarray
    trust: float  # share of the words' view in the combined score
    prior: float
    known: bool

    def scores(self, words: list[np.ndarray], meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.known:
            flat = np.full(len(words), self.prior)
            return flat, flat, flat
        a = self.words_fit[0] * self.words.logit(words) + self.words_fit[1]
        b = self.meta_fit[0] * self.meta.logit(meta) + self.meta_fit[1]
        chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return chance(a), chance(b), chance(self.trust * a + (1 - self.trust) * b)


def co_train(
    words: list[np.ndarray], meta: list[np.ndarray], label: np.ndarray, pool_words: list[np.ndarray], pool_meta: list[np.ndarray],
    aside: np.ndarray, rounds: int = ROUNDS, handed: int = HANDED,
) -> Model:
    """Co-train on the labelled rows that are not kept `aside`, calibrate on those that are."""
    fit = np.flatnonzero(~aside)
    views = {"words": (TEXT_CELLS, words, pool_words), "meta": (META_CELLS, meta, pool_meta)}
    extra: dict[str, dict[int, int]] = {"words": {}, "meta": {}}  # pool rows and pseudo-labels handed to each view
    learned: dict[str, View] = {}
    for round_ in range(rounds + 1):
        for name, (cells, own, pool) in views.items():
            more = sorted(extra[name])
            y = np.concatenate([label[fit], [extra[name][i] for i in more]])
            learned[name] = View(cells).fit([own[i] for i in fit] + [pool[i] for i in more], y)
        if round_ == rounds:
            break
        for name, other in (("words", "meta"), ("meta", "words")):
            pool = views[name][2]
            if not len(pool):
                continue
            p = 1 / (1 + np.exp(-np.clip(learned[name].logit(pool), -30, 30)))
            for value, sure in ((1, p), (0, 1 - p)):
                best = [i for i in np.argsort(-sure, kind="stable") if sure[i] >= SURE and i not in extra[other]][:handed]
                extra[other].update({int(i): value for i in best})
    held = np.flatnonzero(aside)
    y = label[held]
    fits, loss = {}, {}
    for name, (_, own, _) in views.items():
        z = learned[name].logit([own[i] for i in held])
        fits[name] = platt(z, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(fits[name][0] * z + fits[name][1], -30, 30))), 1e-6, 1 - 1e-6)
        loss[name] = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 1e-6
    trust = loss["meta"] / (loss["words"] + loss["meta"])  # the view with the smaller loss counts more
    return Model(learned["words"], learned["meta"], fits["words"], fits["meta"], float(trust), float(label.mean()), True)


def _place(doc_id: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", labelled: int = LABELLED, pool: int = POOL) -> Model:
    """Fit on about `labelled` labelled rows and a pool of about `pool` rows, whole texts, drawn by a hash of the id; a fifth is kept aside.

    Rows with a null id or label are no examples; of an id with two different labels the larger counts. Labels of one class, or fewer than
    ten examples, give a model whose score is their mean (0.5 without any).
    """
    ready(docs.sparkSession)
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("double").alias("label"))
    n, n_docs = known.count(), docs.count()
    few = known.filter(_place("__id", 3) * n < labelled)
    view = [F.col(doc_id).cast("long").alias("doc_id"), text_of().alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")]
    rows = docs.select(*view)
    # bounded by `labelled`, and so sent whole
    examples = rows.join(F.broadcast(few), rows["doc_id"] == F.col("__id")).drop("__id").dropDuplicates(["doc_id"])
    loose = rows.filter(_place("doc_id", 5) * n_docs < pool).join(F.broadcast(few.select("__id")), F.col("doc_id") == F.col("__id"), "left_anti")
    schema = "doc_id long, label double, words binary, meta binary"
    got = examples.unionByName(loose.withColumn("label", F.lit(None).cast("double"))).mapInPandas(_features, schema).toPandas()
    got = got.sort_values(["doc_id", "label"], kind="stable")
    sets = lambda rows, name: [np.frombuffer(b, np.int32) for b in rows[name]]
    seen, unseen = got[got["label"].notna()], got[got["label"].isna()]
    y = seen["label"].to_numpy(float)
    aside = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in seen["doc_id"]], bool)
    if len(y) < 10 or any(len(set(y[k])) < 2 for k in (aside, ~aside)):
        return Model(View(TEXT_CELLS), View(META_CELLS), np.ones(2), np.ones(2), 0.5, float(y.mean()) if len(y) else 0.5, False)
    return co_train(sets(seen, "words"), sets(seen, "meta"), y, sets(unseen, "words"), sets(unseen, "meta"), aside)


SCHEMA = "doc_id long, words_score double, meta_score double, score double, kept boolean"


def _scorer(model, keep_from: float) -> Callable:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [t.encode("utf-8", "replace") for t in batch["text"]]
            words = [text_features(d) for d in data]
            meta = [meta_features(d, s, g) for d, s, g in zip(data, batch["source"], batch["lang"])]
            a, b, both = model.value.scores(words, meta)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "words_score": a, "meta_score": b, "score": both, "kept": both >= keep_from})

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", keep_from: float = 0.5) -> DataFrame:
    """Per row: doc_id, words_score, meta_score, score (chance of good quality), kept (score at least `keep_from`). No shuffle.

    Null texts count as empty, null sources and languages as a value of their own. Repeated rows come out repeated; other columns are ignored.
    """
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of().alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInPandas(_scorer(sent, keep_from), SCHEMA)
