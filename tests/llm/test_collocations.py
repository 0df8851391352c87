"""Collocations against a count of everything."""

import random
import re
from collections import Counter

import pytest

from cutledger.llm import collocations as co

ROW = "doc_id long, text string, lang string, f string, n string, phrase string, score string"


def plain(rows, keep):
    """rows (lang, text): every phrase counted, scored, and dropped inside a longer one of 80 %."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= 30}
    above = Counter()
    for (lang, p), a in found.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                above[lang, p[i : i + size]] = max(above[lang, p[i : i + size]], a)
    out = {}
    for (lang, p), a in found.items():
        if 100 * above[lang, p] >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return {lang: [(i + 1, e[2].decode(), *e[3:]) for i, e in enumerate(sorted(es)[:keep])] for lang, es in out.items()}


def mined(df, keep):
    out = {}
    for r in co.collocations(df, keep=keep).collect():
        out.setdefault(r["lang"], []).append((r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]))
    return {lang: sorted(rows) for lang, rows in out.items()}


def corpus(seed, docs=400):
    """Texts over few words with planted phrases of every length, some nearly always inside longer ones."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "the", "of", "a-b", "("]
    fixed = [" ".join(rnd.sample(words, rnd.randint(2, 5))) for _ in range(40)]
    rows = []
    for i in range(docs):
        parts = [rnd.choice(fixed) if rnd.random() < 0.5 else rnd.choice(words) for _ in range(rnd.randint(1, 60))]
        text = "".join(p + rnd.choice([" ", " ", " ", " \t", ". ", ",", "\n", "\x0b", "\x0d "]) for p in parts)
        rows.append((i, text.upper() if i % 7 == 0 else text, rnd.choice(["en", "fr", None, "und"]), "x", "y", "z", "s"))
    return rows + [(1000, None, "en", *"abcd"), (1001, "", "de", *"abcd"), (1002, " .,; ", "fr", *"abcd"), rows[0], rows[0]]


@pytest.mark.parametrize("seed, keep", [(1, 2000), (2, 15), (3, 1)])
def test_matches_a_count_of_everything(spark, seed, keep):
    rows = corpus(seed)
    assert mined(spark.createDataFrame(rows, ROW), keep) == plain([(r[2], r[1]) for r in rows], keep)


def test_bounds_leave_prefixes_ungrown(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, ROW)
    standing, _, grown, _ = co.grow(df, keep=10)
    assert 0 < grown.count() < standing.filter("size < 4").count()


def test_tasks_hand_on_what_they_hold(monkeypatch):
    """Small limits: dictionaries and tallies are emptied many times, slices cut texts; a very long text too."""
    rows = [(r[2], r[1]) for r in corpus(6, 120)] + [("en", "alpha beta gamma delta " * 9_000), ("en", "x" * 5_000), ("en", "one two.three" * 40)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([lang or "und" for lang, _ in rows]), pa.array([t for _, t in rows])], ["lang", "text"])
    everything = lambda start, hashes, columns: slice(None)

    def count():
        chunks = list(co._chunk(iter([batch])))
        sums = [Counter() for _ in range(2)]
        for n in (1, 2):
            for b in co._summed(n, everything)(iter(chunks)):
                for h, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    sums[n - 1][h] += f
        phrases = [total(co._counter((n,), everything)(iter(chunks))) for n in (1, 2, 3, 4)]
        assert [sorted(s.values()) for s in sums] == [sorted(p.values()) for p in phrases[:2]]
        return phrases, sum(b.column(1)[0].as_py() for b in co._word_totals(iter(chunks)))

    wide = count()
    for name, value in {"SLICE": 700, "CHUNK": 90, "WORDS_HELD": 40, "SUMS_HELD": 60}.items():
        monkeypatch.setattr(co, name, value)
    assert count() == wide and wide[1] == sum(wide[0][0].values())


def total(batches):
    out = Counter()
    for b in batches:
        for lang, phrase, f in zip(*(b.column(i).to_pylist() for i in range(3))):
            out[lang, phrase] += f
    return out


def test_empty_tables(spark):
    assert mined(spark.createDataFrame([], ROW), 10) == {}
    assert mined(spark.createDataFrame([(1, None, None, *"abcd"), (2, " ", "en", *"abcd")], ROW), 10) == {}


def test_scores_are_exact_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("9007199254740993 * 100 as a", "9007199254740995 * 201 as whole")
    a, whole = 9007199254740993 * 100, 9007199254740995 * 201
    assert row.select(co._share("a", "whole")).first()[0] == 2_000_000 * a // whole
    close = spark.range(1).selectExpr("4000000000000000000L as f", "5000000000000000001L as a")
    import pyspark.sql.functions as F

    assert close.select(co._four_fifths(F.col("f"), F.col("a"))).first()[0] is False
