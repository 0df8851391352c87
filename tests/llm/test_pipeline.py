"""Mixture, packing, the pipeline's stages."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from cutledger.llm import mixing, packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes):
    """Targets by handing out in rounds: (source -> size) to (source -> target)."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in sorted(free, key=str):
            target[s] += share * weight[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                free = free - {s}
    return target


def test_mixture(spark, docs, odd, none):
    rng = np.random.default_rng(2)
    made = [(i, " ".join(["w"] * int(rng.integers(0, 40))), f"s{int(rng.integers(0, 9)) ** 2}") for i in range(3_000)]
    for table in (docs, spark.createDataFrame(made, "doc_id long, text string, source string")):
        rows = mixing.mix(table).collect()
        sizes = Counter()
        for r in rows:
            sizes[r["source"]] += r["size"]
        target = shares(sizes)
        most = max(r["size"] for r in rows)
        taken = Counter()
        for r in rows:
            assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
            assert abs(r["target"] - target[r["source"]]) < 1e-6
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - target[s]) <= 2 * most for s in target)
        assert sum(sizes.values()) - most < sum(taken.values()) <= sum(sizes.values())
        assert sorted(map(tuple, mixing.mix(table).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0


def test_take_repeats_rows(docs, odd, none):
    for table in (docs, odd):
        got = mixing.take(table)
        assert got.columns == table.columns
        want = sum(r["turns"] for r in mixing.mix(table).collect())
        assert got.count() == want
        assert sum(len(WORD.findall(r["text"] or "")) for r in got.collect()) == sum(r["taken"] for r in mixing.mix(table).collect())
    assert mixing.take(none).count() == 0


def test_bounds_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n, k = int(rng.integers(1, 8)), int(rng.integers(1, 5))
        tops = np.sort(rng.choice(60, n, replace=False))
        rows = rng.integers(1, 9, n)
        cost = lambda ends: sum(r * (min(e for e in ends if e >= t) - t) for t, r in zip(tops, rows))
        best = min(cost((*c, tops[-1])) for m in range(min(k, n)) for c in combinations(tops[:-1], m))
        got = packing.optimal_bounds(tops, rows, tops * rows, k)
        assert len(got) <= k and cost(tuple(got)) == best


def test_bins_ascend(spark):
    got = [r["b"] for r in spark.range(0, 5_000).select(packing.bin_of(F.col("id")).alias("b"), "id").orderBy("id").collect()]
    assert got == sorted(got) and got[: 2 * packing.GRAIN] == list(range(2 * packing.GRAIN)) and len(set(got)) < 600


def test_packing(docs, odd, none):
    for table in (docs, odd):
        rows = packing.pack(table, buckets=4, batch_tokens=2_000).collect()
        sizes = sorted(len(WORD.findall(r["text"] or "")) for r in table.collect())
        assert sorted(r["length"] for r in rows) == sizes and len({r["pad_to"] for r in rows}) <= 4
        fill = Counter()
        for r in rows:
            assert r["length"] <= r["pad_to"] and r["padding"] == r["pad_to"] - r["length"]
            fill[r["bucket"], r["batch"]] += 1
        per = {r["bucket"]: max(1, 2_000 // max(r["pad_to"], 1)) for r in rows}
        for b, n in per.items():
            sizes = sorted((k[1], v) for k, v in fill.items() if k[0] == b)
            assert [k for k, _ in sizes] == list(range(len(sizes))) and all(v == n for _, v in sizes[:-1]) and 0 < sizes[-1][1] <= n
        assert len({(r["bucket"], r["batch"], r["slot"]) for r in rows}) == len(rows)
    assert packing.pack(none).count() == 0


def test_stages(spark, docs, odd, none):
    from cutledger.llm.numeric import shingle_set

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "pack"]
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    sf = "/root/testdata/sf0.001"
    first = stage["language"](spark, docs, sf)
    assert ids(first) == ids(docs)  # every document of the table is in one of its languages
    second = stage["exact"](spark, docs, sf)
    rows = docs.select("doc_id", "text").collect()
    last = {}
    for r in rows:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert ids(second) == sorted(last.values())
    third = stage["near"](spark, second, sf)
    sets = {r["doc_id"]: shingle_set(r["text"], 5) for r in second.collect()}
    left = set(ids(third))
    for i, s in sets.items():
        if i not in left:
            assert any(10 * np.intersect1d(s, o).size >= 8 * np.union1d(s, o).size for j, o in sets.items() if j != i)
    for i, j in combinations(sorted(left), 2):
        assert 10 * np.intersect1d(sets[i], sets[j]).size < 8 * np.union1d(sets[i], sets[j]).size or not len(sets[i])
    for name in ("language", "exact", "near", "mix"):
        assert stage[name](spark, odd, sf).columns == odd.columns
        assert stage[name](spark, none, sf).count() == 0
    assert stage["pack"](spark, none, sf).count() == 0
    whole = corpus_pipeline.run(spark, sf)
    assert whole.count() == stage["mix"](spark, third, sf).count() and "batch" in whole.columns
