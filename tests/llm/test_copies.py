"""Repeated strings, similar documents, fingerprints, exact copies."""

import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from cutledger.llm import components, exact, fingerprints, jaccard, repeats
from cutledger.llm.numeric import shingle_set


def repeat_table(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        raw = np.frombuffer(b, np.uint8)
        out.append((i, len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def test_covers_hold_every_difference():
    for v, d in repeats.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_repeats_match_brute_force(spark, texts, odd, none):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words, n))
    shared = [say(n) for n in (60, 90, 200, 50)]
    made = [(1000 + i, f"{say(30)} {shared[i % 4]} {say(20)} {shared[(i * i) % 4][: 40 * i]}") for i in range(24)]
    made += [(2000, "ab" * 400), (2001, "!! " * 150), (2002, say(10) + "x" * 500 + say(5)), (2003, made[0][1]), (2004, shared[2][100:900] + shared[1][3:]), (2005, "y" * 200), (2006, "z" * 199)]
    rows = texts + made + [(None, None), (7, "é" * 260)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, repeats.remove_repeats(df).collect()), key=str) == repeat_table(rows, 200)
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(odd).collect()}
    assert got[1] == got[2] == got[4] == 0 and got[7] > 0
    assert repeats.remove_repeats(none).count() == 0


def components_of(sets, similar):
    held = defaultdict(list)
    for i, s in sets.items():
        for h in s.tolist():
            held[h].append(i)
    both = Counter(p for ids in held.values() for p in combinations(sorted(ids), 2))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= similar * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("words, similar", [(4, 85), (5, 80)])
def test_similar_documents_match_brute_force(spark, texts, words, similar):
    rng = np.random.default_rng(similar)
    vocab = [f"w{i}" for i in range(300)]
    rows, at = list(texts), 10_000
    for size in (1, 2, 3, 4, 5, 8, 20, 60, 150, 400):
        base = list(rng.choice(vocab, size))
        for k in range(14):  # chains of edits: linked through one another
            rows.append((at, " ".join(base)))
            at += 1
            base[int(rng.integers(0, len(base)))] = str(rng.choice(vocab))
            if k % 3 == 0 and size > 20:
                base = base[: -int(rng.integers(1, 6))]
    passage = " ".join(rng.choice(vocab, 60))
    rows += [(at + k, passage + " " + " ".join(rng.choice(vocab, 40))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.similar_documents(df, words=words, similar=similar, bucket_bytes=20_000).collect()
    sets = {i: shingle_set(t, words) for i, t in rows}
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == components_of(sets, similar)
    kept = jaccard.keep_one(df, words=words, similar=similar)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(components_of(sets, similar).values()))


def test_similar_pairs_share_a_signature():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 600))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        most = 15 * 2 * len(a) // 185
        b = a.copy()
        for _ in range(int(rng.integers(0, most // 2 + 1))):
            b[int(rng.integers(0, len(b)))] = rng.integers(0, 2**63)
        b = np.unique(b)[: max(1, len(b) - int(rng.integers(0, max(1, most // 4))))]
        if jaccard.similar_enough(a, b):
            assert np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)).size


def test_odd_documents_join(odd, none):
    got = sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(odd).collect()], key=str)
    assert len(got) == odd.count()
    by_id = {d: c for d, _, c in got}
    assert by_id[1] == 1 and by_id[2] == 2 and by_id[5] == 4 and by_id[None] == 4 and by_id[8] == 7 and by_id[12] == 12
    assert jaccard.similar_documents(none).count() == 0
    assert jaccard.keep_one(odd).columns == odd.columns


def test_keep_one_of_each_component_with_null_and_repeated_ids(spark):
    say = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [(None, say("a")), (None, say("b")), (None, say("b") + " tail"), (5, say("c")), (5, say("d")), (3, say("d") + " tail"), (7, say("e")), (7, say("e"))]
    rows += [(None, ""), (None, None), (None, " "), (8, ""), (8, "\t"), (9, "")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    full = sorted([(r["doc_id"], r["text"].split()[0][0]) for r in kept if (r["text"] or "").strip()], key=str)
    assert full == sorted([(None, "a"), (None, "b"), (5, "c"), (3, "d"), (7, "e")], key=str)
    empty = sorted([(r["doc_id"], r["text"] or "") for r in kept if not (r["text"] or "").strip()], key=str)
    assert empty == sorted([(None, ""), (None, " "), (8, ""), (8, "\t"), (9, "")], key=str)


def test_all_links_are_counted(spark, monkeypatch):
    monkeypatch.setattr(jaccard._link_counts, "__defaults__", (7,))  # several teams per component
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(300)]
    base, rows = list(rng.choice(vocab, 150)), []
    for k in range(40):  # a chain of edits: near ones link, far ones do not
        rows.append((k, " ".join(base)))
        base[int(rng.integers(0, 150))] = str(rng.choice(vocab))
    rows += [(100, rows[3][1]), (None, rows[3][1].upper()), (101, "other words stand here alone"), (102, ""), (103, None)]
    sets = [shingle_set(t, 4) for _, t in rows]
    want = [sum(len(a) > 0 and len(b) > 0 and jaccard.similar_enough(a, b) for k, b in enumerate(sets) if k != i) for i, a in enumerate(sets)]
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert max(want) > 3 and sorted([(r["doc_id"], r["n_links"]) for r in got], key=str) == sorted([(i, n) for (i, _), n in zip(rows, want)], key=str)


def test_likely_classes_come_once_per_group():
    """A group in which every pair is likely gives its classes, not its pairs."""
    import pandas as pd

    n = 600
    sketch = np.zeros(jaccard.SKETCH, np.uint16).tobytes()
    group = pd.DataFrame({"signature": [7] * n + [8] * 3, "class": [*range(n), n, n + 1, n + 2], "size": 100, "sketch": [sketch] * (n + 3)})
    group["root"] = group["class"]
    group.loc[group["signature"] == 8, "root"] = 5  # one component already
    out = pd.concat(list(jaccard._cross(85)(iter([group.iloc[:250], group.iloc[250:]]))))
    assert sorted(out["class"]) == list(range(n)) and set(out["signature"]) == {7}


@pytest.mark.parametrize("sizes", [(3, 4), (60, 64), (500, 530), (2_300, 2_400), (2_000, 2_100)])
def test_parities_bound_differences(sizes):
    rng = np.random.default_rng(sum(sizes))
    pool = rng.integers(0, 2**63, 3 * max(sizes)).astype(np.uint64)
    for shared in (0.0, 0.5, 0.9, 1.0):
        n = int(shared * min(sizes))
        a, b = np.unique(pool[: sizes[0]]), np.unique(pool[sizes[0] - n : sizes[0] - n + sizes[1]])
        odd = [jaccard.parities(x).tobytes() for x in (a, b)]
        (apart,) = jaccard.parities_apart(odd, np.array([0]), np.array([1]))
        differ = len(np.setxor1d(a, b))
        assert apart <= differ and apart % 2 == differ % 2 and (shared < 1 or apart >= differ // 2)


def test_large_sets_with_like_sketches_are_told_apart():
    """Sets of 3000 shingles of which half are common: the sketch of 128 cells leaves them a chance, the parities do not."""
    import pandas as pd

    rng = np.random.default_rng(8)
    common = rng.integers(0, 2**63, 1_500).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 1_500).astype(np.uint64)])) for _ in range(4)]
    sets.append(np.unique(np.concatenate([sets[0][:-100], rng.integers(0, 2**63, 100).astype(np.uint64)])))  # similar to the first
    group = pd.DataFrame({"signature": 1, "class": range(5), "root": range(5), "size": [len(s) for s in sets]})
    for name, measure, want in (("sketch", jaccard.sketch, {0, 1, 2, 3, 4}), ("odd", jaccard.parities, {0, 4})):
        rows = group.assign(**{name: [measure(s).tobytes() for s in sets]})
        assert set(pd.concat(list(jaccard._cross(80)(iter([rows]))))["class"]) == want


@pytest.mark.parametrize("seed", range(20))
def test_spanning_links_join_what_all_links_join(seed):
    import pandas as pd

    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = []
    for _ in range(40):
        kept = base[rng.random(60) < rng.choice([0.97, 0.9, 0.5])]
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 62, int(rng.integers(1, 5))).astype(np.uint64)])))
    root = np.arange(40)
    root[:6] = 0
    rows = pd.DataFrame({"class": np.arange(40), "root": root, "items": [s.tobytes() for s in sets], "team": 0, "lo": 0, "hi": 0})
    found = jaccard._spanning_in(rows, 85)
    links = [] if found is None else list(zip(found["a"], found["b"]))

    def joined(pairs):
        label = root.copy()
        for a, b in pairs:
            label[label == label[b]] = label[a]
        return len(set(label.tolist())), [label[i] == label[j] for i, j in combinations(range(40), 2)]

    alike = [(i, j) for i, j in combinations(range(40), 2) if 100 * np.intersect1d(sets[i], sets[j]).size >= 85 * np.union1d(sets[i], sets[j]).size]
    assert joined(links) == joined(alike) and len(links) == len(set(root.tolist())) - joined(links)[0]
    assert set(links) <= {p for a, b in alike for p in ((a, b), (b, a))}


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (51, 100), (7, 7)] + [(200, 200 + k) for k in range(1, 30)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50, 100: 50, **{200 + k: 200 for k in range(30)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def simhash(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    terms = [(words[0], "")] if len(words) == 1 else list(zip(words, words[1:]))
    votes = np.zeros(64, int)
    for a, b in terms:
        h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
        votes += [1 if h >> j & 1 else -1 for j in range(64)]
    return sum(1 << j for j in range(64) if votes[j] > 0)


def test_fingerprints_match_brute_force(spark, texts, odd, none):
    for table, rows in ((spark.createDataFrame(texts, "doc_id long, text string"), texts), (odd, None)):
        rows = rows or [(r["doc_id"], r["text"]) for r in odd.collect()]
        order = sorted([((i is not None, i or 0), t or "") for i, t in rows], reverse=True)
        want = []
        prints = [simhash(t) for _, t in order]
        for k, ((has, i), t) in enumerate(order):
            following = order[(k + 1) % len(order)][1]
            half = len(t) // 2
            edit = t[: len(t) - half] + following[:half]
            own, changed, nxt = prints[k], simhash(edit), prints[(k + 1) % len(order)]
            like = lambda a, b: 1 - bin(a ^ b).count("1") / 64
            near = sum(bin(own ^ p).count("1") <= 3 for p in prints) if has and i % 50 == 0 else None
            want.append((i if has else None, len(t), hashlib.sha256(edit.encode()).hexdigest(), f"{own:016x}", f"{changed:016x}", like(own, changed), like(own, nxt), near))
        got = fingerprints.fingerprint_documents(table, blocks=5).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert fingerprints.fingerprint_documents(none, blocks=3).count() == 0


def test_hamming_search_finds_all(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    prints = sorted({signed(b ^ sum(1 << int(j) for j in rng.choice(64, k, replace=False))) for b in base for k in range(6)})
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    far = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    for radius in (0, 2, 3, 4):
        want = {(a, b, far(a, b)) for a in prints for b in prints if far(a, b) <= radius}
        assert set(map(tuple, fingerprints.near(df, df, radius).collect())) == want


def test_cuckoo_filter_grows_and_forgets():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5_000)]
    index = exact.CuckooIndex(buckets=4)
    for i, k in enumerate(keys):
        index.add(k, i, i)
        index.add(k, i, i - 1)
    assert index.live == 5_000 and index.buckets * exact.SLOTS >= 5_000
    assert all(index.find(k, i)[2:] == [i, 2] for i, k in enumerate(keys))
    assert index.find(keys[0], 1) is None
    for i, k in enumerate(keys[:2_500]):
        assert index.delete(k, i) and index.find(k, i) and index.delete(k, i) and not index.delete(k, i)
    assert index.live == 2_500 and all(index.find(k, i) is None for i, k in enumerate(keys[:2_500]))
    assert all(index.find(k, i + 2_500) for i, k in enumerate(keys[2_500:]))


def test_exact_copies_of_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, top[t], len(groups[t]), i == top[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]
    assert sorted(map(tuple, exact.duplicates(odd).collect()), key=str) == sorted(want, key=str)
    kept = exact.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(top.values())
    assert exact.duplicates(none).count() == 0 and exact.keep_one(none).count() == 0
    nameless = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert [tuple(r)[1:4] for r in exact.duplicates(nameless).collect()] == [(None, 2, True)] * 2 and exact.keep_one(nameless).count() == 1


def test_index_takes_deletions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "doc_id long, text string")
    gone = spark.createDataFrame([("a",), ("b",), ("never",)], "text string")
    left = exact.delete_from_index(exact.build_index(df), gone).collect()
    assert sorted((r["n_bytes"], r["group_size"]) for r in left) == [(0, 1), (1, 1)]


def test_sets_and_signatures_of_many_texts_at_once():
    """As one by one, empty and short texts among them, in a part of the calls."""
    import random
    import time

    from cutledger.llm import jaccard
    from cutledger.llm.numeric import shingle_sets

    rnd = random.Random(5)
    word = lambda: rnd.choice(["Ab", "ab", "c", "éß", "xyz", "\ud800"]) + str(rnd.randint(0, 99))
    texts = [rnd.choice([" ", "\n", "\t "]).join(word() for _ in range(rnd.choice([0, 1, 2, 4, 5, 6, 60, 300]))) for _ in range(3_000)]
    texts += [None, "", " ", " a b c d e f ", "a " * 40_000, " ".join(map(str, range(60_000)))]
    rnd.shuffle(texts)
    began = time.process_time()
    single = [shingle_set(t, 4) for t in texts]
    apart = time.process_time() - began
    began = time.process_time()
    together = shingle_sets(texts, 4)
    assert time.process_time() - began < 0.7 * apart
    assert len(together) == len(single) and all(np.array_equal(a, b) for a, b in zip(together, single))
    sets = [s for s in together if len(s)]
    signed = list(jaccard.signatures_of(sets, 80))
    assert len(signed) == len(sets) and all(np.array_equal(a, jaccard.signatures(s, 80)) for a, s in zip(signed, sets))
