"""License scan, language identification, token files, quality."""

import re
import zlib

import numpy as np
import pytest

from cutledger.llm import language, licenses, quality, tokens

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_scan(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_license_scan_matches_brute_force(docs, odd, none):
    for table in (docs, odd):
        want = sorted([(r["doc_id"], *base_scan(r["text"])) for r in table.collect()], key=str)
        got = licenses.scan_licenses(table).collect()
        assert sorted([tuple(r)[:6] for r in got], key=str) == want
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert licenses.scan_licenses(none).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("MIT", ({"mit"}, 0, True)),
        ("MIT OR GPL-3.0-only", ({"mit", "gpl"}, 0, True)),
        ("MIT AND GPL-3.0-only", ({"mit", "gpl"}, 2, True)),
        ("MIT OR GPL-2.0+ AND LGPL-2.1", ({"mit", "gpl", "lgpl"}, 0, True)),
        ("(MIT OR GPL-2.0) AND LGPL-2.1", ({"mit", "gpl", "lgpl"}, 1, True)),
        ("GPL-2.0-only WITH Classpath-exception-2.0", ({"gpl"}, 1, True)),
        ("MIT OR Strange-1", ({"mit"}, 0, False)),
        ("MIT OR", None), ("(MIT", None), ("MIT)", None), ("", None), ("MIT GPL", None), ("AND MIT", None), ("()", None),
    ],
)
def test_expressions(text, want):
    assert licenses.evaluate(text) == want


def test_tags_and_notices():
    row = dict(zip([n for n, _ in licenses.FIELDS], licenses.scan("// SPDX-License-Identifier: (MIT OR Apache-2.0)\nGNU Lesser General Public License text")))
    assert row["labels"] == "apache,gpl,lgpl,mit"
    assert row["n_expressions"] == 1 and row["expression_class"] == "permissive" and row["base_labels"] == "gpl"
    assert licenses.scan("license: yours")[8] == 0 and licenses.scan("license: MIT")[8] == 1


def test_long_expressions_are_read_to_their_end():
    names = [n for n, _ in licenses.FIELDS]
    for tag in ("SPDX-License-Identifier:", "license:"):
        line = "(" + " OR ".join(["MIT"] * 2_000) + ") AND GPL-3.0-only"
        row = dict(zip(names, licenses.scan(f"/* {tag} {line}. */ x\nlicense: BSD-3-Clause")))
        assert row["n_expressions"] == 2 and row["labels"] == "bsd,gpl,mit" and row["expression_class"] == "strong" and row["expression"] == line.lower()
    many = licenses.scan("license: MIT, " * 50_000)
    assert many[8] == 1  # only the last one is not followed by another word


def test_expressions_match_splitting():
    def split(text):
        low = text.translate(licenses.LOWER).decode("latin-1")
        for end, sure in licenses.automata()[1].iter(low):
            line = low[end + 1 :].split("\n", 1)[0].split("*/", 1)[0].split("-->", 1)[0].strip(" \t\r.;,\"'")
            got = licenses.evaluate(line)
            if got is not None and (sure or got[2]):
                yield line, got

    rng = np.random.default_rng(4)
    pieces = ["license:", "SPDX-License-Identifier:", "MIT", "GPL-2.0", "odd", "and", "or", "with", "(", ")", "\n", "*/", "-->", ".", ";", " ", "\r"]
    assert list(licenses.expressions(b"license: MIT with (odd or other)")) == list(split(b"license: MIT with (odd or other)")) != []
    for _ in range(4_000):
        text = " ".join(rng.choice(pieces, int(rng.integers(1, 16)))).replace(" . ", ". ").encode()
        assert list(licenses.expressions(text)) == list(split(text))


def walk(model, lang, data):
    """Code length of bytes in one language, by walking the context tree."""
    at = model.langs.index(lang)
    tree = {}
    for depth, g, gram, n in zip(model.depth, model.lang, model.gram, model.n):
        if g == at:
            tree.setdefault((int(depth), int(gram) >> 8), {})[int(gram) & 255] = int(n)
    # contexts cut from the deepest level are those that are rare over all languages
    deep = {}
    for depth, gram, n in zip(model.depth, model.gram, model.n):
        if depth == language.DEPTH:
            deep[int(gram) >> 8] = deep.get(int(gram) >> 8, 0) + int(n)
    bits, padded = 0.0, b" " * language.DEPTH + data
    for i in range(language.DEPTH, len(padded)):
        total = 8.0
        known = []
        for depth in range(language.DEPTH + 1):
            context = sum(padded[i - k] << (8 * (k - 1)) for k in range(1, depth + 1))
            if depth == language.DEPTH and deep.get(context, 0) < language.MIN_CONTEXT:
                break
            known.append(tree.get((depth, context)))
        for seen in known:
            if seen:
                n, d = sum(seen.values()), len(seen)
                total = -np.log2(seen[padded[i]] / (n + d)) if padded[i] in seen else -np.log2(d / (n + d)) + total
        bits += total
    return bits


def test_code_lengths_match_a_walk_of_the_tree(spark):
    train = [("en", "the cat sat on the mat with the hat. the cat that sat"), ("de", "die katze und der hund und die maus sind da"), ("en", "that thing there")]
    df = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(train * 4)], "doc_id long, text string, lang string")
    model = language.train(df)
    texts = ["the dog", "der hund ist da", "Zürich QQQ", "x"]
    got = language.code_lengths(model, texts) / language.UNIT
    for i, t in enumerate(texts):
        data = t.encode().translate(language.LOWER)
        for j, lang in enumerate(model.langs):
            assert abs(got[i, j] - walk(model, lang, data)) < 0.002 * len(data) + 0.01


def test_every_language_is_learned(spark):
    rows = [(i, f"text {i % 1_050}", f"lang{i % 1_050}") for i in range(2_000)]
    assert len(language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs) == 1_050


def test_language_on_held_out_rows(spark, odd, none):
    from cutledger.llm.common import documents

    docs = documents(spark, "/root/testdata/sf0.01")
    got = language.identify(docs, language.train(docs.filter(language.in_training()))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert len(held) > 100 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    model = language.train(docs)
    rows = language.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3, 11)) and 0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in language.keep_identified(odd, model).collect()} == {4, 5, None, 7, 8, 10, 12}
    assert language.keep_identified(odd, model).columns == odd.columns
    assert language.identify(none, model).count() == 0
    blank = language.train(none)
    assert {r["lang_pred"] for r in language.identify(odd, blank).collect()} == {"und"}


PATH = __import__("public_tokenizers").path("byte_bpe_50k.json")


def test_pieces_encode_like_whole_texts(texts):
    own = tokens.PieceEncoder(PATH)
    odd = ["", "a", " a", "a ", "  ", "a  b", "a \n b", "a\n\nb c", " x y z", "<|endoftext|> a <|endoftext|>", "it's we'll 's", "\x1c a b\x1d c", "a  b", "é  日本 語"]
    for t in odd + [t for _, t in texts]:
        assert own.encode(t).tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["empty", "one", "random", "constant", "cycle", "block", "blocks"])
def test_file_round_trip(kind):
    rng = np.random.default_rng(1)
    ids = {
        "empty": np.zeros(0), "one": np.array([50256]), "random": rng.integers(0, 50257, 9_000), "constant": np.full(9_000, 7), "cycle": np.arange(9_000) % 13,
        "block": rng.zipf(1.3, tokens.BLOCK) % 50_000, "blocks": rng.zipf(1.2, 5 * tokens.BLOCK) % 50_000,
    }[kind].astype(np.uint32)
    sizes = [len(ids) // 3, len(ids) - len(ids) // 3]
    data = tokens.write_file([5, None], sizes, ids)
    doc_ids, got_sizes, got = tokens.read_file(data)
    assert doc_ids == [5, None] and got_sizes.tolist() == sizes and got.tolist() == ids.tolist()
    if kind == "constant":
        assert len(data) < 1_000
    if len(ids) > 1:
        broken = bytearray(data)
        broken[-9] ^= 255
        with pytest.raises(tokens.DamagedBlock):
            tokens.read_file(bytes(broken))


def test_new_pieces_are_encoded_in_a_row():
    """One call for the new pieces of a text, and none for pieces that are known; the ids are those of the whole text."""
    own, sizes = tokens.PieceEncoder(PATH), []
    whole = own.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **how):
            sizes.append(len(texts))
            return whole.encode_batch_fast(texts, **how)

    own.tokenizer = Counted()
    plain = "Some words, and more\nwords \u0120 of_this.kind \u00e9t\u00e9 \u4e2d\u6587 don't 12345 and words, " + "x" * 50
    odd = [" a b", "a  b\n c \n", "\n\ta b c\n", "a \u00a0b \u2003 c", "a\n b", "a b\n\n", " ", "\n", "a", "b \u0120\u0120 \u0120x", "A   b    c d"]
    for text in [plain, plain, *odd, *odd, " ".join(odd)]:
        assert own.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
        if text == plain:
            assert sizes in ([1, 1], [1])  # the first piece, and all new ones in a row
        sizes.clear()


def test_token_table(docs, odd, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    for table in (docs, odd):
        rows = sorted([(r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "", r["doc_id"]) for r in table.collect()])
        start, want = 0, []
        for _, _, text, doc_id in rows:
            ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
            want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(map(tuple, tokens.token_table(table, PATH).collect()), key=str) == sorted(want, key=str)
    assert tokens.token_table(none, PATH).count() == 0


def test_quality_by_co_training(spark, odd, none):
    from cutledger.llm.common import documents

    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels, labelled=1_500, pool=2_000)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert len(got) == docs.count()
    truth = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["doc_id"] in got]
    assert np.mean([got[i]["kept"] == bool(q) for i, q in truth]) > 0.96
    assert quality.score(odd, model).count() == odd.count() and quality.score(none, model).count() == 0
    flat = quality.train(docs, labels.filter("quality = 1"))
    assert not flat.known and quality.train(none, labels).known is False
    assert {r["score"] for r in quality.score(odd, quality.train(docs, labels.limit(0))).collect()} == {0.5}


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    n, pool = 40, 400
    y = rng.integers(0, 2, n).astype(float)
    hidden = rng.integers(0, 2, pool)
    draw = lambda label, cells: np.unique(np.append(rng.integers(0, 50, 6), 100 + label * 10 + rng.integers(0, cells, 3))).astype(np.int32)
    own = lambda labels: ([draw(int(v), 10) for v in labels], [draw(int(v), 3) for v in labels])
    words, meta = own(y)
    pool_words, pool_meta = own(hidden)
    model = quality.co_train(words, meta, y, pool_words, pool_meta, np.arange(n) % 4 == 0)
    assert np.mean((model.scores(pool_words, pool_meta)[2] > 0.5) == hidden) > 0.95
