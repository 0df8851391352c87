"""License scan: notice phrases and identifier tags by Aho-Corasick, licence expressions by a shunting-yard parser.

One automaton runs over the words of a text (joined by single blanks, so that a phrase matches whole words only), a second one over the
raw lower-cased text of those documents whose words hold a tag, to find where the expression begins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.llm.common import ready

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases and their labels.
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "boost",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "unlicense": "unlicense",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "cc0 1 0 universal": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}
# Tags that begin a licence expression. A plain "license:" counts only if its expression has known identifiers alone.
TAGS = {"spdx-license-identifier:": True, "license:": False, "licence:": False}
TAG_WORDS = ("spdx license identifier", "license", "licence")
# Identifier prefixes, label and strength (0 permissive, 1 weak, 2 strong copyleft); the longest prefix counts.
KNOWN = {
    "mit": ("mit", 0), "apache": ("apache", 0), "bsd": ("bsd", 0), "0bsd": ("bsd", 0), "isc": ("isc", 0), "zlib": ("zlib", 0), "bsl-1.0": ("boost", 0),
    "unlicense": ("unlicense", 0), "cc0": ("cc0", 0), "cc-by": ("cc-by", 0), "cc-by-sa": ("cc-by-sa", 2), "cc-by-nc": ("cc-by-nc", 2),
    "mpl": ("mpl", 1), "epl": ("epl", 1), "lgpl": ("lgpl", 1), "gpl": ("gpl", 2), "agpl": ("agpl", 2),
}
CLASSES = ("permissive", "weak", "strong", "unknown")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+:-]*")
#: A-Z lower, every other ASCII byte that is no word byte a blank; bytes of other characters stay.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def identifier(word: str) -> tuple[str, int] | None:
    """(label, strength) of an identifier such as gpl-2.0-or-later, or None."""
    word = word.rstrip("+")
    best = max((k for k in KNOWN if word == k or word.startswith(k + "-")), key=len, default=None)
    return KNOWN[best] if best else None


def to_postfix(tokens: Iterable[str]) -> list[str] | None:
    """Shunting-yard: operators by precedence (with, and, or), parentheses; None if the expression is malformed."""
    out, waiting, want = [], [], True
    for t in tokens:
        if t == "(":
            if not want:
                return None
            waiting.append(t)
        elif t == ")":
            if want:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif t in PRECEDENCE:
            if want:
                return None
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[t]:
                out.append(waiting.pop())
            waiting.append(t)
            want = True
        else:
            if not want:
                return None
            out.append(t)
            want = False
    if want or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(expression: str) -> tuple[set[str], int, bool] | None:
    """(labels, strength, all known) of a licence expression; None if malformed.

    `or` leaves the milder choice, `and` binds to the stricter part, `with` names an exception, which eases its licence by one step.
    """
    return evaluate_tokens(TOKEN.findall(expression.lower()))


def evaluate_tokens(tokens: Iterable[str]) -> tuple[set[str], int, bool] | None:
    """As evaluate, from the tokens, which are taken no further than the first that does not fit."""
    post = to_postfix(tokens)
    if post is None:
        return None
    stack: list[tuple[set[str], int, bool]] = []
    for t in post:
        if t not in PRECEDENCE:
            found = identifier(t)
            stack.append(({found[0]}, found[1], True) if found else (set(), 3, False))
            continue
        right, left = stack.pop(), stack.pop()
        if t == "with":
            stack.append((left[0], max(left[1] - 1, 0) if left[1] < 3 else 3, left[2]))
        else:
            stack.append((left[0] | right[0], (min if t == "or" else max)(left[1], right[1]), left[2] and right[2]))
    return stack[0]


@lru_cache(1)
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    words, raw = ahocorasick.Automaton(), ahocorasick.Automaton()
    known = {p: (0, label) for p, label in BASE.items()} | {p: (1, label) for p, label in NOTICES.items()}
    known |= {p: (2, "") for p in TAG_WORDS if p not in known}
    for p, (kind, label) in known.items():
        words.add_word(f" {p} ", (kind, label, len(p) + 1))
    for tag, sure in TAGS.items():
        raw.add_word(tag, sure)
    words.make_automaton()
    raw.make_automaton()
    return words, raw


#: What ends an expression, and what is stripped from it.
ENDS, STRIPPED = ("\n", "*/", "-->"), " \t\r.;,\"'"


def _ends(low: str) -> Callable[[int], int]:
    """Where the expression that begins at a place ends; asked for ascending places, each stretch of the text is searched once."""
    found, stop, last = dict.fromkeys(ENDS, -1), -1, -1

    def end_of(at: int) -> int:
        nonlocal stop, last
        if at > stop:
            for mark in ENDS:
                if found[mark] < at:
                    k = low.find(mark, at)
                    found[mark] = k if k >= 0 else len(low)
            stop = last = min(found.values())
            while last > at and low[last - 1] in STRIPPED:
                last -= 1
        return max(last, at)

    return end_of


def _known_only(tokens: Iterator[str]) -> Iterator[str]:
    """The tokens; an unknown identifier before any exception makes them malformed and ends them."""
    for t in tokens:
        yield t
        if t == "with":
            yield from tokens
        elif t not in PRECEDENCE and t not in "()" and identifier(t) is None:
            yield from "()"
            return


def expressions(text: bytes) -> Iterator[tuple[str, tuple[set[str], int, bool]]]:
    """Valid licence expressions behind the tags of a text, to the end of the line (a comment's end mark is no part of it), however long.

    An expression is read no further than its first misplaced token, and behind a plain tag than its first unknown identifier before an exception.
    """
    low = text.translate(LOWER).decode("latin-1")
    end_of = _ends(low)
    for end, sure in automata()[1].iter(low):
        stop = end_of(end + 1)
        tokens = (m.group() for m in TOKEN.finditer(low, end + 1, stop))
        got = evaluate_tokens(tokens if sure else _known_only(tokens))
        if got is not None and (sure or got[2]):
            yield low[end + 1 : stop].strip(STRIPPED), got


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, n_notices, n_expressions, expression, expression_class."""
    raw = (text or "").encode()
    words = raw.translate(WORDS).split()
    line = b" ".join([b"", *words, b""]).decode("latin-1")
    n_base = n_notices = 0
    lo = hi = None
    base, labels, tagged = set(), set(), False
    for end, (kind, label, back) in automata()[0].iter(line):
        if kind == 2:
            tagged = True
            continue
        labels.add(label)
        if kind == 1:
            n_notices += 1
            continue
        start = end - back
        n_base += 1
        base.add(label)
        lo = start if lo is None else min(lo, start)
        hi = start if hi is None else max(hi, start)
    first = None if lo is None else line.count(" ", 0, lo)
    last = None if hi is None else line.count(" ", 0, hi)
    found = list(expressions(raw)) if tagged else []
    for _, got in found:
        labels |= got[0]
    score = 1 - 0.5 ** (n_base + n_notices + 2 * len(found))
    text_of_first, strength = (found[0][0], CLASSES[max(g[1] for _, g in found)]) if found else (None, None)
    return (len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, n_notices, len(found), text_of_first, strength)


FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
    ("labels", pa.string()), ("score", pa.float64()), ("n_notices", pa.int64()), ("n_expressions", pa.int64()), ("expression", pa.string()),
    ("expression_class", pa.string()),
]
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "n_notices long, n_expressions long, expression string, expression_class string"
)


def _scan_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = [scan(t.as_py()) for t in batch.column(1)]
            cols = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), FIELDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *(n for n, _ in FIELDS)])


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with the columns of SCHEMA; no shuffle. Null texts count as empty, repeated rows come out repeated.

    score is 1 - 0.5 to the number of places found (an expression counts twice). Other columns are ignored.
    """
    ready(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scan_batches, SCHEMA)
