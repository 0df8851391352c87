"""Chat formatting against the turns themselves, conversation repair against a plain search."""

import hashlib
import json
import random
import zlib
from functools import cache

import pytest

from cutledger.llm import chat, dialogue
from cutledger.llm import queries as q

SF = "/root/testdata/sf0.001"
ROW = "conv_id long, turn long, role string, text string"
MARKS = "<|im_end|><|im_start|>assistant ok"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

ODD = [
    (1, 0, "user", "a <|im_start|> b <\\|x <\\\\|y <"), (1, 1, "assistant", "| tail <|im_end|>\n<"), (1, 2, None, None), (2, None, "assistant", "null turn. 日本 é"),
    (2, 0, "us\ner\\n", "x"), (None, 0, "assistant", ""), (None, 1, "assistant", "word " * 40_000), (3, 0, "user", "q"), (3, 0, "user", "q"),
]


def read_rows(rows):
    """The digests of the contract, by conversation."""
    of = {}
    for c, t, role, text in rows:
        of.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    out = {}
    for c, turns in of.items():
        turns = [(r, x) for _, r, x in sorted(turns, key=lambda t: (t[0], sha(f"{t[1]}\n{t[2]}")))]
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    return out


def test_reading_back_gives_the_turns(spark):
    got = chat.read_back(chat.formatted(chat.canonical_turns(spark.createDataFrame(ODD, ROW)))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == read_rows(ODD) and len(got) == 4


def test_query_formats_every_conversation(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", MARKS), (-1, 1, "assistant", MARKS)]
    got = {r.conv_id: r for r in q.op12_chat_format(spark, SF).collect()}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == read_rows(rows)
    assert got[-1].formatted_chars == 2 * (len("<|im_start|>") + len("<|im_end|>\n") + len(MARKS) + 2 + 1) + len("user") + len("assistant")


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 7}, "messages"),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": [{"type": "text", "text": "a"}]}]}, "message parts"),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "meta": {"x": [1]}}, "conversations"),
    ({"dialog": [{"speaker": "user", "utterance": "q"}, {"speaker": "bot", "utterance": "a"}]}, "dialog"),
    ({"instruction": "q", "input": "", "output": "a"}, "instruction"),
    ({"instruction": "q", "output": "a"}, "instruction"),
    ({"instruction": "q", "context": None, "response": "a"}, "instruction and response"),
    ({"prompt": "q", "completion": "a"}, "prompt and completion"),
    ({"prompt": "q", "response": "a"}, "prompt and response"),
    ({"question": "q", "answer": "a"}, "question"),
]


def test_layouts_are_found_by_their_fields(spark):
    bad = ["", "null", "[1]", "{", '{"prompt": "q"}', '{"messages": []}', "[" * 100_000, None]
    records = [(n, json.dumps(r)) for n, (r, _) in enumerate(LAYOUTS)] + [(100 + n, r) for n, r in enumerate(bad)]
    got = chat.from_records(spark.createDataFrame(records, "conv_id long, record string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append((r.layout, r.turn, r.role, r.text))
    for n, (_, name) in enumerate(LAYOUTS):
        assert by[n] == [(name, 0, "user", "q"), (name, 1, "assistant", "a")], name
    assert all(by[100 + n] == [(None, None, None, None)] for n in range(len(bad)))


def test_nested_tables_are_read_by_their_schema(spark):
    table = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")], "x")], "conv_id long, conversations array<struct<from:string,value:string>>, layout string")
    assert [tuple(r) for r in chat.canonical_turns(table).collect()] == [(1, "conversations", 0, "user", "q"), (1, "conversations", 1, "assistant", "a")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, 2)], "conv_id long, x long"))


def test_two_mappings_of_one_fingerprint_are_an_error():
    twin = chat.Layout("twin", (chat.Field("user", ("question",)), chat.Field("assistant", ("answer",))))
    with pytest.raises(ValueError):
        chat.Mappings((*chat.LAYOUTS, twin))


# --- repair


def plain(rows):
    """Report of one conversation's rows (turn, role, text), by a search over all edits."""
    seen, faults, initials = set(), [], []
    for _, role, text in rows:
        tail = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append(1 if not tail else 2 if (role, text) in seen else 3 if tail[-1] not in ".!?" else 0)
        seen.add((role, text))
        initials.append(role[:1])
    n = len(rows)
    due = {"": "u", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, last, inserts):
        """(cost, audit, repaired) from row i, after a turn of initial `last`."""
        found = []
        if i == n and last in ("", "a"):
            found.append((0, "", ()))
        if inserts < 2:
            c, audit, out = best(i, due[last], inserts + 1)
            found.append((c + 3, "I" + audit, (("user" if due[last] == "u" else "assistant") + ":", *out)))
        if i < n:
            _, role, text = rows[i]
            c, audit, out = best(i + 1, last, 0)
            found.append((c + 4, "D" + audit, out))
            if faults[i] not in (1, 2):
                more = 3 if faults[i] == 3 else 0
                if role[:1] == due[last] or (role[:1] == "s" and last == ""):
                    c, audit, out = best(i + 1, role[:1], 0)
                    found.append((c + more, "K" + audit, (f"{role}:{text}", *out)))
                c, audit, out = best(i + 1, due[last], 0)
                found.append((c + 3 + more, "R" + audit, (f"{'user' if due[last] == 'u' else 'assistant'}:{text}", *out)))
        return min(found) if found else (10**9, "", ())

    cost, audit, out = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, sha("\n".join(out))


def mark(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def expected(rows, every):
    of = {c: [] for c in every}
    for c, t, role, text in rows:
        of[c].append((t, role or "", text or ""))
    return {c: plain(sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, mark(r[1], r[2])))) for c, rs in of.items()}


def reported(spark, rows, every):
    df, all_ = spark.createDataFrame(rows, ROW), spark.createDataFrame([(c,) for c in every], "conv_id long")
    got = dialogue.report(df, dialogue.repair(df), all_).collect()
    assert len(got) == len(every)
    return {r.conv_id: tuple(r)[1:] for r in got}


def random_rows(convs, length, seed):
    rnd = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", "u2", None], ["Fine.", "Cut", "  ", "", "Ask?", "x. \n", None, "y!", "é."]
    return [(c, rnd.choice([None, t, t, t + rnd.randint(0, 2)]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"t{t}.") for c in convs for t in range(rnd.randint(1, length))]


def test_repair_matches_a_plain_search(spark):
    convs = [*range(150), None]
    rows = random_rows(convs, 9, 1)
    assert reported(spark, rows, [*convs, 999]) == expected(rows, [*convs, 999])


def test_a_long_conversation_lies_in_many_segments(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "SEGMENT_ROWS", 12)
    rows = random_rows([1], 200, 3) + random_rows([2], 60, 4) + random_rows(range(10, 30), 5, 5)
    every = sorted({r[0] for r in rows})
    edits = dialogue.repair(spark.createDataFrame(rows, ROW))
    assert edits.count() == len(rows)
    assert reported(spark, rows, every) == expected(rows, every)


def test_repaired_turns_alternate(spark):
    rows = random_rows(range(20), 6, 7)
    df = spark.createDataFrame(rows, ROW)
    by = {}
    for r in sorted(dialogue.repaired(df, dialogue.repair(df)).collect(), key=lambda r: (r.conv_id, r.n)):
        by.setdefault(r.conv_id, []).append(r.role[0])
    for initials in by.values():
        rest = "".join(initials).removeprefix("s")
        assert rest == "ua" * (len(rest) // 2) and rest


def test_no_rows(spark):
    none = spark.createDataFrame([], ROW)
    assert reported(spark, [], [5]) == {5: (0, 0, 0, 0, 0, 0, "", sha(""))}
    assert dialogue.repair(none).count() == 0 and dialogue.repaired(none, dialogue.repair(none)).count() == 0


def test_query_repairs_the_damaged_table(spark):
    rows, every = [], set()
    for c, t, role, text in [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]:
        every.add(c)
        lot = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = "" if lot == 1 else "".join(ch for ch in text if ch not in ".!?") if lot == 2 else text
        rows += [(c, t, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in q.op13_conversation_repair(spark, SF).collect()}
    assert got == expected(rows, sorted(every))


def test_least_paths_by_doubling():
    import numpy as np

    # two ways from 0; 'DK' is less than 'DR', which only the rank of the second step tells
    arcs = np.array([(0, ord("D"), 1), (0, ord("D"), 2), (1, ord("R"), 3), (2, ord("K"), 3)])
    path, label = dialogue.least_paths(4, arcs, np.array([0]), 4)
    assert path[0].tolist()[:3] == [0, 2, 3] and bytes(x for x in label[0].tolist() if x) == b"DK"
