"""Repair of conversations: the cheapest edits that make turns alternate, least in order of their initials.

A conversation's rows are read by a small automaton (nothing yet, after system, after user, after assistant). The costs to the end are a
dynamic program over rows and states, backwards. Arcs that keep the cost optimal form a graph; every node has at most one arc per initial.
Prefix doubling ranks the nodes by the edits that follow them: ranks by 1, 2, 4 ... initials, each from two ranks of half the length, with
pointers doubled alongside. The ranks pick each node's arc and the doubled pointers lay out the least path.

Rows are range-sorted by (conversation, turn), so that a long conversation lies over several tasks as segments. Segments hand on their cost
as a min-plus matrix over the four states, are solved from every state they may start in, and are then chained, thin rows only. Texts are
shuffled once, at the end, where they meet their edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutledger.llm.common import arrow_schema, in_order, ready, stored

#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
ROLE = {"u": "user", "a": "assistant"}
#: Faults of a row, the first that holds.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States, and the one that a next turn of the due role leads to.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)
NEVER = 1 << 60
SPACES = " \t\n\x0b\x0c\r"
#: Rows a sorted partition holds.
SEGMENT_ROWS = 20_000


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with damage by crc32(`conv_id:turn`) mod 20: 0 drops, 1 empties, 2 removes [.!?], 3 repeats, 4 makes it the
    user's. Null roles and texts are one space, in the key null numbers too."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    rows = rows.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), lot.alias("lot")).filter("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("lot") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _mark() -> Column:
    """What tells a role and text apart: SHA-256 of both."""
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _step(state: int, initial: str) -> int | None:
    """State after a kept turn, None if it may not stand here."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


STEP = {i: tuple(_step(s, i) for s in range(4)) for i in "sua"}
NO_STEP = (None,) * 4


def _with_inserts(v: list[int]) -> list[int]:
    """Costs at a row once turns may be inserted before it."""
    u, a = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return [min(v[NOTHING], INSERT + u), min(v[SYSTEM], INSERT + u), u, a]


END = _with_inserts([0, NEVER, NEVER, 0])


def _costs(initials: list[str], faults: list[int], end: list[int]) -> list[list[int]]:
    """Cost to the end from (row, state), rows and end; `end` is that behind the last row."""
    costs = [end]
    for initial, fault in zip(reversed(initials), reversed(faults)):
        after = costs[-1]
        here = [DELETE + c for c in after]
        if fault not in (BLANK, DUPLICATE):
            extra, keep = CUT_OFF if fault == TRUNCATED else 0, STEP.get(initial, NO_STEP)
            for s in range(4):
                here[s] = min(here[s], REROLE + extra + after[DUE[s]])
                if keep[s] is not None:
                    here[s] = min(here[s], extra + after[keep[s]])
        costs.append(_with_inserts(here))
    costs.reverse()
    return costs


def _arcs(initials: list[str], faults: list[int], costs: list[list[int]], last: bool, base: int) -> Iterator[tuple[int, int, int]]:
    """Optimal arcs (node, initial, node) of a segment whose nodes begin at `base`; initials as bytes."""
    n = len(initials)
    for i in range(n + 1):
        here = costs[i]
        for s in range(4):
            node, want = base + 4 * i + s, here[s]
            if (i < n or last) and not (i == n and s in (NOTHING, ASSISTANT)) and INSERT + here[DUE[s]] == want:
                yield node, ord("I"), base + 4 * i + DUE[s]
            if i == n:
                continue
            after, below = costs[i + 1], base + 4 * (i + 1)
            if DELETE + after[s] == want:
                yield node, ord("D"), below + s
            if faults[i] not in (BLANK, DUPLICATE):
                extra, keep = CUT_OFF if faults[i] == TRUNCATED else 0, STEP.get(initials[i], NO_STEP)[s]
                if keep is not None and extra + after[keep] == want:
                    yield node, ord("K"), below + keep
                if REROLE + extra + after[DUE[s]] == want:
                    yield node, ord("R"), below + DUE[s]


def least_paths(n_nodes: int, arcs: np.ndarray, starts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, initials) along the least path from each start, one row per start; behind its end a path stays there with initial 0.

    `arcs` has columns node, initial, next node. Prefix doubling: rank by one initial, then by 2, 4, ... while pointers double; equal ranks
    mean equal edits so far, and an end ranks before any edit.
    """

    def first_arcs(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((rank[arcs[:, 2]], arcs[:, 1], arcs[:, 0]))
        node = arcs[order, 0]
        pick = order[np.concatenate([[True], node[1:] != node[:-1]])] if len(order) else order
        label, ahead = np.zeros(n_nodes, np.int64), np.arange(n_nodes)
        label[arcs[pick, 0]], ahead[arcs[pick, 0]] = arcs[pick, 1], arcs[pick, 2]
        return label, ahead

    label, ahead = first_arcs(np.zeros(n_nodes, np.int64))
    rank, to, reach = label, ahead, 1
    while reach < longest:
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[to], return_inverse=True)[1].astype(np.int64)
        to, reach = to[to], 2 * reach
    label, ahead = first_arcs(rank)
    doubled = [ahead]
    while 1 << len(doubled) < longest:
        doubled.append(doubled[-1][doubled[-1]])
    path = starts[:, None]
    for jump in reversed(doubled):
        path = np.stack([path, jump[path]], axis=2).reshape(len(starts), -1)
    return path, label[path]


SEGMENT = "conv_id long, seg long, last boolean, ends array<long>, starts array<int>, rows array<struct<pos:long,turn:long,mark:binary,initial:string,fault:int>>"
EDITS = "array<struct<pos:long,turn:long,mark:binary,initial:string,fault:int,before:string,act:string,after:string>>"
SOLVED = f"conv_id long, seg long, start int, stop int, edits {EDITS}"


def _solve_many(segments: list[dict], longest: int) -> Iterator[tuple]:
    """Edits of segments from each of their starting states; a path has fewer than `longest` edits."""
    arcs, starts, owners, base = [], [], [], 0
    for k, seg in enumerate(segments):
        initials, faults = [r["initial"] for r in seg["rows"]], [r["fault"] for r in seg["rows"]]
        last = seg["last"]
        costs = _costs(initials, faults, END if last else seg["ends"])
        arcs += _arcs(initials, faults, costs, last, base)
        for s in seg["starts"]:
            starts.append(base + s)
            owners.append((k, base))
        base += 4 * (len(initials) + 1)
    paths, labels = least_paths(base, np.array(arcs, np.int64).reshape(-1, 3), np.array(starts, np.int64), longest)
    for (k, begin), path, label in zip(owners, paths.tolist(), labels.tolist()):
        seg = segments[k]
        rows, edits, waiting = seg["rows"], [], ""
        for node, mark in zip(path, label):
            if not mark:
                break
            i, state = divmod(node - begin, 4)
            due = "a" if state == USER else "u"
            if mark == 73:  # I
                waiting += due
            else:
                edits.append({**rows[i], "before": waiting, "act": due if mark == 82 else chr(mark), "after": ""})
                waiting = ""
        if waiting:
            edits[-1]["after"] = waiting
        yield seg["conv_id"], seg["seg"], (path[0] - begin) % 4, (node - begin) % 4, edits


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _solver(schema: pa.Schema) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_size: dict[int, list[dict]] = {}
            for seg in batch.to_pylist():
                by_size.setdefault((3 * len(seg["rows"]) + 4).bit_length(), []).append(seg)
            for size, some in by_size.items():
                each = max(1, (1 << 18) >> size)
                for at in range(0, len(some), each):
                    yield _arrow(list(_solve_many(some[at : at + each], 1 << size)), schema)

    return run


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment the cost from each state at its first row to each state behind its last, row by row."""
    for batch in batches:
        made = []
        for seg in batch.to_pylist():
            initials, faults = [r["initial"] for r in seg["rows"]], [r["fault"] for r in seg["rows"]]
            columns = [_costs(initials, faults, [0 if s == e else NEVER for s in range(4)])[0] for e in range(4)]
            made.append((seg["conv_id"], seg["seg"], [columns[e][s] for s in range(4) for e in range(4)]))
        if made:
            keys = [pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*made))]
            yield pa.RecordBatch.from_arrays(keys, ["conv_id", "seg", "cost"])


def _carry_back(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Costs behind each segment of a conversation, from its last to its first."""
    end = END
    for seg, cost in rows:
        yield seg, end
        end = _with_inserts([min(cost[4 * s + e] + end[e] for e in range(4)) for s in range(4)])


def _chain(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The state in which each segment of a conversation starts."""
    state, now = NOTHING, None
    for seg, start, stop in rows:
        if seg != now:
            now, here = seg, state
        if start == here:
            state = stop
            yield seg, start


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every row (conv_id, turn, role, text): conv_id, pos, turn, mark, initial, fault, before, act, after.

    Rows are taken by turn (nulls first; equal turns by a digest of role and text); `pos` numbers them over the table. `fault` is the first that holds: blank (only white
    space), duplicate (role and text seen earlier in the conversation), truncated (last character not one of .!?). `act` is K (keep), D
    (delete), u or a (rerole to user or assistant); `before` and `after` name turns of empty text to insert around the row, u or a each.
    The edits are the cheapest that make the initials of the roles match (s?(ua)+)?, of these the least by their initials D, I, K, R. A null
    conv_id is a conversation of its own. Null roles and texts are empty. Other columns are ignored; no rows give no edits.
    """
    spark = rows.sparkSession
    ready(spark)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), empty("role").alias("role"), empty("text").alias("text"))
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(end == "", BLANK).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    thin = rows.select("conv_id", "turn", _mark().alias("mark"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("mark")]
    parts = max(1, -(-rows.count() // SEGMENT_ROWS))
    thin = thin.withColumn("tie", F.monotonically_increasing_id())
    placed = thin.repartitionByRange(parts, *order, "tie").drop("tie").sortWithinPartitions(*order)
    placed = stored(placed.select("*", F.monotonically_increasing_id().alias("pos"), F.spark_partition_id().cast("long").alias("seg")), "repair-rows")
    first = placed.groupBy("conv_id", "mark").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    faulted = placed.join(first, "pos", "left").withColumn("fault", fault)
    held = F.array_sort(F.collect_list(F.struct("pos", "turn", "mark", "initial", "fault"))).alias("rows")
    segs = faulted.groupBy("conv_id", "seg").agg(held)
    of = Window.partitionBy("conv_id")
    segs = stored(segs.withColumn("first", F.col("seg") == F.min("seg").over(of)).withColumn("last", F.col("seg") == F.max("seg").over(of)), "repair-segments")

    many = segs.filter("not (first and last)")
    costs = many.mapInArrow(_matrices, "conv_id long, seg long, cost array<long>")
    ends = in_order(costs, "conv_id", [F.col("seg").desc()], _carry_back, "conv_id long, seg long, ends array<long>")
    ends = ends.select(F.col("conv_id").alias("c"), F.col("seg").alias("g"), "ends")
    met = segs.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("g")), "left")
    starts = F.when(F.col("first"), F.array(F.lit(NOTHING))).otherwise(F.array(*[F.lit(s) for s in range(4)]))
    asked = met.select("conv_id", "seg", "last", "ends", starts.alias("starts"), "rows")
    solved = stored(asked.mapInArrow(_solver(arrow_schema(SOLVED)), SOLVED), "repair-solved")

    several = solved.join(many.select(F.col("conv_id").alias("c"), F.col("seg").alias("g")), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("g")), "left_semi")
    chain = in_order(several.select("conv_id", "seg", "start", "stop"), "conv_id", [F.col("seg"), F.col("start")], _chain, "conv_id long, seg long, start int")
    chain = chain.select(F.col("conv_id").alias("c"), F.col("seg").alias("g"), F.col("start").alias("b"), F.lit(True).alias("on_path"))
    here = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("g")) & (F.col("start") == F.col("b"))
    single = segs.filter("first and last").select(F.col("seg").alias("g"), F.col("conv_id").alias("c"), F.lit(NOTHING).alias("b"), F.lit(True).alias("on_path"))
    chosen = solved.join(chain.unionByName(single), here, "left_semi")
    return chosen.select("conv_id", F.explode("edits").alias("e")).select("conv_id", "e.*")


def _merged(rows: DataFrame, edits: DataFrame, fold, schema: str) -> DataFrame:
    """Fold per conversation over its texts and edits in order: a row (kind 0) brings the text that the edits (kind 1) of its mark use."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    whole = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), empty("role").alias("role"), empty("text").alias("text"))
    nulls = {c: F.lit(None).cast(t) for c, t in (("pos", "long"), ("initial", "string"), ("fault", "int"), ("before", "string"), ("act", "string"), ("after", "string"))}
    texts = whole.withColumns({"mark": _mark(), "kind": F.lit(0), **nulls})
    asks = edits.withColumns({"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "kind": F.lit(1)})
    names = ["turn", "mark", "kind", "pos", "role", "text", "initial", "fault", "before", "act", "after"]
    both = texts.unionByName(asks).select("conv_id", *names)
    order = [F.col("turn").asc_nulls_first(), F.col("mark").asc_nulls_first(), "kind", F.col("pos").asc_nulls_first()]
    return in_order(both, "conv_id", order, fold, schema)


def _turns_of(role: str, text: str, before: str, act: str, after: str) -> Iterator[tuple[str, str]]:
    """The repaired turns (role, text) that a row leaves."""
    yield from ((ROLE[c], "") for c in before)
    if act != "D":
        yield (role if act == "K" else ROLE[act]), text
    yield from ((ROLE[c], "") for c in after)


def _repaired(rows: Iterator[tuple]) -> Iterator[tuple]:
    n = 0
    for turn, _, kind, _, role, text, _, _, before, act, after in rows:
        if kind == 0:
            held = (role, text)
        elif kind == 1:
            for said in _turns_of(*held, before, act, after):
                yield n, turn, *said
                n += 1


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, n (from 0), turn (of the row they stem from), role, text."""
    return _merged(rows, edits, _repaired, "conv_id long, n long, turn long, role string, text string")


FINE_PAIRS = {"su", "ua", "au"}
REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def _report(rows: Iterator[tuple]) -> Iterator[tuple]:
    faults, illegal, cost, audit = [0] * 4, 0, 0, []
    least = most = None
    turns, before_this, digest, begun = 0, None, hashlib.sha256(), False
    held = ("", "")
    for turn, _, kind, _, role, text, initial, fault, before, act, after in rows:
        if kind == 0:
            held = (role, text)
        elif kind == 1:
            if turn is not None and turn != most:
                least, most, turns = turn if least is None else least, turn, turns + 1
            faults[fault] += 1
            illegal += before_this is not None and before_this + initial not in FINE_PAIRS
            before_this = initial
            edits = "I" * len(before) + (act if act in "KD" else "R") + "I" * len(after)
            audit.append(edits)
            cost += INSERT * (len(before) + len(after)) + {"K": 0, "D": DELETE}.get(act, REROLE) + (CUT_OFF if fault == TRUNCATED and act != "D" else 0)
            for who, said in _turns_of(*held, before, act, after):
                digest.update(("\n" if begun else "").encode() + f"{who}:{said}".encode())
                begun = True
    gaps = 0 if least is None else most - least + 1 - turns
    yield gaps, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, cost, "".join(audit), digest.hexdigest()


def report(rows: DataFrame, edits: DataFrame, every: DataFrame) -> DataFrame:
    """Per conversation of `every` (column conv_id): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation without rows has zeros, an empty audit and the digest of the empty text. The digest over a conversation is sequential, so
    a conversation is one task; its rows stream through it and only the audit is held.
    """
    marked = every.select(F.col("conv_id").cast("long")).distinct()
    missing = marked.join(rows.select(F.col("conv_id").cast("long").alias("c")).distinct(), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti")
    zero = F.lit(0).cast("long")
    nothing = missing.select(
        "conv_id", *[zero.alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.lit("").alias("audit"), F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256"),
    )
    return _merged(rows, edits, _report, REPORT).unionByName(nothing)
