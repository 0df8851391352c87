"""Chat formatting: records of many layouts become turns, turns become one text with a loss mask.

A record's layout is found by a fingerprint: the nested paths of its fields, those only that some mapping knows, sorted and hashed. The
fingerprint selects a declarative mapping (`Layout`), which says where roles and texts lie. Tables are fingerprinted by their schema, JSON
records one by one. Turns are written between marks; control strings inside texts are escaped so that reading gives back every character.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutledger.llm.common import in_order, ready, stored

#: Marks of a turn.
START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts are learned, and names of roles in other layouts.
LEARNED = "assistant"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


@dataclass(frozen=True)
class Listed:
    """Turns in a list: path of the list, and paths of role and text inside an element (a text in parts is joined)."""

    path: str
    role: str
    text: str

    def paths(self) -> tuple[str, ...]:
        return f"{self.path}[].{self.role}", f"{self.path}[].{self.text}"

    def read(self, record: dict) -> Iterator[tuple[str, str]]:
        for element in _at(record, self.path):
            for item in element if isinstance(element, list) else [element]:
                role = "".join(_text(v) for v in _at(item, self.role))
                yield ROLES.get(role.lower(), role), "".join(_text(v) for v in _at(item, self.text))


@dataclass(frozen=True)
class Field:
    """One turn of a fixed role whose text is that of one or more fields, joined by a blank line where more have some."""

    role: str
    fields: tuple[str, ...]

    def paths(self) -> tuple[str, ...]:
        return self.fields

    def read(self, record: dict) -> Iterator[tuple[str, str]]:
        texts = [_text(v) for f in self.fields for v in _at(record, f)]
        if self.role != "system" or any(texts):
            yield self.role, "\n\n".join(t for t in texts if t)


@dataclass(frozen=True)
class Layout:
    """A mapping: where the turns of a record lie. Fields named optional may be missing; `also` names fields that may be there unread."""

    name: str
    turns: tuple[Listed | Field, ...]
    optional: tuple[str, ...] = ()
    also: tuple[str, ...] = ()

    def path_sets(self) -> Iterator[frozenset[str]]:
        """Every set of paths that this mapping reads."""
        must = {p for t in self.turns for p in t.paths()} - set(self.optional)
        may = (*self.optional, *self.also)
        for some in chain.from_iterable(combinations(may, n) for n in range(len(may) + 1)):
            yield frozenset(must | set(some))


#: A table with one row per turn.
ROWS = Layout("rows", (Field("", ("conv_id", "turn", "role", "text")),))
LAYOUTS = (
    Layout("messages", (Listed("messages", "role", "content"),), also=("prompt",)),
    Layout("message parts", (Listed("messages", "role", "content[].text"),), also=("messages[].content[].type", "prompt")),
    Layout("conversations", (Field("system", ("system",)), Listed("conversations", "from", "value")), optional=("system",)),
    Layout("dialog", (Listed("dialog", "speaker", "utterance"),)),
    Layout(
        "instruction",
        (Field("system", ("system",)), Field("user", ("instruction", "input")), Field("assistant", ("output",))),
        optional=("system", "input"),
    ),
    Layout("instruction and response", (Field("user", ("instruction", "context")), Field("assistant", ("response",))), optional=("context",)),
    Layout("prompt and completion", (Field("system", ("system",)), Field("user", ("prompt",)), Field("assistant", ("completion",))), optional=("system",)),
    Layout("prompt and response", (Field("system", ("system",)), Field("user", ("prompt",)), Field("assistant", ("response",))), optional=("system",)),
    Layout("question", (Field("user", ("question",)), Field("assistant", ("answer",))), also=("context",)),
)


def _text(value) -> str:
    """A leaf as text: null is empty, numbers and the like as JSON."""
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def _at(value, path: str) -> Iterator:
    """The values at a path; `[]` runs over the elements of a list."""
    head, _, rest = path.partition(".")
    name = head.removesuffix("[]")
    found = value.get(name) if isinstance(value, dict) else None
    for item in found if head.endswith("[]") and isinstance(found, list) else [found]:
        if rest:
            yield from _at(item, rest)
        elif not isinstance(value, dict):
            return
        else:
            yield item


def paths_of(record) -> set[str]:
    """Nested field paths of a JSON value; elements of a list share the path ending in []."""
    found, left = set(), [("", record)]
    while left:
        at, value = left.pop()
        if isinstance(value, dict) and value:
            left += [(f"{at}.{k}" if at else k, v) for k, v in value.items()]
        elif isinstance(value, list) and value:
            left += [(f"{at}[]", v) for v in value]
        else:
            found.add(at)
    return found


def schema_paths(schema: T.StructType) -> set[str]:
    """Nested field paths of a table."""
    found, left = set(), [("", schema)]
    while left:
        at, kind = left.pop()
        if isinstance(kind, T.StructType):
            left += [(f"{at}.{f.name}" if at else f.name, f.dataType) for f in kind.fields]
        elif isinstance(kind, T.ArrayType):
            left.append((f"{at}[]", kind.elementType))
        else:
            found.add(at)
    return found


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


class Mappings:
    """The layouts by fingerprint. Fields that no layout names take no part in it."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS) -> None:
        self.known = frozenset(p for layout in layouts for s in layout.path_sets() for p in s)
        self.by_print: dict[str, Layout] = {}
        for layout in layouts:
            for paths in layout.path_sets():
                if self.by_print.setdefault(fingerprint(paths), layout) is not layout:
                    raise ValueError(f"{layout.name}: fields {sorted(paths)} are those of {self.by_print[fingerprint(paths)].name}")

    def find(self, paths: set[str]) -> Layout | None:
        return self.by_print.get(fingerprint(paths & self.known))


TURNS = "conv_id long, layout string, turn long, role string, text string"
TURN = pa.schema([("conv_id", pa.int64()), ("layout", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def from_records(records: DataFrame, conv_id: str = "conv_id", record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Turns (conv_id, layout, turn, role, text) of JSON records, one per row, turns numbered from 0.

    A record that is null, no JSON object or of no known layout gives one row with a null layout and null turn, so that nothing is lost
    unseen. Null texts are empty. Other columns are ignored; repeated rows count each.
    """
    ready(records.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mappings = Mappings(layouts)
        for batch in batches:
            made = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    value = json.loads(text or "null")
                except (ValueError, RecursionError):
                    value = None
                layout = mappings.find(paths_of(value)) if isinstance(value, dict) else None
                if layout is None:
                    made.append((key, None, None, None, None))
                    continue
                turns = chain.from_iterable(t.read(value) for t in layout.turns)
                made += [(key, layout.name, n, role, said) for n, (role, said) in enumerate(turns)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), TURN)], schema=TURN)

    return records.select(F.col(conv_id).cast("long"), F.col(record).cast("string")).mapInArrow(run, TURNS)


def canonical_turns(table: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Turns (conv_id, layout, turn, role, text) of a table whose schema has a known fingerprint; conv_id tells the conversations apart.

    A table of rows by turn stays with Spark's own functions; any other goes through `from_records`. Null roles and texts are empty. A
    table of no known layout is an error. Columns that no layout names are ignored.
    """
    paths, mappings = schema_paths(table.schema), Mappings(layouts)
    layout = Mappings((ROWS,)).find(paths) or mappings.find(paths)
    if layout is None:
        raise ValueError(f"no layout for a table with {sorted(paths & mappings.known)}")
    if layout is ROWS:
        empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        key, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
        return table.select(key.alias("conv_id"), F.lit(layout.name).alias("layout"), turn.alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    tops = {p.split(".")[0].removesuffix("[]") for p in mappings.known}
    fields = F.to_json(F.struct(*[f"`{c}`" for c in table.columns if c in tops and c != "conv_id"]), {"ignoreNullFields": "false"})
    return from_records(table.select("conv_id", fields.alias("record")), layouts=layouts)


def escaped(text: Column) -> Column:
    """Text without the opening of a control string: a backslash more inside every `<|`, `<\\|`, `<\\\\|` and so on."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def format_turns(turns: DataFrame, learned: str = LEARNED) -> DataFrame:
    """One row per turn in order of (conv_id, turn): conv_id, at, piece, mask_from, mask_upto.

    The text of a conversation is its pieces in order of `at`; [mask_from, mask_upto) are the code points of the piece that are learned
    (null: none). Turns with a null number come first; equal numbers are ordered by role and text. Rows are dealt by range, so a long
    conversation is spread over tasks. Rows without a layout are left out.
    """
    rows = turns.filter(F.col("layout").isNotNull()) if "layout" in turns.columns else turns
    head = F.concat(F.lit(START), _escaped_role(F.col("role")), F.lit("\n"))
    rows = rows.select("conv_id", "turn", F.sha2(F.concat("role", F.lit("\n"), "text"), 256).alias("tie"), head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == learned).alias("learn"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    begin = F.when(F.col("learn"), F.length("head"))
    return rows.select(
        "conv_id", "at", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), begin.alias("mask_from"), (begin + F.length("body")).alias("mask_upto")
    )


PIECE = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def parse(piece: str) -> list[tuple[str, str]]:
    """The turns (role, text) of formatted text; text that is not wholly turns is an error."""
    at, turns = 0, []
    while at < len(piece):
        met = PIECE.match(piece, at)
        if met is None:
            raise ValueError(f"no turn at {at}: {piece[at : at + 40]!r}")
        turns.append((_unescaped_role(met[1]), unescaped(met[2])))
        at = met.end()
    return turns


def _read_back(rows: Iterator[tuple]) -> Iterator[tuple]:
    n = chars = learned = 0
    told, loss = hashlib.sha256(), hashlib.sha256()
    for _, piece, begin, end in rows:
        for role, text in parse(piece):
            n += 1
            told.update(f"{role}\n{text}\n".encode())
        chars += len(piece)
        if begin is not None:
            masked = unescaped(piece[begin:end])
            learned += len(masked)
            loss.update(masked.encode())
    yield n, told.hexdigest(), learned, loss.hexdigest(), chars


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from formatted rows: number and digest of the turns, code points and digest of the learned text, code points in all.

    A digest over a whole conversation is sequential, so a conversation is one task; its pieces stream through it.
    """
    ready(formatted.sparkSession)
    return in_order(formatted.select("conv_id", "at", "piece", "mask_from", "mask_upto"), "conv_id", [F.col("at")], _read_back, READ)


def formatted(turns: DataFrame) -> DataFrame:
    """`format_turns`, written to the shared folder and read again."""
    return stored(format_turns(turns), "chat-formatted")
