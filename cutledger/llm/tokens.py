"""Token ids of every document in a compact binary file, through an adaptive context-mixing range coder.

A shard (a range of document ids) becomes one file: header, order-0 table, document index, blocks. Every block starts from a reset model and
carries a checksum of its ids, so blocks are coded and decoded side by side, one numpy lane each, and a damaged block does not touch the
next one. For each id the model has an order-2 and an order-1 prediction (the id last seen behind the same two ids, or behind the same one);
the chance that the order-2 prediction is right is mixed from adaptive chances given its own confidence, the confidence of order 1 and the
order-0 frequency class of the predicted id; then comes the chance of the order-1 prediction, and what neither predicts is coded by its
order-0 frequency. All arithmetic is on integers, so that any machine reads what any other wrote.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutledger.llm.common import parts_for, ready, stored, text_of, volume

END_ID = 2
BLOCK = 4096
SHARD_BYTES = 16_000_000
MAGIC, VERSION = b"CLTK", 1

# ---- tokenizing --------------------------------------------------------------------------------------------------------------------------

CLEAN_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: White space next to a blank, or at an end of the text.
OTHER_BLANK = re.compile(r" \s|\s |\A\s|\s\Z")
KNOWN_PIECES = 1_000_000
#: How byte-level tokenizers write a blank.
BLANK = "\u0120"


class PieceEncoder:
    """A tokenizer of the byte-level BPE kind behind a memory of pieces.

    Its rules never join a single blank between two other characters to the piece before it, so a text may be cut in front of such blanks
    and each distinct piece is encoded once. Texts with other white space next to a blank are cut by the slower pattern. The memory has a
    piece without its blank; the first piece of a text, which has none, is encoded anew.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the ids that begin with a blank: in a row of pieces each with one blank, its first character, these are where the pieces begin
        self.begins = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.begins[[i for word, i in self.tokenizer.get_vocab().items() if word.startswith(BLANK)]] = True
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces: in a row, at a fraction of the cost of a call each, unless they have other blanks than their own."""
        (ids,) = self._encoded([" " + " ".join(pieces)])
        start = np.flatnonzero(self.begins[ids])
        if len(start) == len(pieces) and start[0] == 0 and not any(" " in p or p[-1].isspace() for p in pieces):
            sizes = np.diff(start, append=len(ids))
        else:
            each = self._encoded([f" {p}" for p in pieces])
            ids, sizes = np.concatenate(each), np.array([len(x) for x in each], np.int64)
        n, m = len(self.code), len(self.code) + len(pieces)
        while m > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[n:m], self.size[n:m] = self.used + np.cumsum(sizes) - sizes, sizes
        self.code.update(zip(pieces, range(n, m)))
        self.used += len(ids)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        first, *pieces = CLEAN_BLANK.split(text) if OTHER_BLANK.search(text) else text.split(" ")
        (head,) = self._encoded([first])
        if not pieces:
            return head
        if len(self.code) > KNOWN_PIECES:
            self._forget()
        codes = list(map(self.code.get, pieces))
        if None in codes:
            self._learn(list(dict.fromkeys(p for p, c in zip(pieces, codes) if c is None)))
            codes = map(self.code.__getitem__, pieces)
        codes = np.fromiter(codes, np.int64, len(pieces))
        size = self.size[codes]
        ends = np.cumsum(size)
        return np.concatenate([head, self.ids[np.repeat(self.start[codes] - ends + size, size) + np.arange(ends[-1])]])


# ---- order-0 table -----------------------------------------------------------------------------------------------------------------------

TOTAL_BITS = 16


class Frequencies:
    """Frequencies of the ids of a shard in units of 2^-16, each id at least one unit."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray) -> None:
        self.ids, self.freq = ids, freq
        size = int(ids[-1]) + 2 if len(ids) else 1
        self.of, self.from_ = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.of[ids] = freq
        self.from_[ids] = np.cumsum(freq) - freq
        self.slot = np.repeat(ids, freq)
        self.kind = np.zeros(size, np.int64)  # 0 for an id that does not occur
        self.kind[ids] = np.minimum(np.log2(freq).astype(np.int64), 14) + 1

    @classmethod
    def count(cls, ids: np.ndarray) -> Frequencies:
        kinds, n = np.unique(ids, return_counts=True)
        if not len(kinds):
            return cls(kinds.astype(np.int64), n.astype(np.int64))
        room = (1 << TOTAL_BITS) - len(kinds)
        freq = 1 + n * room // n.sum()
        freq[np.argmax(freq)] += (1 << TOTAL_BITS) - int(freq.sum())
        return cls(kinds.astype(np.int64), freq.astype(np.int64))

    def dump(self) -> bytes:
        return zlib.compress(np.diff(self.ids, prepend=0).astype("<u4").tobytes() + self.freq.astype("<u4").tobytes())

    @classmethod
    def load(cls, data: bytes) -> Frequencies:
        both = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
        return cls(np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :])


# ---- the coder ---------------------------------------------------------------------------------------------------------------------------

U = np.uint64
FLAG_BITS = 12
TOP, LEAST = U(1 << 48), U(1 << 32)
SLOTS_2, SLOTS_1 = 4096, 2048
SURE = 15
RATE = 5


class Coder:
    """Carryless range coder over many blocks at once: one lane per block, 16 bits at a time."""

    def __init__(self, lanes: int, words: np.ndarray | None = None) -> None:
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
        self.reading = words is not None
        self.words = words if words is not None else np.zeros((lanes, 3 * BLOCK + 8), np.uint16)
        self.flat, self.wide = self.words.reshape(-1), self.words.shape[1]
        self.at = np.arange(lanes) * self.wide
        self.code = np.zeros(lanes, U)
        if self.reading:
            for _ in range(4):
                self.code = (self.code << U(16)) | self.flat[self.at].astype(U)
                self.at += 1

    def narrow(self, lanes, start: np.ndarray, freq: np.ndarray, bits: int) -> None:
        step = self.range[lanes] >> U(bits)
        low = self.low[lanes] + step * start.astype(U)
        width = step * freq.astype(U)
        self.low[lanes], self.range[lanes] = low, width
        # settle words: the first 16 bits agree, or the range has become too small to wait for that
        todo = ((low ^ (low + width)) < TOP) | (width < LEAST)
        while todo.any():
            where = np.flatnonzero(todo)
            mine = where if isinstance(lanes, slice) else lanes[where]
            low, width = self.low[mine], self.range[mine]
            width = np.where((low ^ (low + width)) < TOP, width, (U(0) - low) & (LEAST - U(1)))
            at = self.at[mine]
            if self.reading:
                self.code[mine] = (self.code[mine] << U(16)) | self.flat[at].astype(U)
            else:
                self.flat[at] = (low >> U(48)).astype(np.uint16)
            self.at[mine] = at + 1
            low, width = low << U(16), width << U(16)
            self.low[mine], self.range[mine] = low, width
            todo[where] = ((low ^ (low + width)) < TOP) | (width < LEAST)

    def seen(self, lanes, bits: int) -> np.ndarray:
        """Where in the range the code stands, in units of 2^-bits."""
        step = self.range[lanes] >> U(bits)
        return np.minimum((self.code[lanes] - self.low[lanes]) // step, U((1 << bits) - 1)).astype(np.int64)

    def finish(self) -> list[bytes]:
        for k in range(4):
            self.flat[self.at] = (self.low >> U(48 - 16 * k)).astype(np.uint16)
            self.at += 1
        ends = self.at - np.arange(len(self.at)) * self.wide
        return [self.words[i, :n].astype("<u2").tobytes() for i, n in enumerate(ends)]


def run_lanes(freq: Frequencies, sizes: np.ndarray, coder: Coder, ids: np.ndarray | None) -> np.ndarray:
    """Code (or, without ids, decode) blocks in step. ids: lanes x BLOCK; only the last lane may be shorter than the first."""
    lanes = len(sizes)
    out = np.zeros((BLOCK, lanes), np.int64) if ids is None else np.ascontiguousarray(ids.T.astype(np.int64))
    base_2, base_1 = np.arange(lanes) * SLOTS_2, np.arange(lanes) * SLOTS_1
    table_2, table_1 = np.zeros(lanes * SLOTS_2, np.int32), np.zeros(lanes * SLOTS_1, np.int32)  # id * 16 + confidence
    half = 1 << (FLAG_BITS - 1)
    by_2, by_1, by_0 = (np.full(lanes * 32, half << 4, np.int64) for _ in range(3))
    second = np.full(lanes * 32, half << 4, np.int64)
    base_c = np.arange(lanes) * 32
    one, two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    full, kinds = 1 << FLAG_BITS, len(freq.kind) - 1
    for t in range(int(sizes.max()) if lanes else 0):
        n = lanes if t < sizes[-1] else lanes - 1
        a, b = one[:n], two[:n]
        at_2 = base_2[:n] + (((a * 0x2545F4915 + b * 0x9E3779B1) >> 13) & (SLOTS_2 - 1))
        at_1 = base_1[:n] + (((a * 0x9E3779B1) >> 13) & (SLOTS_1 - 1))
        e_2, e_1 = table_2[at_2], table_1[at_1]
        p_2, p_1 = e_2 >> 4, e_1 >> 4
        c_2, c_1 = e_2 & 15, e_1 & 15
        agree = p_2 == p_1
        i_2, i_1 = base_c[:n] + c_2 * 2 + agree, base_c[:n] + c_1 * 2 + agree
        i_0 = base_c[:n] + freq.kind[np.minimum(p_2, kinds)]
        q_2, q_1, q_0 = by_2[i_2], by_1[i_1], by_0[i_0]
        chance = np.clip((2 * q_2 + q_1 + q_0) >> 6, 1, full - 2)
        rest = full - chance
        q_s = second[i_1]
        other = np.where(agree, 0, np.clip((rest * (q_s >> 4)) >> FLAG_BITS, 1, rest - 1))
        if ids is None:
            spot = coder.seen(slice(0, n), FLAG_BITS)
            hit_2 = spot < chance
            hit_1 = ~hit_2 & (spot < chance + other)
        else:
            x = out[t, :n]
            hit_2 = x == p_2
            hit_1 = ~hit_2 & (x == p_1)
        start = np.where(hit_2, 0, np.where(hit_1, chance, chance + other))
        wide = np.where(hit_2, chance, np.where(hit_1, other, rest - other))
        coder.narrow(slice(0, n), start, wide, FLAG_BITS)
        miss = np.flatnonzero(~(hit_2 | hit_1))
        if ids is None:
            x = np.where(hit_2, p_2, p_1)
            if len(miss):
                x[miss] = freq.slot[coder.seen(miss, TOTAL_BITS)]
            out[t, :n] = x
        if len(miss):
            y = x[miss]
            coder.narrow(miss, freq.from_[y], freq.of[y], TOTAL_BITS)
        target = hit_2.astype(np.int64) << 16
        by_2[i_2] = q_2 + ((target - q_2) >> RATE)
        by_1[i_1] = q_1 + ((target - q_1) >> RATE)
        by_0[i_0] = q_0 + ((target - q_0) >> RATE)
        second[i_1] = np.where(hit_2 | agree, q_s, q_s + (((hit_1.astype(np.int64) << 16) - q_s) >> RATE))
        fresh = (x << 4) | 1
        table_2[at_2] = np.where(hit_2, e_2 + (c_2 < SURE), np.where(c_2 <= 1, fresh, e_2 - (c_2 >> 1)))
        table_1[at_1] = np.where(x == p_1, e_1 + (c_1 < SURE), np.where(c_1 <= 1, fresh, e_1 - (c_1 >> 1)))
        two[:n] = a
        one[:n] = x
    return out


# ---- the file ----------------------------------------------------------------------------------------------------------------------------

HEAD = struct.Struct("<4sHIQII")  # magic, version, documents, ids, blocks, ids per block
PART = struct.Struct("<III")  # ids, bytes, checksum of the bytes; a block's bytes begin with the checksum of its ids


def _part(n: int, data: bytes) -> bytes:
    return PART.pack(n, len(data), zlib.crc32(data)) + data


def write_file(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """A shard: documents in order with the number of ids of each, and all their ids."""
    n = -(-len(ids) // BLOCK)
    freq = Frequencies.count(ids)
    index = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + np.array(sizes, "<i8").tobytes()
    out = [HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids), n, BLOCK), _part(len(freq.ids), freq.dump()), _part(len(doc_ids), zlib.compress(index))]
    if n:
        lens = np.full(n, BLOCK)
        lens[-1] = len(ids) - BLOCK * (n - 1)
        grid = np.zeros(n * BLOCK, np.uint32)
        grid[: len(ids)] = ids
        coder = Coder(n)
        run_lanes(freq, lens, coder, grid.reshape(n, BLOCK))
        for k, words in enumerate(coder.finish()):
            own = ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()
            out.append(_part(int(lens[k]), struct.pack("<I", zlib.crc32(own)) + words))
    return b"".join(out)


class DamagedBlock(ValueError):
    """A part of a file does not match its checksum."""


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, number of ids of each, all ids); raises DamagedBlock where a checksum does not match."""
    magic, version, docs, total, n, block = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION or block != BLOCK:
        raise DamagedBlock("not a token file of this version")
    at = HEAD.size

    def part() -> tuple[int, bytes, int]:
        nonlocal at
        count, size, check = PART.unpack_from(data, at)
        at += PART.size + size
        return count, data[at - size : at], check

    (_, table, c_table), (_, index, c_index) = part(), part()
    if zlib.crc32(table) != c_table or zlib.crc32(index) != c_index:
        raise DamagedBlock("order-0 table or document index")
    freq, index = Frequencies.load(table), zlib.decompress(index)
    blank = index[8 * docs : 9 * docs]
    doc_ids = [None if none else int(d) for d, none in zip(np.frombuffer(index[: 8 * docs], "<i8"), blank)]
    sizes = np.frombuffer(index[9 * docs :], "<i8")
    blocks = [part() for _ in range(n)]
    for k, (_, body, check) in enumerate(blocks):
        if zlib.crc32(body) != check:
            raise DamagedBlock(f"block {k}")
    if not n:
        return doc_ids, sizes, np.zeros(0, np.uint32)
    words = np.zeros((n, max(len(b[1]) for b in blocks) // 2 + 8), np.uint16)
    for row, b in zip(words, blocks):
        row[: len(b[1]) // 2 - 2] = np.frombuffer(b[1], "<u2", offset=4)
    lens = np.array([b[0] for b in blocks])
    grid = run_lanes(freq, lens, Coder(n, words), None).T.astype("<u4")
    for k, (count, body, _) in enumerate(blocks):
        if struct.pack("<I", zlib.crc32(grid[k, :count].tobytes())) != body[:4]:
            raise DamagedBlock(f"block {k}")
    return doc_ids, sizes, grid.reshape(-1)[:total]


# ---- Spark -------------------------------------------------------------------------------------------------------------------------------

FILES = "shard int, n_docs long, n_ids long, file binary"
_ENCODERS: dict[str, PieceEncoder] = {}


def _writer(path: str) -> Callable:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _ENCODERS:
            _ENCODERS[path] = PieceEncoder(path)
        doc_ids, parts = [], []
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            for doc_id, none, text in zip(batch["doc_id"], batch["none"], batch["text"]):
                doc_ids.append(None if none else int(doc_id))
                parts.append(np.concatenate([_ENCODERS[path].encode(text), end]))
        if doc_ids:
            ids = np.concatenate(parts)
            data = write_file(doc_ids, [len(p) for p in parts], ids)
            yield pd.DataFrame({"shard": [TaskContext.get().partitionId()], "n_docs": [len(doc_ids)], "n_ids": [len(ids)], "file": [data]})

    return run


def write_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Token files of all documents in ascending order of their ids (null first, equal ids by text): one row (shard, n_docs, n_ids, file) each.

    Null texts count as empty and give the end id alone. `tokenizer` is the path of a tokenizer file that every worker can open. A shard is a
    range of ids of about `shard_bytes` of text and is written by one task; write the rows as Parquet to keep the files.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    dealt = rows.repartitionByRange(parts_for(volume(rows)[1], shard_bytes), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt = dealt.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text")
    return dealt.mapInPandas(_writer(tokenizer), FILES)


def _reader(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for shard, data in zip(batch["shard"], batch["file"]):
            doc_ids, sizes, ids = read_file(data)
            ends = np.cumsum(sizes)
            raw = ids.astype("<u4").tobytes()
            sums = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
            yield pd.DataFrame({
                "shard": shard, "doc_id": pd.array(doc_ids, "Int64"), "offset": ends - sizes, "n_tokens": sizes,
                "ids_crc32": np.array(sums, np.int64),
            })


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. One file is decoded at a time."""
    ready(files.sparkSession)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    begins = files.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("begin"))
    decoded = files.select("shard", "file").mapInPandas(_reader, "shard int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return decoded.join(begins, "shard").select("doc_id", (F.col("begin") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token files of `docs` to the shared folder and read them back; columns as in `read_tokens`. Other columns are ignored."""
    return read_tokens(stored(write_tokens(docs, tokenizer, doc_id, text), "tokens"))
