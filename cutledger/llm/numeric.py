"""64-bit hashing of bytes and words over whole numpy columns, and the packed exchange of hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd

U = np.uint64
#: Odd multipliers of the polynomial hashes and of the mixing step (fixed values of 64-bit golden-ratio and murmur style mixing).
BASE = U(0x9E3779B97F4A7C15 | 1)
MIX_A, MIX_B = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (murmur finaliser)."""
    h = h ^ (h >> U(33))
    h = h * MIX_A
    h ^= h >> U(33)
    h *= MIX_B
    h ^= h >> U(33)
    return h


@lru_cache(4)
def _symbols(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0..n and their inverses, modulo 2^64."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, n.bit_length())
        up = np.full(size + 1, BASE, U)
        up[0] = 1
        down = np.full(size + 1, U(pow(int(BASE), -1, 2**64)), U)
        down[0] = 1
        _POWERS[0] = have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def prefix_sums(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """S with S[j] - S[i] = sum of symbol(data[t]) * BASE^t over i <= t < j."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U)
    np.cumsum(_symbols(seed)[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start..end, equal for equal bytes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edge = np.concatenate([[0] if not blank[0] else [], edge, [len(data)] if not blank[-1] else []]).astype(np.int64)
    return edge[0::2], edge[1::2]


def word_hashes(text: str) -> np.ndarray:
    """Hash of every whitespace-separated word of the text, with A-Z lower."""
    data = np.frombuffer(text.encode("utf-8", "replace").translate(LOWER), np.uint8)
    start, end = word_edges(data)
    return span_hashes(prefix_sums(data), start, end) if len(start) else np.zeros(0, U)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words, of the whole sequence; without a word, none."""
    words = word_hashes(text) if text else np.zeros(0, U)
    if not len(words):
        return words
    size = min(n, len(words))
    up = powers(n)[0]
    h = np.full(len(words) - size + 1, U(size), U)
    for k in range(size):
        h += mix(words[k : len(words) - size + 1 + k] + U(k)) * up[k + 1]
    return np.unique(mix(h))


#: Bytes of short texts that are hashed together: their columns stay in the cache.
CHUNK = 48_000


def _sets_together(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The shingle sets of some lower-cased texts, whose bytes are laid one after the other."""
    length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(length)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    start, end = word_edges(data)
    if not len(start):
        return [np.zeros(0, U)] * len(texts)
    words = span_hashes(prefix_sums(data), start, end)
    upto = np.searchsorted(start, ends)
    begin = np.concatenate([[0], upto[:-1]])
    size = np.minimum(n, upto - begin)
    up = powers(n)[0]
    # windows of n words; those that run into the next text are left out below
    h = np.full(max(len(words) - n + 1, 0), U(n), U)
    for k in range(n if len(h) else 0):
        h += mix(words[k : len(words) - n + 1 + k] + U(k)) * up[k + 1]
    h = mix(h)
    out = []
    for lo, hi, some in zip(begin.tolist(), upto.tolist(), size.tolist()):
        if some == n:
            own = h[lo : hi - n + 1]
            own.sort()
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            out.append(own[fresh])
        elif some:
            one = np.full(1, U(some), U)
            for k in range(some):
                one += mix(words[lo + k : lo + k + 1] + U(k)) * up[k + 1]
            out.append(mix(one))
        else:
            out.append(np.zeros(0, U))
    return out


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """`shingle_set` of each text; short texts are hashed together."""
    out: list[np.ndarray] = []
    some: list[bytes] = []
    held = 0
    for text in texts:
        raw = text.encode("utf-8", "replace").translate(LOWER) if text else b""
        if some and held + len(raw) > CHUNK:
            out += _sets_together(some, n)
            some, held = [], 0
        some.append(raw)
        held += len(raw) + 1
    return out + _sets_together(some, n) if some else out


def scatter(
    keys: np.ndarray, refs: np.ndarray, owners: np.ndarray, buckets: int, by_owner: bool = False, narrow: bool = False
) -> pd.DataFrame:
    """Deal (key, owner) records into rows (bucket, owners, refs, keys), one row per bucket met; refs index the row's owners.

    Buckets are ranges of the key, or hashes of the owner. ``narrow`` sends the lower half of the keys only, for keys whose equality is
    verified later: a bucket's share of the upper half still tells them apart.
    """
    place = mix(owners.astype(U))[refs] if by_owner else keys
    bucket = ((place >> U(32)) * U(buckets)) >> U(32)
    order = np.argsort(bucket, kind="stable")
    bucket, refs = bucket[order], refs[order]
    sent = keys[order].astype(np.uint32) if narrow else keys[order]
    ends = np.flatnonzero(np.diff(bucket)) + 1
    rows = []
    for lo, hi in zip(np.concatenate([[0], ends]), np.concatenate([ends, [len(sent)]])):
        if hi > lo:
            own, ref = np.unique(refs[lo:hi], return_inverse=True)
            kind = np.uint16 if len(own) <= 65536 else np.uint32
            rows.append((int(bucket[lo]), owners[own].tobytes(), ref.astype(kind).tobytes(), sent[lo:hi].tobytes(), kind().itemsize))
    return pd.DataFrame(rows, columns=["bucket", "owners", "refs", "keys", "width"])


PACKED = "bucket long, owners binary, refs binary, keys binary, width int"


def gather(rows: pd.DataFrame, owner_type: type = np.int64, narrow: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owners) of all records of a bucket's rows; narrow keys get the bucket's number as their upper half."""
    keys = np.concatenate([np.frombuffer(k, np.uint32 if narrow else U) for k in rows["keys"]])
    if narrow:
        keys = keys.astype(U) | U(int(rows["bucket"].iloc[0])) << U(32)
    owners = np.concatenate(
        [np.frombuffer(o, owner_type)[np.frombuffer(r, np.uint16 if w == 2 else np.uint32)] for o, r, w in zip(rows["owners"], rows["refs"], rows["width"])]
    )
    return keys, owners
