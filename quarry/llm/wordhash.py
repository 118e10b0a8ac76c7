"""Words of Arrow text columns as 64-bit hashes, by numpy over the raw UTF-8 bytes.

A word is a run of bytes other than ASCII white space, lower-cased. Its hash is
a polynomial of its bytes modulo 2^64, mixed; it depends on the word alone, so
hashes can be compared across documents, batches and machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
PIECE = 1 << 17
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
#: Only ASCII letters and digits, and all beyond ASCII, count as parts of words.
PUNCTUATION = np.array([not (chr(i).isalnum() or i > 127) for i in range(256)])
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64, for i < n."""
    if not _powers or len(_powers["p"]) < n:
        n = max(n, 2 * PIECE)
        for key, base in (("p", BASE), ("i", pow(BASE, -1, 1 << 64))):
            x = np.full(n, base, dtype=U64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=U64)
    return _powers["p"], _powers["i"]


@dataclass
class Words:
    """``hash[first[d]:first[d + 1]]`` are the words of document d, ``start`` and ``end`` their byte offsets in ``data``."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    doc: np.ndarray


def words_of(column: pa.Array, lower: bool = True, hashes: bool = True, space: np.ndarray = _SPACE) -> Words:
    """Null counts as empty. Lower-casing may change byte lengths: pass lower=False where offsets into the text matter."""
    col = pc.fill_null(column, "").cast(pa.large_string())
    if lower:
        col = pc.utf8_lower(col)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    base = int(offsets[0]) if n else 0
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[base : int(offsets[-1])] if n and raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - base
    ink = ~space[data]
    left = np.empty_like(ink)
    right = np.empty_like(ink)
    if len(ink):
        left[0] = True
        np.logical_not(ink[:-1], out=left[1:])
        right[-1] = True
        np.logical_not(ink[1:], out=right[:-1])
        bounds = offsets[(offsets > 0) & (offsets < len(ink))]
        left[bounds] = True
        right[bounds - 1] = True
    start = np.flatnonzero(ink & left)
    end = np.flatnonzero(ink & right) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(first)) if n else np.zeros(0, np.int64)
    h = _hash(data, start, end) if hashes else np.zeros(0, U64)
    return Words(h, first, start, end, data, doc)


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), dtype=U64)
    i = 0
    while i < len(start):
        at = start[i]
        j = max(i + 1, int(np.searchsorted(end, at + PIECE, side="right")))
        piece = data[at : end[j - 1]]
        p, inv = powers(len(piece) + 1)
        total = np.empty(len(piece) + 1, dtype=U64)
        total[0] = 0
        np.cumsum((piece.astype(U64) + U64(1)) * p[: len(piece)], out=total[1:])
        s, e = start[i:j] - at, end[i:j] - at
        out[i:j] = (total[e] - total[s]) * inv[s]
        i = j
    return mix(out)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one document, by doubling."""
    if len(h) < k:
        return np.zeros(0, dtype=U64)
    have, size, at, out = h, 1, 0, None
    while k:
        if k & 1:
            if out is None:
                out, at = have, size
            else:
                m = min(len(out), len(have) - at)
                out = mix(out[:m] * U64(0xD1342543DE82EF95) + have[at : at + m] + U64(at))
                at += size
        k >>= 1
        if k:
            have = mix(have[:-size] * U64(0xA24BAED4963EE407) + have[size:])
            size *= 2
    return out


def batches(it: Iterator[pa.RecordBatch], text: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text, or of one longer text, so that what is computed from them stays small."""
    for b in it:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < b.num_rows:
            done = sizes[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield b.slice(at, upto - at)
            at = upto
