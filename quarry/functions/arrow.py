"""Texts of Arrow batches as code points, and back, so that numpy works on whole slices without a loop over characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once, and tokens; a longer text is a slice of its own.
TEXT_BYTES, TOKENS = 1 << 20, 1 << 20
#: Code points there are, and the mark of one that is deleted.
ALL, DROP = 0x110000, 0xFFFFFFFF


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows, of at most ``most`` by ``sizes`` or of one row."""
    ends, s = np.cumsum(sizes), 0
    while s < len(sizes):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most, "right")))
        yield s, e
        s = e


def text_slices(batch: pa.RecordBatch, column: str, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    return (batch.slice(s, e - s) for s, e in cuts(sizes, most))


def list_slices(batch: pa.RecordBatch, column: str, most: int = TOKENS) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    return (batch.slice(s, e - s) for s, e in cuts(sizes, most))


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts, and how many each has; a null text has none."""
    rows = [t or "" for t in texts.to_pylist()]
    return np.frombuffer("".join(rows).encode("utf-32-le"), "<u4"), np.fromiter(map(len, rows), np.int64, len(rows))


def starts(counts: np.ndarray) -> np.ndarray:
    """Where each of consecutive groups begins, and the end of the last."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)])


def strings(points: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive strings of ``lengths`` code points."""
    size = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    offsets = starts(size)[starts(lengths)].astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))


def split_strings(joined: pa.Array) -> pa.Array:
    """The tokens of strings that have one space before, between and after them, as lists; only spaces are looked for, byte by byte."""
    whole = joined.cast(pa.large_string())
    at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    spaces = np.flatnonzero(data == 32)
    counts = np.where(np.diff(at) > 2, np.diff(np.searchsorted(spaces, at)) - 1, 0)
    lengths = np.diff(spaces) - 1
    lengths = lengths[lengths > 0]
    tokens = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(starts(lengths).astype(np.int32)), pa.py_buffer(data[data != 32]))
    return lists(counts, tokens, joined.is_null().to_numpy(zero_copy_only=False))


def lists(counts: np.ndarray, values: pa.Array, null: np.ndarray | None = None) -> pa.Array:
    mask = pa.array(null) if null is not None and null.any() else None
    return pa.ListArray.from_arrays(pa.array(starts(counts), pa.int32()), values, mask=mask)


def translation(source: str, target: str) -> np.ndarray:
    """The table of Spark's translate: the first mapping of a character counts, those beyond the targets are deleted."""
    table = np.arange(ALL, dtype=np.uint32)
    for i in reversed(range(len(source))):
        table[ord(source[i])] = ord(target[i]) if i < len(target) else DROP
    return table


def chain(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.where(first == DROP, np.uint32(DROP), second[np.where(first == DROP, 0, first)])


def marked(characters: str) -> np.ndarray:
    """For each code point whether it is one of ``characters``."""
    table = np.zeros(ALL, bool)
    table[[ord(c) for c in characters]] = True
    return table


def blob_values(blobs: pa.Array, kind: str | np.dtype) -> np.ndarray:
    """The numbers in consecutive binaries."""
    blobs = blobs.cast(pa.large_binary())
    at = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    return np.frombuffer((blobs.buffers()[2] or pa.py_buffer(b"")).slice(at[0], at[-1] - at[0]).to_pybytes() if len(blobs) else b"", kind)


def blobs(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Binaries of consecutive numbers, from where each begins."""
    ends = (np.append(begin, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])
