"""Snippets and highlight ranges over reader text."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from quarry.functions import arabic, arrow


def snippet_bounds(n_tokens: Column, center: Column, before: int = 10, after: int = 20, most_before: int | None = None) -> Column:
    """First token (inclusive), last (exclusive) and whether the start is cut, about a token."""
    start = F.greatest(F.lit(0), center - before)
    if most_before is not None:
        start = F.greatest(start, center - most_before)
    return F.struct(start.alias("start"), F.least(n_tokens, center + after + 1).alias("end"), (start > 0).alias("truncated"))


def kwic(text: Column, positions: Column, size: int = 50, before: int = 5) -> Column:
    """The page text about the first match: ``size`` tokens with at most ``before`` ahead of it, marked by an ellipsis where the start is cut.

    ``text`` is free of markup; tokens are those of ``token_map``. Signs between
    and inside tokens stay; a text without tokens there is given whole.
    """
    first = F.coalesce(F.get(positions, F.lit(0)), F.lit(0))
    start = F.greatest(F.lit(0), first - before)
    # A chunk is a token with what precedes it and the signs that hang on it.
    chunks = F.regexp_extract_all(text, F.lit(f"({arabic.CHUNK})"), F.lit(1))
    inside = F.slice(chunks, start + 1, F.lit(size))
    cut = F.regexp_replace(F.regexp_replace(F.array_join(inside, ""), f"^[^{arabic.LETTERS}]+", ""), f"[^{arabic.LETTERS}]+$", "")
    return F.when(F.size(inside) == 0, text).otherwise(F.concat(F.when(start > 0, "… ").otherwise(""), cut))


def reader_spans(pages: DataFrame, text: str = "body", positions: str = "matched_token_indices") -> DataFrame:
    """``pages`` with a column ``spans``: the text in pieces, each with its token (null between tokens) and whether it is highlighted.

    A piece is a run of characters of one token, or a single character of none.
    Texts go through numpy in slices of bounded size, and come back in as many batches.
    """
    kept = [f for f in pages.schema.fields if f.name != "spans"]
    names, kind = [f.name for f in kept], "array<struct<text:string,token:int,lit:boolean>>"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in arrow.text_slices(b, text):
                yield pa.RecordBatch.from_arrays([*part.columns, spans_of(part.column(text), part.column(positions))], [*names, "spans"])

    return pages.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, StructType([*kept, StructField("spans", _parse_datatype_string(kind))]))


def spans_of(texts: pa.Array, matched: pa.Array) -> pa.Array:
    points, n = arrow.code_points(texts)
    row = np.repeat(np.arange(len(n)), n)
    kind = _kinds()[points]
    # A token begins at a letter whose neighbour before it, signs left out, is none.
    solid = np.flatnonzero(kind != _SIGN)
    letter = kind[solid] == _LETTER
    after = np.zeros(len(solid), bool)
    after[1:] = letter[:-1] & (row[solid[1:]] == row[solid[:-1]])
    begins = np.zeros(len(points), np.int64)
    begins[solid] = letter & ~after
    count = np.concatenate([np.zeros(1, np.int64), np.cumsum(begins)])
    token = count[1:] - 1 - count[arrow.starts(n)[:-1]][row]
    joined = np.zeros(len(points), bool)
    joined[1:] = (kind[1:] == _LETTER) & (kind[:-1] == _LETTER) & (row[1:] == row[:-1])
    first = np.flatnonzero(~joined)
    inside, token, row = kind[first] == _LETTER, token[first], row[first]
    if isinstance(matched, pa.ChunkedArray):
        matched = matched.combine_chunks()
    m = pc.list_value_length(matched).fill_null(0).to_numpy(zero_copy_only=False)
    marks = pa.array(matched.flatten()).cast(pa.int64())
    known = marks.is_valid().to_numpy(zero_copy_only=False)
    wide = int(token.max(initial=0)) + 2
    at, of = np.repeat(np.arange(len(m)), m)[known], marks.drop_null().to_numpy(zero_copy_only=False)
    here = (of >= 0) & (of < wide)
    lit = inside & np.isin(row * wide + token, at[here] * wide + of[here])
    pieces = pa.StructArray.from_arrays(
        [arrow.strings(points, np.diff(np.append(first, len(points)))), pa.array(token.astype(np.int32), mask=~inside), pa.array(lit)], ["text", "token", "lit"]
    )
    return arrow.lists(np.bincount(row, minlength=len(n)), pieces)


_SIGN, _LETTER = 1, 2


@functools.cache
def _kinds() -> np.ndarray:
    """By code point: a sign that belongs to no token but ends none, a letter of a token, or anything else (0)."""
    table = np.zeros(arrow.ALL, np.uint8)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000:
            table[c] = _SIGN if arabic._SKIP_RE.match(chr(c)) else _LETTER if arabic._ARABIC_RE.match(chr(c)) else 0
    return table


def reader_tokens(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row for each piece of each page, in order (``at``), with the definition of its token where there is one."""
    key = ["text_id", "part_index", "page_id"]
    each = spans.select(*key, F.posexplode("spans").alias("at", "s")).select(*key, "at", F.col("s.text").alias("text"), F.col("s.token").alias("idx"), F.col("s.lit").alias("lit"))
    return each.join(tokens, [*key, "idx"], "left")


def token_count(text: Column) -> Column:
    return F.size(arabic.arabic_tokens(text))


def ranges_of(text: str, matched: set[int]) -> list[tuple[int, int]]:
    """Character ranges (end exclusive) of the matched tokens; neighbouring characters merge."""
    out: list[tuple[int, int]] = []
    for i, t in enumerate(arabic.token_map(text)):
        if t is not None and t in matched:
            if out and out[-1][1] == i:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i, i + 1))
    return out


def token_range(text: str, token: int) -> tuple[int, int] | None:
    """The first unbroken run of the token's characters."""
    return next(iter(ranges_of(text, {token})), None)


def token_at_char(text: str, at: int) -> int | None:
    m = arabic.token_map(text)
    return m[at] if 0 <= at < len(m) else None


def snippet_chars(text: str, center: int, before: int = 10, after: int = 20, most_before: int | None = None) -> tuple[int, int, bool]:
    m = arabic.token_map(text)
    start = max(0, center - before, *([center - most_before] if most_before is not None else []))
    inside = [i for i, t in enumerate(m) if t is not None and start <= t <= center + after]
    return (inside[0], inside[-1] + 1, start > 0) if inside else (0, len(m), False)


def highlight_ranges(pages: DataFrame, text: str = "body", positions: str = "matched_token_indices") -> DataFrame:
    """``pages`` with a column ``ranges``: character positions can't be had from built-in functions."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts, matched):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([[{"start": a, "end": b} for a, b in ranges_of(t or "", set(m if m is not None else ()))] for t, m in zip(texts, matched)])

    return pages.withColumn("ranges", run(text, positions))
