"""The token dictionary: packed ids per page, definitions, and their six dimensions.

Ids are unpacked by numpy over the raw bytes of a batch of pages. Dimensions and,
while it has at most ``BROADCAST_ROWS`` definitions, the dictionary are sent to the
tasks; of a larger dictionary each block of pages gets the definitions it needs. No
token moves by itself either way.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.functions import arrow
from quarry.functions.scalars import json_clitics, json_strings
from quarry.workdir import Scratch

KEY = ["text_id", "part_index", "page_id"]
STREAMS = ["surface", "lemma", "root"]
BROADCAST_ROWS = 1_000_000
#: Rows of the Arrow batches that Python returns.
ROWS = 1 << 16


def decode_ids(blob: Column) -> Column:
    """Little-endian unsigned 32-bit numbers; a trailing part of one is ignored."""
    byte = lambda i, k: F.hex(F.substring(blob, i * 4 + k, F.lit(1)))
    number = lambda i: F.conv(F.concat(*[byte(i, k) for k in (4, 3, 2, 1)]), 16, 10).cast("bigint")
    count = F.floor(F.length(blob) / 4).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), number)).otherwise(F.array().cast("array<bigint>"))


def encode_ids(ids: Column) -> Column:
    flip = lambda h: F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)])
    return F.unhex(F.array_join(F.transform(ids, lambda x: flip(F.lpad(F.hex(x), 8, "0"))), ""))


def unpacked(packed: DataFrame) -> DataFrame:
    """Page key, ``idx`` and ``token_id`` of every token of ``packed`` (key, token_ids); a trailing part of an id is ignored."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            blobs = b.column(3).cast(pa.large_binary())
            at = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
            data = np.frombuffer(blobs.buffers()[2] or b"", np.uint8)
            n = np.diff(at) // 4
            ids = [np.frombuffer(data[s : s + 4 * k].tobytes(), "<u4") for s, k in zip(at, n)]
            page = np.repeat(np.arange(len(n)), n)
            idx = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            token = (np.concatenate(ids) if ids else np.zeros(0, "<u4")).astype(np.int64)
            for s in range(0, len(page), ROWS):
                part = pa.array(page[s : s + ROWS])
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(part) for i in range(3)), pa.array(idx[s : s + ROWS]), pa.array(token[s : s + ROWS])], [*KEY, "idx", "token_id"])

    kinds = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in KEY)
    return packed.select(*KEY, F.coalesce("token_ids", F.lit(b"")).alias("token_ids")).mapInArrow(run, f"{kinds}, idx int, token_id bigint")


def small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked to be sent to all tasks if it has few rows."""
    return F.broadcast(table) if table.count() <= most else table


@dataclass
class Dictionary:
    """``definitions`` (id, surface, lemma_id, root_id, pos_id, feature_set_id, clitic_set_id) and its dimensions."""

    definitions: DataFrame
    roots: DataFrame
    lemmas: DataFrame
    pos_types: DataFrame
    feature_sets: DataFrame
    clitic_sets: DataFrame

    def resolved(self, ids: DataFrame | None = None) -> DataFrame:
        """Definitions with all texts in place: one row for each distinct token, or for those in ``ids`` (token_id)."""
        d = self.definitions
        if ids is not None:
            d = d.join(small(ids.select(F.col("token_id").alias("id")).distinct()), "id", "left_semi")
        for table, key, col in ((self.roots, "root_id", "root"), (self.lemmas, "lemma_id", "lemma"), (self.pos_types, "pos_id", "pos")):
            d = d.join(small(table.select(F.col("id").alias(key), col)), key, "left")
        d = d.join(small(self.feature_sets.select(F.col("id").alias("feature_set_id"), json_strings(F.col("features")).alias("features"))), "feature_set_id", "left")
        d = d.join(small(self.clitic_sets.select(F.col("id").alias("clitic_set_id"), json_clitics(F.col("clitics")).alias("clitics"))), "clitic_set_id", "left")
        return d.select(
            F.col("id").alias("token_id"), "surface", F.coalesce("lemma", F.lit("unknown")).alias("lemma"), "root", F.coalesce("pos", F.lit("UNK")).alias("pos"),
            F.coalesce("features", F.array().cast("array<string>")).alias("features"),
            F.coalesce("clitics", F.array().cast("array<struct<type:string,display:string>>")).alias("clitics"), F.lit(True).alias("defined"),
        )


def _placed() -> list[Column]:
    """What is shown of a definition, or of a missing one."""
    miss = F.col("defined").isNull()
    put = lambda c, v: F.when(miss, F.lit(v)).otherwise(F.col(c)).alias(c)
    return [
        put("surface", "�"), put("lemma", "unknown"), F.col("root"), put("pos", "UNK"), F.coalesce("features", F.array().cast("array<string>")).alias("features"),
        F.coalesce("clitics", F.array().cast("array<struct<type:string,display:string>>")).alias("clitics"),
    ]


def _overlaid(at: DataFrame, definitions: DataFrame) -> DataFrame:
    first, *rest = _placed()
    return at.join(definitions, "token_id", "left").select(*KEY, "idx", first, F.lit(None).cast("string").alias("noclitic_surface"), *rest)


def page_tokens(packed: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Tokens of pages in order; one without a definition keeps its place as a placeholder."""
    definitions = dictionary.resolved()
    if dictionary.definitions.count() <= BROADCAST_ROWS:
        return _overlaid(unpacked(packed), F.broadcast(definitions))
    return _by_block(packed, definitions)


def _by_block(packed: DataFrame, definitions: DataFrame) -> DataFrame:
    """The same where the dictionary is too large to send.

    Pages are coded in blocks of a million tokens; the distinct tokens of a block are
    joined with their definitions, and meet its pages in one task. No token moves by itself.
    """

    def code(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _block_numbers()
        for b in it:
            sizes = pc.fill_null(pc.binary_length(b.column("token_ids")), 0).to_numpy(zero_copy_only=False) // 4
            for s, e in arrow.cuts(sizes, arrow.TOKENS):
                part, block = b.slice(s, e - s), next(number)
                blobs = [x[: len(x) // 4 * 4] for x in part.column("token_ids").to_pylist()]
                coded = pa.array(np.frombuffer(b"".join(blobs), "<u4").astype(np.int64)).dictionary_encode()
                known = len(coded.dictionary)
                yield _rows(shape, known, block=np.full(known, block), code=np.arange(known, dtype=np.int32), token_id=coded.dictionary)
                yield _rows(shape, len(part), block=np.full(len(part), block), codes=_blobs(coded.indices.to_numpy(zero_copy_only=False), sizes[s:e]), **{c: part.column(c) for c in KEY})

    kinds = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in KEY)
    names = ["surface", "lemma", "root", "pos", "features", "clitics"]
    rows = packed.select(*KEY, F.coalesce("token_ids", F.lit(b"")).alias("token_ids"))
    shape = to_arrow_schema(rows.limit(0).select(F.lit(0).cast("bigint").alias("block"), F.lit(0).alias("code"), F.lit(0).cast("bigint").alias("token_id"), *KEY, F.lit(b"").alias("codes")).schema)
    coded = Scratch(packed.sparkSession).write(rows.mapInArrow(code, f"block bigint, code int, token_id bigint, {kinds}, codes binary"), "coded")
    met = coded.where("code is not null").select("block", "code", "token_id").join(definitions, "token_id", "left").select("block", "code", *_placed())
    together = met.unionByName(coded.where("code is null").select("block", "code", *KEY, "codes"), allowMissingColumns=True)

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in _met(it, names):
            n = pc.binary_length(part.column("codes")).to_numpy(zero_copy_only=False) // 4
            at, page = arrow.blob_values(part.column("codes"), "<i4"), np.repeat(np.arange(len(n)), n)
            idx = (np.arange(len(page)) - arrow.starts(n)[page]).astype(np.int32)
            for s in range(0, len(page), ROWS):
                key, token = pa.array(page[s : s + ROWS]), pa.array(at[s : s + ROWS])
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(key) for c in KEY), pa.array(idx[s : s + ROWS]), *(table.column(c).take(token) for c in names)], [*KEY, "idx", *names])

    out = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in names)
    tokens = together.select("block", "code", *KEY, "codes", *names).repartition("block").sortWithinPartitions("block", F.asc_nulls_last("code")).mapInArrow(spread, f"{kinds}, idx int, {out}")
    return tokens.select(*KEY, "idx", "surface", F.lit(None).cast("string").alias("noclitic_surface"), "lemma", "root", "pos", "features", "clitics")


def _block_numbers() -> Iterator[int]:
    from pyspark import TaskContext

    return itertools.count(TaskContext.get().partitionId() << 32)


def _blobs(codes: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The 32-bit numbers of each page as one binary."""
    data = np.ascontiguousarray(codes.astype("<u4"))
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((4 * arrow.starts(counts)).astype(np.int32)), pa.py_buffer(data)])


def _rows(shape: pa.Schema, n: int, **columns: pa.Array | np.ndarray) -> pa.RecordBatch:
    """Rows of a shape, with nulls in the columns that aren't given."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in shape], shape.names)


def _met(it: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """Pages of one block with the table of its codes, from rows where the codes of a block come in order and before its pages."""
    block, parts, table = None, [], None
    for b in it:
        of, page = b.column("block").to_numpy(zero_copy_only=False), b.column("code").is_null().to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (page[1:] != page[:-1])) + 1), len(b)] if len(b) else [0]
        for s, e in zip(edges, edges[1:]):
            run = b.slice(s, e - s)
            if of[s] != block:
                block, parts, table = of[s], [], None
            if not page[s]:
                parts.append(run.select(names))
                continue
            if table is None:
                whole = pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else []
                table = whole[0] if whole else run.slice(0, 0).select(names)
            yield run, table


def tokens_of_page(packed: DataFrame, dictionary: Dictionary, key: tuple[int, int, int]) -> DataFrame:
    """Tokens of one page in order: its row is found first, and only its definitions are resolved."""
    for c, v in zip(KEY, key):
        packed = packed.where(F.col(c) == v)
    at = unpacked(packed.limit(1))
    return _overlaid(at, F.broadcast(dictionary.resolved(at))).orderBy("idx")


def token_at(tokens: DataFrame, key: tuple[int, int, int], idx: int) -> DataFrame:
    cond = [F.col(c) == v for c, v in zip((*KEY, "idx"), (*key, idx))]
    for c in cond:
        tokens = tokens.where(c)
    return tokens.limit(1)


def find_positions(tokens: DataFrame, field: str, value: str) -> DataFrame:
    """Where a token's surface, lemma or root equals the value; a missing root equals nothing."""
    if field not in ("surface", "lemma", "root"):
        raise ValueError(f"unknown field {field!r}")
    return tokens.where(F.col(field) == value).select(*KEY, "idx")


def numbered(rows: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``id`` 1, 2, ... in the order of ``by``, ranked in range partitions and shifted by the sizes of those before."""
    parts = scratch.write(rows.repartitionByRange(*by).withColumn("pid", F.spark_partition_id()), "ranked")
    ahead = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.groupBy("pid").agg(F.count("*").alias("n")).select("pid", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shift"))
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(*by))
    return parts.join(F.broadcast(shift), "pid").select(*rows.columns, (F.col("shift") + rank).alias("id"))


def dictionary_of(tokens: DataFrame) -> tuple[Dictionary, DataFrame]:
    """A dictionary and packed pages from a token table (key, pos, surface, lemma, root); ids follow the sort order."""
    rows = tokens.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", *STREAMS))).alias("t"))
    return dictionary_of_pages(rows.select(*KEY, *[F.col("t")[c].alias(c) for c in STREAMS]))


def dictionary_of_pages(pages: DataFrame) -> tuple[Dictionary, DataFrame]:
    """The same from the token arrays of pages, which are coded in blocks: only the distinct tokens of a block are rows."""
    scratch = Scratch(pages.sparkSession)
    number = lambda rows, *by: scratch.write(numbered(rows, list(by), scratch), "dimension")
    rows = pages.where(F.size("surface") > 0).select(*KEY, *STREAMS)
    shape = to_arrow_schema(rows.select(F.lit(0).cast("bigint").alias("block"), F.lit(0).alias("code"), *[F.lit("").alias(c) for c in STREAMS], *KEY, F.lit(b"").alias("codes")).schema)

    def code(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _block_numbers()
        for b in it:
            for part in arrow.list_slices(b, "surface"):
                block, each = next(blocks), [part.column(c).flatten().dictionary_encode() for c in STREAMS]
                wide = [len(x.dictionary) + 1 for x in each]
                s, l, r = (x.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1 for x in each)
                coded = pa.array((s * wide[1] + l) * wide[2] + r).dictionary_encode()
                rest, r = np.divmod(coded.dictionary.to_numpy(), wide[2])
                s, l = np.divmod(rest, wide[1])
                texts = {c: x.dictionary.take(pa.array(i - 1, mask=i == 0)) for c, x, i in zip(STREAMS, each, (s, l, r))}
                yield _rows(shape, len(s), block=np.full(len(s), block), code=np.arange(len(s), dtype=np.int32), **texts)
                n = pc.list_value_length(part.column("surface")).to_numpy(zero_copy_only=False)
                yield _rows(shape, len(part), block=np.full(len(part), block), codes=_blobs(coded.indices.to_numpy(zero_copy_only=False), n), **{c: part.column(c) for c in KEY})

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in KEY)
    coded = scratch.write(rows.mapInArrow(code, f"block bigint, code int, surface string, lemma string, root string, {kinds}, codes binary"), "coded")
    known = coded.where("code is not null").select("block", "code", *STREAMS)
    spark = pages.sparkSession
    pos = spark.createDataFrame([(1, "noun")], "id bigint, pos string")
    features = spark.createDataFrame([(1, '["s","3"]'), (2, "broken")], "id bigint, features string")
    clitics = spark.createDataFrame([(1, '[{"type":"conj","display":"و"}]'), (2, None)], "id bigint, clitics string")
    d = number(known.select(*STREAMS).distinct(), *STREAMS)
    lemmas, roots = (number(d.where(f"{c} is not null").select(c).distinct(), c) for c in ("lemma", "root"))
    d = d.join(small(lemmas.select("lemma", F.col("id").alias("lemma_id"))), "lemma", "left").join(small(roots.select("root", F.col("id").alias("root_id"))), "root", "left")
    d = d.select("id", "surface", "lemma", "root", "lemma_id", "root_id", F.lit(1).cast("bigint").alias("pos_id"), (1 + F.col("id") % 2).alias("feature_set_id"), (1 + F.col("id") % 3).alias("clitic_set_id"))
    d = scratch.write(d, "definitions")
    named = d.select(F.col("id").alias("token_id"), *[F.col(c).alias(f"d_{c}") for c in STREAMS])
    met = known.join(named, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"d_{c}")) for c in STREAMS])).select("block", "code", "token_id")
    together = met.unionByName(coded.where("code is null").select("block", "code", *KEY, "codes"), allowMissingColumns=True)

    def ids(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in _met(it, ["token_id"]):
            n = pc.binary_length(part.column("codes")).to_numpy(zero_copy_only=False) // 4
            token = table.column("token_id").to_numpy(zero_copy_only=False)[arrow.blob_values(part.column("codes"), "<u4")]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in KEY), _blobs(token, n)], [*KEY, "token_ids"])

    packed = together.repartition("block").sortWithinPartitions("block", F.asc_nulls_last("code")).mapInArrow(ids, f"{kinds}, token_ids binary")
    return Dictionary(d.drop("lemma", "root"), roots, lemmas, pos, features, clitics), packed
