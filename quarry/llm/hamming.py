"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is cut into four segments of 16, each with an index from its
value to the codes that have it. Around a query the search radius grows segment
by segment: once all four segments have been probed to radius r, every code
within 4 r + 3 bits has been met, since a code at distance d has a segment that
differs in at most d // 4 bits; after the first j of the next round, within
4 (r + 1) + j - 1. A query ends as soon as its kth smallest distance, computed on
the full codes, is covered so. The result is exact, ties by the smaller id.

A stated set of rows asks, all rows answer. The codes are cut into shards of bounded
size, and a task builds the indexes of its shard once and streams the queries past
them, however many they are; the k best of all shards merge. Each query visits every
shard. Only where there are fewer shards than ``tasks`` are shards copied, so that
several tasks share the queries. No table is broadcast.

Codes are the signs of the first 64 components: bit i is set if component i > 0.

Edge cases: null ids and null embeddings are left out; a null component counts as
not positive, and missing ones too; rows that repeat an id count as one, with the
smallest code; equal codes are at distance 0; with fewer than k other rows all of
them are returned; an empty table gives an empty result. Only ``vec_id`` (bigint)
and ``embedding`` are read, and columns of other names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.workdir import Scratch

SEGMENTS, BITS = 4, 16
MASKS = [np.array([reduce(lambda a, i: a | 1 << i, c, 0) for c in combinations(range(BITS), r)], dtype=np.int64) for r in range(BITS + 1)]


class Index:
    """The four segment indexes over the codes of a shard."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.codes = ids[order], codes[order]
        self.tables = []
        for s in range(SEGMENTS):
            v = self.segment(self.codes, s)
            by = np.argsort(v, kind="stable")
            self.tables.append((by, np.searchsorted(v[by], np.arange((1 << BITS) + 1))))

    @staticmethod
    def segment(codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(BITS * s)) & np.uint64((1 << BITS) - 1)).astype(np.int64)

    def search(self, query: int, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest codes other than ``own``, by distance, then id."""
        q = np.uint64(query)
        seen = np.zeros(len(self.ids), dtype=bool)
        seen[np.searchsorted(self.ids, own, "left") : np.searchsorted(self.ids, own, "right")] = True
        left = int(len(seen) - seen.sum())
        found, dists, within = [], [], np.zeros(65, dtype=np.int64)
        for r in range(BITS + 1):
            for s, (by, start) in enumerate(self.tables):
                v = int(self.segment(np.array([q]), s)[0]) ^ MASKS[r]
                lo, n = start[v], start[v + 1] - start[v]
                some = n > 0
                lo, n = lo[some], n[some]
                at = by[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
                at = at[~seen[at]]
                seen[at] = True
                d = np.bitwise_count(self.codes[at] ^ q)
                found.append(at)
                dists.append(d)
                within += np.bincount(d, minlength=65)
                left -= len(at)
                if within[: SEGMENTS * r + s + 1].sum() >= k or not left:
                    at, d = np.concatenate(found), np.concatenate(dists)
                    best = np.lexsort((self.ids[at], d))[:k]
                    return self.ids[at[best]], d[best].astype(np.int32)
        raise AssertionError("every code lies within the last radius")


def codes_of(embeddings: DataFrame) -> DataFrame:
    """``vec_id, code``."""
    bits = F.transform(F.slice("embedding", 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    code = F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
    rows = embeddings.where("vec_id is not null and embedding is not null").select("vec_id", code.alias("code"))
    return rows.groupBy("vec_id").agg(F.min("code").alias("code"))


def nearest(embeddings: DataFrame, k: int = 10, shard_rows: int = 65_536, asks: Column | None = None, tasks: int = 24) -> DataFrame:
    """``query_id, neighbor_id, distance, rank`` with the k nearest other codes of every row, or of the rows that meet ``asks`` (a condition on ``vec_id``)."""
    spark = embeddings.sparkSession
    codes = Scratch(spark).write(codes_of(embeddings), "codes")
    shards = max(1, -(-codes.count() // shard_rows))
    copies = max(1, -(-tasks // shards))
    h = F.xxhash64("vec_id")
    upto = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    answers = codes.select(F.pmod(h, F.lit(shards)).alias("shard"), upto(copies).alias("copy"), F.lit(False).alias("asks"), "vec_id", "code")
    queries = codes.where(asks) if asks is not None else codes
    queries = queries.select(upto(shards).alias("shard"), F.pmod(F.shiftrightunsigned(h, 20), F.lit(copies)).alias("copy"), F.lit(True).alias("asks"), "vec_id", "code")
    rows = answers.unionByName(queries).repartition(shards * copies, "shard", "copy").sortWithinPartitions("shard", "copy", "asks")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index, ids, values = None, None, [], []
        for b in it:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            shard, copy, query = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            vec, code = b.column(3).to_numpy(), b.column(4).to_numpy().view(np.uint64)
            # Runs of one shard and kind.
            edge = np.flatnonzero((np.diff(shard, prepend=-1) != 0) | (np.diff(copy, prepend=-1) != 0) | (np.diff(query.astype(np.int8), prepend=2) != 0))
            for at, upto_ in zip(edge, [*edge[1:], b.num_rows]):
                if (shard[at], copy[at]) != last:
                    last, index, ids, values = (shard[at], copy[at]), None, [], []
                if not query[at]:
                    ids.append(vec[at:upto_].copy())
                    values.append(code[at:upto_].copy())
                    continue
                if index is None:
                    index = Index(np.concatenate(ids or [np.zeros(0, np.int64)]), np.concatenate(values or [np.zeros(0, np.uint64)]))
                for own, c in zip(vec[at:upto_].tolist(), code[at:upto_].tolist()):
                    found, d = index.search(c, own, k)
                    out.append((np.full(len(found), own, np.int64), found, d))
            columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32))], ["query_id", "neighbor_id", "distance"])

    found = rows.mapInArrow(run, "query_id bigint, neighbor_id bigint, distance int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
