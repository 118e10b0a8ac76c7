"""Search over a term-clustered table of postings, without reading pages that can't match.

``write_term_index`` in ``quarry.sources.corpus`` lays down one row for each term
and page (term, page key, positions), range-partitioned and sorted by term, so
that a lookup is pushed to Parquet and reads the row groups of its terms only.
``write_term_segments`` packs the postings of a block of pages, in groups of
consecutive terms; a lookup unpacks what it needs of the groups of its terms. The
pages of a term come in no order. A
phrase or a pair of near terms joins just those postings by page.
"""

from __future__ import annotations

from functools import reduce

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import corpus

KEY = ["text_id", "part_index", "page_id"]


class TermIndex:
    def __init__(self, postings: DataFrame):
        self.postings = postings
        self.packed = "terms" in postings.columns

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TermIndex:
        return cls(spark.read.parquet(path))

    def term(self, word: str) -> DataFrame:
        """Page key and ``positions`` of a term."""
        if self.packed:
            groups = self.postings.where((F.col("first") <= word) & (F.col("last") >= word))
            return corpus.unpacked(groups, lambda terms: pc.equal(terms, word)).select(*KEY, "positions")
        return self.postings.where(F.col("term") == word).select(*KEY, "positions")

    def _starting(self, start: str, end: str) -> DataFrame:
        least = len(start) + len(end)
        if self.packed:
            groups = self.postings.where((F.col("last") >= start) & ((F.col("first") < start) | F.col("first").startswith(start)))
            fits = lambda terms: pc.and_(pc.starts_with(terms, start), pc.and_(pc.ends_with(terms, end), pc.greater_equal(pc.utf8_length(terms), least)))
            return corpus.unpacked(groups, fits)
        c = F.col("term").startswith(start)
        return self.postings.where(c & F.col("term").endswith(end) & (F.length("term") >= least) if end else c)

    def prefix(self, start: str, end: str = "") -> DataFrame:
        """Of all terms with a start and, for an infix wildcard, an end that doesn't overlap it."""
        found = self._starting(start, end).groupBy(*KEY).agg(F.flatten(F.collect_list("positions")).alias("p"))
        return found.select(*KEY, F.array_sort("p").alias("positions"))

    def phrase(self, words: list[str]) -> DataFrame:
        """Pages where the words follow each other; ``positions`` of all of them."""
        shifted = [self.term(w).select(*KEY, F.transform("positions", _less(i)).alias(f"s{i}")) for i, w in enumerate(words)]
        joined = reduce(lambda a, b: a.join(b, KEY), shifted)
        starts = reduce(F.array_intersect, [F.col(f"s{i}") for i in range(len(words))])
        covered = F.flatten(F.transform(starts, lambda p: F.sequence(p, p + (len(words) - 1))))
        return joined.where(F.size(starts) > 0).select(*KEY, F.array_sort(F.array_distinct(covered)).alias("positions"))

    def near(self, left: str, right: str, distance: int) -> DataFrame:
        """Pages where the terms stand at most ``distance`` apart; ``positions`` of those that do."""
        both = self.term(left).withColumnRenamed("positions", "l").join(self.term(right).withColumnRenamed("positions", "r"), KEY)
        reach = lambda c: F.flatten(F.transform(c, lambda p: F.sequence(p - distance, p + distance)))
        hit = F.array_union(F.array_intersect("l", reach("r")), F.array_intersect("r", reach("l")))
        return both.select(*KEY, F.array_sort(hit).alias("positions")).where(F.size("positions") > 0)

    def frequencies(self) -> DataFrame:
        """``term, n_pages, n``."""
        if self.packed:
            return corpus.counted(self.postings).groupBy("term").agg(F.sum("n_pages").alias("n_pages"), F.sum("n").alias("n"))
        return self.postings.groupBy("term").agg(F.count("*").alias("n_pages"), F.sum(F.size("positions")).alias("n"))


def _less(i: int):  # noqa: ANN202
    return lambda p: p - i


def all_of(parts: list[DataFrame]) -> DataFrame:
    """Pages in every part, with the union of their positions."""
    return _merge(reduce(lambda a, b: a.join(b, KEY), [p.withColumnRenamed("positions", f"p{i}") for i, p in enumerate(parts)]), len(parts))


def any_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))


def _merge(df: DataFrame, n: int) -> DataFrame:
    cols: list[Column] = [F.col(f"p{i}") for i in range(n)]
    return df.select(*KEY, F.array_sort(F.array_distinct(F.concat(*cols))).alias("positions"))
