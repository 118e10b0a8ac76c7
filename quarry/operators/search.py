"""Search over pages: filter, order by death year, page through, highlight.

The match reads the token string and the key columns only. After the limit the
page of results is joined back to the texts and its positions are computed, so
bodies and arrays of other pages are never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import nodes
from quarry.operators.nodes import Node

KEY = ["text_id", "part_index", "page_id"]
IN_LIST = 1000
#: A page of results in the reader's window, the most that it pages through, and the most that an export holds.
PAGE_SIZE, MAX_RESULTS, EXPORT_MAX_RESULTS = 250, 5000, 2000


@dataclass
class Filters:
    author_id: int | None = None
    genre_id: int | None = None
    death_ah_min: int | None = None
    death_ah_max: int | None = None
    century_ah: int | None = None
    book_ids: list[int] = field(default_factory=list)

    def conditions(self) -> list[Column]:
        out = [F.col(c) == v for c, v in (("author_id", self.author_id), ("genre_id", self.genre_id), ("century_ah", self.century_ah)) if v is not None]
        if self.death_ah_min is not None:
            out.append(F.col("death_ah") >= self.death_ah_min)
        if self.death_ah_max is not None:
            out.append(F.col("death_ah") <= self.death_ah_max)
        if 0 < len(self.book_ids) <= IN_LIST:
            out.append(F.col("text_id").isin(self.book_ids))
        return out

    def apply(self, pages: DataFrame) -> DataFrame:
        for c in self.conditions():
            pages = pages.where(c)
        if len(self.book_ids) > IN_LIST:
            books = pages.sparkSession.createDataFrame([(b,) for b in self.book_ids], "text_id bigint")
            pages = pages.join(books, "text_id", "left_semi")
        return pages


def in_order() -> list[Column]:
    """Ascending death year, unknown first, then the page key."""
    return [F.coalesce("death_ah", F.lit(0)), *map(F.col, KEY)]


def hit_columns(positions: Column) -> list[Column]:
    zero, blank = (lambda c: F.coalesce(c, F.lit(0)).alias(c)), (lambda c: F.coalesce(c, F.lit("")).alias(c))
    return [
        *map(zero, KEY), *map(F.col, ("author_id", "genre_id", "death_ah", "century_ah")), *map(blank, ("part_label", "page_number", "body")),
        F.lit(0.0).cast("float").alias("score"), positions.alias("matched_token_indices"),
    ]


class Search:
    """The search entry points over one table of pages."""

    def __init__(self, pages: DataFrame, max_limit: int | None = None):
        self.pages = pages
        self.max_limit = max_limit

    def matching(self, node: Node, filters: Filters | None = None) -> DataFrame:
        # Cheap column filters first: conjuncts run in the order given, and these reach the scan.
        rows = (filters or Filters()).apply(self.pages)
        return rows.where(node.matches())

    def total(self, node: Node, filters: Filters | None = None) -> DataFrame:
        return self.matching(node, filters).agg(F.count("*").alias("total_hits"))

    def keys(self, node: Node, filters: Filters | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        limit = min(limit, self.max_limit) if self.max_limit else limit
        return self.matching(node, filters).select(*KEY, "death_ah").orderBy(*in_order()).offset(offset).limit(limit)

    def hits(self, node: Node, filters: Filters | None = None, limit: int = 50, offset: int = 0, cap: int | None = None, light: Node | None = None) -> DataFrame:
        """One page of results with at most ``cap`` positions each; ``light`` highlights another node than matched."""
        page = self.keys(node, filters, limit, offset).select(*KEY)
        full = self.pages.join(F.broadcast(page) if limit <= 10_000 else page, KEY)
        where = (light or node).positions()
        return full.select(*hit_columns(F.slice(where, 1, cap) if cap else where)).orderBy(*in_order())

    def search(self, query: str, mode: str = "lemma", **kw) -> DataFrame:  # noqa: ANN003
        return self.hits(nodes.term(query, mode), **kw)

    def combined(self, and_terms: list, or_terms: list = (), **kw) -> DataFrame:  # noqa: ANN003
        return self.hits(nodes.combined(and_terms, or_terms), **kw)

    def proximity(self, left: tuple[str, str], right: tuple[str, str], distance: int, **kw) -> DataFrame:  # noqa: ANN003
        return self.hits(nodes.near(left, right, distance), **{"cap": 50} | kw)

    def wildcard(self, query: str, **kw) -> DataFrame:  # noqa: ANN003
        return self.hits(nodes.wildcard(query), **kw)

    def names(self, forms: list[list[str]], first_form_only: bool = True, **kw) -> DataFrame:  # noqa: ANN003
        """Only the first form is highlighted unless asked otherwise."""
        return self.hits(nodes.names(forms), light=nodes.names(forms[:1]) if first_form_only else None, **kw)

    def with_total(self, node: Node, filters: Filters | None = None, limit: int = 50) -> DataFrame:
        """Page keys and, on each row, the number of all matches: a count and a top-k, which both combine before they shuffle."""
        return self.keys(node, filters, limit).withColumn("total_hits", self.total(node, filters).scalar())

    def load_more(self, node: Node, filters: Filters | None = None, shown: int = 0) -> DataFrame:
        """The next page after ``shown`` results, none beyond ``MAX_RESULTS``."""
        return self.hits(node, filters, max(0, min(PAGE_SIZE, MAX_RESULTS - shown)), shown)

    def for_export(self, node: Node, filters: Filters | None = None) -> DataFrame:
        """The same search again, from its start, with as many results as an export holds."""
        return self.hits(node, filters, EXPORT_MAX_RESULTS)

    # One page by its key.

    def page(self, text_id: int, part_index: int, page_id: int, positions: Column | None = None) -> DataFrame:
        at = (F.col("text_id") == text_id) & (F.col("part_index") == part_index) & (F.col("page_id") == page_id)
        return self.pages.where(at).limit(1).select(*hit_columns(positions if positions is not None else F.array().cast("array<int>")))

    def neighbours(self, text_id: int, part_index: int, page_id: int) -> DataFrame:
        """The pages before and after in the same part; there is none below 1."""
        near = [p for p in (page_id - 1, page_id + 1) if p >= 1]
        return self.pages.where((F.col("text_id") == text_id) & (F.col("part_index") == part_index) & F.col("page_id").isin(near)).select(*KEY)

    def page_with_matches(self, key: tuple[int, int, int], query: str, mode: str, cap: int | None = None) -> DataFrame:
        where = nodes.term(query, mode).positions()
        return self.page(*key, F.slice(where, 1, cap) if cap else where)

    def positions(self, key: tuple[int, int, int], query: str, mode: str, cap: int | None = None) -> DataFrame:
        return self.page_with_matches(key, query, mode, cap).select("matched_token_indices")

    def positions_combined(self, key: tuple[int, int, int], terms: list[tuple[str, str]], cap: int | None = None) -> DataFrame:
        each = [nodes.term(*t).positions() for t in terms]
        each = [F.slice(e, 1, cap) for e in each] if cap else each
        return self.page(*key, nodes._union(each)).select("matched_token_indices")

    def positions_multi(self, key: tuple[int, int, int], terms: list[tuple[str, str]], cap: int = 100) -> DataFrame:
        each = F.array(*[F.slice(nodes.term(*t).positions(), 1, cap) for t in terms])
        return self.page(*key, each).select("matched_token_indices")

    def positions_names(self, key: tuple[int, int, int], patterns: list[str], cap: int = 50) -> DataFrame:
        return self.page(*key, F.slice(nodes.names([patterns]).positions(), 1, cap)).select("matched_token_indices")

    def positions_wildcard(self, key: tuple[int, int, int], query: str, cap: int = 20) -> DataFrame:
        return self.page(*key, F.slice(nodes.wildcard(query).positions(), 1, cap)).select("matched_token_indices")
