"""Books, authors and genres: list, filter, join, roll up."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.arabic import fold
from quarry.functions.scalars import search_key
from quarry.sources.corpus import BOOK_COLUMNS


def by_death() -> list[Column]:
    return [F.asc_nulls_last("death_ah"), F.asc("id")]


def all_books(books: DataFrame) -> DataFrame:
    return books.select(*BOOK_COLUMNS).orderBy(*by_death())


def list_books(books: DataFrame, genre_id: int | None = None, corpus: str | None = None, century_ah: int | None = None, limit: int = 100, offset: int = 0, sort_by: str = "id") -> DataFrame:
    for c, v in (("genre_id", genre_id), ("corpus", corpus), ("century_ah", century_ah)):
        if v is not None:
            books = books.where(F.col(c) == v)
    return books.select(*BOOK_COLUMNS).orderBy(F.asc_nulls_last(sort_by), "id").offset(offset).limit(limit)


def list_books_filtered(books: DataFrame, death_ah_min: int | None = None, death_ah_max: int | None = None, genre_ids: list[int] = (), limit: int = 10_000, offset: int = 0) -> DataFrame:
    if death_ah_min is not None:
        books = books.where(F.col("death_ah") >= death_ah_min)
    if death_ah_max is not None:
        books = books.where(F.col("death_ah") <= death_ah_max)
    if genre_ids:
        books = books.where(F.col("genre_id").isin(list(genre_ids)))
    return books.select(*BOOK_COLUMNS).orderBy(*by_death()).offset(offset).limit(limit)


def get_book(books: DataFrame, book_id: int) -> DataFrame:
    return books.where(F.col("id") == book_id).select(*BOOK_COLUMNS).limit(1)


def in_id_order(dimension: DataFrame) -> DataFrame:
    return dimension.orderBy("id")


def centuries(books: DataFrame) -> DataFrame:
    return books.where("century_ah is not null").groupBy("century_ah").agg(F.count("*").alias("n_books")).orderBy("century_ah")


def corpus_stats(pages: DataFrame, books: DataFrame) -> DataFrame:
    n = lambda t, name: t.agg(F.count("*").alias(name))
    return n(pages, "n_pages").withColumn("n_books", n(books, "n_books").scalar())


def author_summary(authors: DataFrame, books: DataFrame) -> DataFrame:
    """Every author with the earliest death year of the books (0 if unknown) and their number."""
    per = books.groupBy(F.col("author_id").alias("id")).agg(F.min("death_ah").alias("death_ah"), F.count("*").alias("book_count"))
    return authors.join(per, "id", "left").select("id", "author", F.col("death_ah").alias("known_death"), F.coalesce("death_ah", F.lit(0)).alias("death_ah"), F.coalesce("book_count", F.lit(0)).alias("book_count"))


def search_authors(authors: DataFrame, books: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Authors whose name holds the query; a query of fewer than three bytes finds none."""
    found = authors.where(F.instr(search_key(F.col("author")), fold(query).lower()) > 0) if len(query.encode()) >= 3 else authors.where("false")
    return author_summary(found, books).orderBy(F.asc_nulls_last("known_death"), "id").drop("known_death").limit(limit)


@dataclass
class BookFilter:
    death_min: int | None = None
    death_max: int | None = None
    genre_ids: list[int] = field(default_factory=list)
    text: str = ""


def browse(books: DataFrame, authors: DataFrame, f: BookFilter) -> DataFrame:
    """Books by death year (an unknown one fails a bound), genre, and a part of the title or the author's name."""
    named = books.join(authors.select(F.col("id").alias("author_id"), "author"), "author_id", "left")
    if f.death_min is not None:
        named = named.where(F.col("death_ah") >= f.death_min)
    if f.death_max is not None:
        named = named.where(F.col("death_ah") <= f.death_max)
    if f.genre_ids:
        named = named.where(F.col("genre_id").isin(f.genre_ids))
    q = fold(f.text.strip()).lower()
    if q:
        has = lambda c: F.coalesce(F.instr(search_key(F.col(c)), q) > 0, F.lit(False))
        named = named.where(has("title") | has("author"))
    return named


def plain_search(books: DataFrame, authors: DataFrame, text: str) -> DataFrame:
    """Lower case only, no folding."""
    named = books.join(authors.select(F.col("id").alias("author_id"), "author"), "author_id", "left")
    has = lambda c: F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return named.where(has("title") | has("author")) if text else named


def in_collections(books: DataFrame, collections: DataFrame, names: list[str]) -> DataFrame:
    """Books of any of the named collections."""
    ids = collections.where(F.col("name").isin(names)).select(F.explode("book_ids").alias("id")).distinct()
    return books.join(ids, "id", "left_semi")


def text_selection(books: DataFrame, authors: DataFrame, f: BookFilter, collections: DataFrame | None = None, names: list[str] = ()) -> DataFrame:
    """``browse`` among the books of the named collections, or of all where none is named."""
    return browse(in_collections(books, collections, list(names)) if names else books, authors, f)


def toggled(selection: list[int], ids: list[int]) -> list[int]:
    """The selection with each of ``ids`` put in, or taken out if all of them are in it."""
    have = set(selection)
    return sorted(have - set(ids) if set(ids) <= have else have | set(ids))


def selection_differs(left: DataFrame, right: DataFrame) -> bool:
    """Whether two selections (id) hold different books."""
    return not (left.select("id").exceptAll(right.select("id")).isEmpty() and right.select("id").exceptAll(left.select("id")).isEmpty())


def selected(books: DataFrame, authors: DataFrame, ids: list[int], text: str = "") -> DataFrame:
    chosen = books.sparkSession.createDataFrame([(i,) for i in ids], "id bigint")
    return browse(books.join(chosen, "id", "left_semi"), authors, BookFilter(text=text))


def books_of_author(books: DataFrame, author_id: int | None) -> DataFrame:
    """None stands for the unknown author."""
    return books.where(F.col("author_id").eqNullSafe(F.lit(author_id).cast("bigint")))


def author_rollup(books: DataFrame, authors: DataFrame, genres: DataFrame) -> DataFrame:
    """Per author (-1: unknown): books, pages, genres by name, and the earliest death year of the books; a name that isn't known is ``Unknown``."""
    g = books.join(F.broadcast(genres.select(F.col("id").alias("genre_id"), "genre")), "genre_id", "left")
    per = g.groupBy(F.coalesce("author_id", F.lit(-1)).alias("author_id")).agg(
        F.count("*").alias("n_books"), F.sum(F.coalesce("page_count", F.lit(0))).alias("n_pages"),
        F.concat_ws("; ", F.array_sort(F.collect_set("genre"))).alias("genres"), F.min("death_ah").alias("death_ah"),
    )
    named = per.join(authors.select(F.col("id").alias("author_id"), "author"), "author_id", "left").withColumn("author", F.coalesce("author", F.lit("Unknown")))
    return named.orderBy(F.asc_nulls_last("death_ah"), "author_id")


def enriched(hits: DataFrame, books: DataFrame, authors: DataFrame, genres: DataFrame) -> DataFrame:
    """Hits with title, author and genre; blank where missing."""
    dim = (
        books.select(F.col("id").alias("text_id"), "title", F.col("author_id").alias("_a"), F.col("genre_id").alias("_g"))
        .join(authors.select(F.col("id").alias("_a"), "author"), "_a", "left").join(genres.select(F.col("id").alias("_g"), "genre"), "_g", "left")
    )
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return hits.join(dim, "text_id", "left").select(*hits.columns, blank("title"), blank("author"), blank("genre"))


def collections_table(spark: SparkSession, rows: list[tuple[str, list[int]]]) -> DataFrame:
    return spark.createDataFrame(rows, "name string, book_ids array<bigint>")
