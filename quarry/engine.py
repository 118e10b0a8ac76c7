"""One object for all that can be asked of a corpus: search, pages, tokens, metadata, user tables, exports."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import metadata, store
from quarry.operators import tokens as tok
from quarry.operators.search import Search
from quarry.sources import corpus

SERVER_LIMIT = 100


class Corpus(Search):
    """The entry points of ``Search`` (search, combined, proximity, names, wildcard, page, positions, ...) and these.

    ``tables`` are those of ``corpus.TABLES``; ``user`` is the folder of the store.
    """

    def __init__(self, pages: DataFrame, tables: dict[str, DataFrame], user: str | None = None, max_limit: int | None = None):
        super().__init__(pages, max_limit)
        self.spark: SparkSession = pages.sparkSession
        self.tables = tables
        self._user = user

    @classmethod
    def open(cls, spark: SparkSession, folder: str, user: str | None = None, server: bool = False) -> Corpus:
        """``folder/pages`` and the tables beside it; a server caps the page of results."""
        return cls(corpus.read_pages(spark, f"{folder}/pages"), corpus.read_tables(spark, folder), user, SERVER_LIMIT if server else None)

    @classmethod
    def open_database(cls, spark: SparkSession, pages: str, database: str, user: str | None = None, server: bool = False) -> Corpus:
        """Pages as Parquet, tables from a SQLite file or, by a JDBC address, from another database."""
        read = corpus.read_jdbc if database.startswith("jdbc:") else corpus.read_sqlite
        return cls(corpus.read_pages(spark, pages), read(spark, database), user, SERVER_LIMIT if server else None)

    # Metadata.

    def stats(self) -> DataFrame:
        return metadata.corpus_stats(self.pages, self.tables["books"])

    def books(self) -> DataFrame:
        return metadata.all_books(self.tables["books"])

    def authors(self) -> DataFrame:
        return metadata.in_id_order(self.tables["authors"])

    def genres(self) -> DataFrame:
        return metadata.in_id_order(self.tables["genres"])

    def centuries(self) -> DataFrame:
        return metadata.centuries(self.tables["books"])

    def book(self, book_id: int) -> DataFrame:
        return metadata.get_book(self.tables["books"], book_id)

    def list_books(self, **kw) -> DataFrame:  # noqa: ANN003
        return metadata.list_books(self.tables["books"], **kw)

    def list_books_filtered(self, **kw) -> DataFrame:  # noqa: ANN003
        return metadata.list_books_filtered(self.tables["books"], **kw)

    def search_authors(self, query: str, limit: int = 50) -> DataFrame:
        return metadata.search_authors(self.tables["authors"], self.tables["books"], query, limit)

    def text_selection(self, f: metadata.BookFilter, names: list[str] = ()) -> DataFrame:
        return metadata.text_selection(self.tables["books"], self.tables["authors"], f, self.store.get("collections") if names else None, names)

    def enriched(self, hits: DataFrame) -> DataFrame:
        return metadata.enriched(hits, self.tables["books"], self.tables["authors"], self.tables["genres"])

    # Tokens.

    @cached_property
    def dictionary(self) -> tok.Dictionary:
        return tok.Dictionary(*(self.tables[t] for t in ("token_definitions", "roots", "lemmas", "pos_types", "feature_sets", "clitic_sets")))

    def page_tokens(self, key: tuple[int, int, int]) -> DataFrame:
        return tok.tokens_of_page(self.tables["page_tokens"], self.dictionary, key)

    def token_at(self, key: tuple[int, int, int], idx: int) -> DataFrame:
        return tok.token_at(self.page_tokens(key), key, idx)

    def all_tokens(self) -> DataFrame:
        return tok.page_tokens(self.tables["page_tokens"], self.dictionary)

    # User tables.

    @cached_property
    def store(self) -> store.Store:
        if self._user is None:
            raise ValueError("no folder for user tables was given")
        return store.Store(self.spark, self._user)
