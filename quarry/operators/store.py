"""Small user tables (history, saved searches, settings, collections) as DataFrames.

The operations are pure: a table in, the changed table out. ``Store`` keeps them
as Parquet, each version in a directory of its own, and moves a pointer once a
version is whole, so that a lost executor or driver leaves the last good one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.workdir import exists, read_text, write_text

HISTORY = "id bigint, search_type string, query_data string, display_label string, book_filter_count bigint, book_ids string, created_at string"
SAVED = "id bigint, history_id bigint, search_type string, query_data string, display_label string, book_filter_count bigint, book_ids string, created_at string"
SETTINGS = "key string, value string"
COLLECTIONS = "id bigint, name string, description string, book_ids array<bigint>, created_at string, updated_at string"
DISMISSED = "id string, dismissed_at string"
KEEP = 100


def newest(table: DataFrame, limit: int) -> DataFrame:
    return table.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def next_id(table: DataFrame) -> int:
    return (table.agg(F.max("id")).first()[0] or 0) + 1


def rotate(history: DataFrame, keep: int = KEEP) -> DataFrame:
    return newest(history, keep)


def add_history(history: DataFrame, new: DataFrame, keep: int = KEEP) -> DataFrame:
    return rotate(history.unionByName(new, allowMissingColumns=True), keep)


def history_with_saved(history: DataFrame, saved: DataFrame, limit: int = KEEP) -> DataFrame:
    mark = saved.select("query_data", F.col("id").alias("saved_id")).dropDuplicates(["query_data"])
    return newest(history, limit).join(mark, "query_data", "left").withColumn("is_saved", F.col("saved_id").isNotNull()).drop("saved_id")


def save_search(saved: DataFrame, new: DataFrame) -> DataFrame:
    """Inserts what has no equal ``query_data`` yet; of equal new ones the smallest id."""
    first = new.groupBy("query_data").agg(F.min_by(F.struct(*new.columns), "id").alias("r")).select("r.*")
    return saved.unionByName(first.join(saved, "query_data", "left_anti").select(*new.columns), allowMissingColumns=True)


def unsave(saved: DataFrame, saved_id: int | None = None, query_data: str | None = None) -> DataFrame:
    if saved_id is not None:
        saved = saved.where(F.col("id") != saved_id)
    return saved.where(F.col("query_data") != query_data) if query_data is not None else saved


def is_saved(saved: DataFrame, query_data: str) -> bool:
    return saved.where(F.col("query_data") == query_data).limit(1).count() > 0


def put_setting(settings: DataFrame, key: str, value: str) -> DataFrame:
    return settings.where(F.col("key") != key).union(settings.sparkSession.createDataFrame([(key, value)], SETTINGS))


def get_setting(settings: DataFrame, key: str) -> str | None:
    row = settings.where(F.col("key") == key).first()
    return row["value"] if row else None


def create_collection(table: DataFrame, name: str, book_ids: list[int], now: str, description: str | None = None) -> DataFrame:
    if table.where(F.col("name") == name).limit(1).count():
        raise ValueError(f"a collection named {name!r} exists")
    row = (next_id(table), name, description[:150] if description is not None else None, list(book_ids), now, now)
    return table.union(table.sparkSession.createDataFrame([row], COLLECTIONS))


def list_collections(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("created_at"), F.desc("id"))


def update_collection(table: DataFrame, collection_id: int, now: str, **changes: object) -> DataFrame:
    """Any of name, description (150 characters) and book_ids."""
    if not table.where(F.col("id") == collection_id).limit(1).count():
        raise KeyError("Collection not found")
    name = changes.get("name")
    if name is not None and table.where((F.col("name") == name) & (F.col("id") != collection_id)).limit(1).count():
        raise ValueError(f"a collection named {name!r} exists")
    this = F.col("id") == collection_id
    for c, v in {**changes, "updated_at": now}.items():
        if c == "book_ids":
            new = F.array(*map(F.lit, v)).cast("array<bigint>")
        else:
            new = F.lit(v[:150] if c == "description" and v is not None else v)
        table = table.withColumn(c, F.when(this, new).otherwise(F.col(c)))
    return table


def delete_collection(table: DataFrame, collection_id: int) -> DataFrame:
    return table.where(F.col("id") != collection_id)


def dismiss(table: DataFrame, ids: list[str], now: str) -> DataFrame:
    new = table.sparkSession.createDataFrame([(i, now) for i in ids], DISMISSED).join(table, "id", "left_anti")
    return table.unionByName(new)


class Store:
    """Versioned Parquet tables under a directory of any file system that Spark writes to."""

    SCHEMAS = {"history": HISTORY, "saved": SAVED, "app_settings": SETTINGS, "user_settings": SETTINGS, "collections": COLLECTIONS, "dismissed": DISMISSED}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _version(self, name: str) -> int:
        at = f"{self.root}/{name}.json"
        return json.loads(read_text(self.spark, at))["version"] if exists(self.spark, at) else 0

    def get(self, name: str) -> DataFrame:
        v = self._version(name)
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(f"{self.root}/{name}-{v}") if v else self.spark.createDataFrame([], self.SCHEMAS[name])

    def put(self, name: str, table: DataFrame) -> None:
        v = self._version(name) + 1
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}-{v}")
        write_text(self.spark, f"{self.root}/{name}.json", json.dumps({"version": v}))

    def clear(self, name: str) -> None:
        self.put(name, self.spark.createDataFrame([], self.SCHEMAS[name]))
