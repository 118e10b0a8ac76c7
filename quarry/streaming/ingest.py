"""Standing queries: pages that arrive as files are matched by the same nodes as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.nodes import Node
from quarry.operators.search import Filters, hit_columns
from quarry.sources.corpus import with_streams, with_strings

PAGES = (
    "text_id bigint, part_index bigint, page_id bigint, author_id bigint, genre_id bigint, death_ah bigint, century_ah bigint, part_label string, "
    "page_number string, body string, surface array<string>, lemma array<string>, root array<string>"
)


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return with_strings(spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def stored_stream(spark: SparkSession, stored: DataFrame, files_per_trigger: int = 100) -> DataFrame:
    """The same of pages that ``Scratch`` wrote with their surface string only."""
    return with_streams(spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(stored._scratch_path))


def standing_query(pages: DataFrame, node: Node, filters: Filters | None = None) -> DataFrame:
    """Hits as pages arrive; no state is kept, so there is nothing to expire."""
    return (filters or Filters()).apply(pages).where(node.matches()).select(*hit_columns(node.positions()))


def to_parquet(hits: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return hits.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
