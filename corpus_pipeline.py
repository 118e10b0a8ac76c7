"""From raw documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept. ``documents`` columns run through;
the last stage gives the places of the documents' words in the sequences.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import mixing, near_dedup, packing, quality, suffix_dedup
from quarry.workdir import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the cascade, with toxicity as ``labels`` teach it where that table is there.

    Null and blank texts go; null ids, repeated rows, very long texts and columns
    of other names stay as they are; an empty table stays empty.
    """
    try:
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        labels = None
    return quality.keep_good(docs, labels=labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id.

    Of rows that repeat an id one stays; rows without an id are in no group and
    all stay, as do null and blank texts.
    """
    return near_dedup.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they come first.

    By id, then text, then place. A document of which nothing is left goes; texts
    of fewer words, null texts and rows without an id stay as they are.
    """
    return suffix_dedup.drop_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the curriculum, once for each epoch that reaches them.

    Rows without an id or words are never trained on and go, as do documents that
    the schedule doesn't reach; positions that tie are ordered by id and epoch.
    """
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places in training sequences of 2,048 words; sequences by shard and bin follow the order of the mix.

    Each row that comes in is placed whole, repeated ones too; an empty table gives
    no places.
    """
    return packing.pack_in_order(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Sketches, greedy packing and the epochs of the mix aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.keep_only(kept)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
