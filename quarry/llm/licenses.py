"""License scans by diagonal voting.

All rolling ``k``-word gram hashes of every document are joined, in Spark, to the
grams of the license templates. A hit of document position p and template
position q votes for the diagonal p - q, where an unbroken copy puts all its
votes. Diagonals of one template that lie within its slack are merged, since a
word put in or left out moves the rest of a copy to the next one. A merged span
is verified by the words that its grams prove equal: they must make up ``least`` of
the template and of the span, and the words that tell a version or a variant from
others (``license_texts.telling``) must all be among them. Where verified spans of
several templates overlap, the best stays: the one with more proved words, then the
larger share of its template, then the name that comes first; a span goes if any
better one overlaps it. Words that a text puts between those of a template aren't
read, so a variant that no template covers can be taken for the one that it extends.

The grams of the templates are sent to all tasks while they are fewer than
``broadcast_grams``, beyond which the join shuffles.

Edge cases: null, empty and short texts have no grams; null ids are left out;
rows that repeat an id vote as one document; very long texts are processed in
whole, in slices of rows; an empty table, or no templates, give no spans. Only
``doc_id`` (bigint) and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.license_texts import TEMPLATES, telling
from quarry.llm.wordhash import PUNCTUATION, batches, grams, words_of

@dataclass(frozen=True)
class Params:
    k: int = 3
    least: float = 0.8
    broadcast_grams: int = 1_000_000


def gram_table(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, at, gram`` of all rolling word k-grams."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 1, 2 << 20):
            w = words_of(b.column(1), space=PUNCTUATION)
            if len(w.hash) < k:
                continue
            # Over the whole slice at once; the grams that cross into the next document go.
            g = grams(w.hash, k)
            inside = w.doc[: len(g)] == w.doc[k - 1 :]
            d = w.doc[: len(g)][inside]
            at = (np.arange(len(g))[inside] - w.first[d]).astype(np.int32)
            ids = b.column(0).take(pa.array(d))
            yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(g[inside].view(np.int64))], ["doc_id", "at", "gram"])

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return rows.mapInArrow(run, "doc_id bigint, at int, gram bigint")


def template_table(spark: SparkSession, templates: dict[str, str], k: int) -> tuple[DataFrame, DataFrame, int]:
    """``license, size, t_at, gram``; ``license, must``, the positions of its telling words; and the number of grams."""
    rows, must = [], []
    for name, text in templates.items():
        w = words_of(pa.array([text]), space=PUNCTUATION)
        data = w.data.tobytes()
        must.append((name, telling([data[s:e].decode() for s, e in zip(w.start, w.end)])))
        rows += [(name, len(w.hash), i, int(g)) for i, g in enumerate(grams(w.hash, k).view(np.int64).tolist())]
    return spark.createDataFrame(rows, "license string, size int, t_at int, gram bigint"), spark.createDataFrame(must, "license string, must array<int>"), len(rows)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, p: Params = Params()) -> DataFrame:
    """``doc_id, license, start_word, end_word, matched, template_words`` of the verified spans, end exclusive."""
    table, must, n = template_table(docs.sparkSession, TEMPLATES if templates is None else templates, p.k)
    if n <= p.broadcast_grams:
        table, must = F.broadcast(table), F.broadcast(must)
    hits = gram_table(docs, p.k).join(table, "gram").select("doc_id", "license", "size", (F.col("at") - F.col("t_at")).alias("diagonal"), "t_at")
    votes = hits.groupBy("doc_id", "license", "size", "diagonal").agg(F.collect_set("t_at").alias("ts"))
    along = Window.partitionBy("doc_id", "license").orderBy("diagonal")
    slack = F.greatest(F.lit(1), F.least(F.lit(8), F.floor(F.col("size") / 4)))
    step = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= slack, 0).otherwise(1)
    merged = votes.withColumn("step", step).withColumn("span", F.sum("step").over(along))
    run = lambda start: F.sequence(start, start + (p.k - 1))
    in_template = F.flatten(F.transform("ts", run))
    in_doc = F.flatten(F.transform("ts", lambda t: run(t + F.col("diagonal"))))
    spans = merged.groupBy("doc_id", "license", "size", "span").agg(
        F.array_distinct(F.flatten(F.collect_list(in_template))).alias("in_template"), F.array_distinct(F.flatten(F.collect_list(in_doc))).alias("at")
    )
    spans = spans.withColumn("matched", F.size("in_template")).withColumn("start_word", F.array_min("at")).withColumn("end_word", F.array_max("at") + 1)
    proved = (F.col("matched") >= p.least * F.col("size")) & (F.size("at") >= p.least * (F.col("end_word") - F.col("start_word")))
    told = spans.where(proved).join(must, "license").where(F.size(F.array_except("must", "in_template")) == 0)
    long = lambda c: F.col(c).cast("bigint").alias(c)
    return best(told.select("doc_id", "license", long("start_word"), long("end_word"), long("matched"), F.col("size").cast("bigint").alias("template_words")))


def best(spans: DataFrame) -> DataFrame:
    """Without the spans that a better one overlaps; only spans that hang together by overlaps are compared."""
    by = Window.partitionBy("doc_id").orderBy("start_word", "end_word", "license")
    last = F.max("end_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(F.col("start_word") < last, 0).otherwise(1)).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    # Compared as structs: more words, then the larger share, then the name. All islands are a few license texts long.
    row = F.struct("start_word", "end_word", (-F.col("matched")).alias("m"), (-F.col("matched") / F.col("template_words")).alias("share"), "license", "matched", "template_words")
    rank = lambda x: F.struct(x["m"], x["share"], x["license"], x["start_word"])
    better = lambda x, y: (y["start_word"] < x["end_word"]) & (x["start_word"] < y["end_word"]) & (rank(y) < rank(x))
    kept = F.filter("all", lambda x: ~F.exists("all", lambda y: better(x, y)))
    out = islands.groupBy("doc_id", "island").agg(F.collect_list(row).alias("all")).select("doc_id", F.explode(kept).alias("s"))
    return out.select("doc_id", "s.license", "s.start_word", "s.end_word", "s.matched", "s.template_words")
