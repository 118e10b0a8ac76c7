"""Removal of long repeated passages by a logarithmic family of suffix arrays.

A suffix array here is the sorted table of suffixes, each with the document and
word position where it starts. Suffixes are ordered by a 64-bit fingerprint of
their first ``min_words`` words and not by spelling: all that the scans ask of the
order is that suffixes which agree on ``min_words`` words or more meet. A longer
match shows as matches of suffixes that follow each other, and is put together
from them (``spans``).

The family (``SuffixIndex``): a new batch's array is merge-scanned against every
level; a suffix found there repeats an earlier passage. What is left after that is
new and becomes a level; two levels of equal rank merge into one of the next rank,
so that each suffix is rewritten at most log2(batches) times. Arrays are tables
bucketed and sorted by fingerprint, so that scans and merges join them bucket by
bucket, without moving a level again. A level holds the first place of each passage
only, so copies don't make it grow, and equal prints are reduced before they are
shuffled. ``SuffixIndex.open`` takes up the levels of an earlier run from their
folder and ``add_documents`` a further batch; there all suffixes are kept.

For a corpus that is known as a whole (``spans``) most suffixes needn't enter.
A passage of ``min_words`` words holds at least one *anchor*, a run of ``min_words
+ 1 - window`` words whose hash is the smallest among ``window`` neighbours, and
the passages with a given anchor lie in its *context*, ``window - 1`` words to
either side. So a passage comes twice only if

* its anchor's whole context comes twice: then all passages of the later context
  repeat those of the first, as one run; or
* its anchor comes in several contexts: then the suffixes of the first place of
  each such context enter the family, in batches of ascending ids.

Both together are exact: no repeated suffix is lost, and none is found that isn't
one. The earliest occurrence, by id and position, stays. Hot anchors and passages
never meet in one task as a group: groups are counted by aggregates that combine
before the shuffle, and joined back by joins that adaptive execution can split.

Edge cases: null or blank texts, texts of fewer than ``min_words`` words and null
ids have no suffixes; rows that repeat id and text count as one document, and each
is cut; rows that repeat an id with other texts are documents of their own, ordered
by a fingerprint of the text; a passage repeated within one document is found too;
very long texts are processed whole, one at a time; an empty table gives no spans.
Only ``doc_id`` and ``text`` are read; columns of any other name pass through
``drop_repeats`` unchanged, but ``n_chars`` follows the text.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.wordhash import U64, batches, mix, powers, words_of
from quarry.workdir import Scratch, read_text, write_text


@dataclass(frozen=True)
class Params:
    min_words: int = 50
    window: int = 25
    batches: int = 4
    #: Ids of a list that may be sent to all tasks, so that no other text moves.
    broadcast_ids: int = 1_000_000


#: Rows of the Arrow batches that Python returns.
ROWS = 1 << 16
SUFFIX = "print bigint, doc_id bigint, f bigint, at int"


def prefix_sums(h: np.ndarray) -> np.ndarray:
    """Of h[i] * BASE^i, from which any run of words has its fingerprint in one step."""
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(len(h) + 1)[0][: len(h)], out=total[1:])
    return total


def prints(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * powers(len(total))[1][start])


def sliding(op: np.ufunc, v: np.ndarray, window: int) -> np.ndarray:
    """op over all runs of ``window`` values, by doubling."""
    size, have = 1, v
    while size * 2 <= window:
        have = op(have[:-size], have[size:])
        size *= 2
    return op(have[: len(v) - window + 1], have[window - size : window - size + len(v) - window + 1])


def anchors(h: np.ndarray, first: np.ndarray, doc: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
    """Of the documents whose words lie one after the other in ``h``: key, context, document, and first passage and number of passages of each anchor."""
    k, w = p.min_words + 1 - p.window, p.window
    if len(h) < p.min_words:
        return (np.zeros(0, U64), np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3)))
    total = prefix_sums(h)
    n = np.arange(len(h) - k + 1)
    g = prints(total, n, n + k)
    low = sliding(np.minimum, g, w)
    # Passages that cross into the next document aren't any.
    low[doc[: len(low)] != doc[p.min_words - 1 :]] = 0
    edge = np.zeros(w - 1, U64)
    at = np.flatnonzero((g == sliding(np.maximum, np.concatenate([edge, low, edge]), w)) & (g > 0))
    key, d = g[at], doc[at]
    left, right = np.maximum(first[d], at - (w - 1)), np.minimum(first[d + 1], at + k + w - 1)
    context = mix(prints(total, left, right) + U64(w) * (right - left).astype(U64) + (at - left).astype(U64))
    # The passages that hold the anchor and nothing smaller are neighbours.
    passages = at[:, None] - np.arange(w - 1, -1, -1)
    own = (low[np.clip(passages, 0, len(low) - 1)] == key[:, None]) & (passages >= 0) & (passages < len(low))
    own &= doc[np.clip(passages, 0, len(h) - 1)] == d[:, None]
    return key, context, d, at - (w - 1) + own.argmax(axis=1) - first[d], own.sum(axis=1)


def _sent(names: list[str], columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names)
    for at in range(0, whole.num_rows, ROWS):
        yield whole.slice(at, ROWS)


def _repeats(docs: DataFrame) -> bool:
    """Whether an id comes more than once."""
    return docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def fingerprint(text: str | Column, repeats: bool) -> Column:
    """Tells apart the texts of an id; where no id repeats the id does that alone."""
    return F.xxhash64(text) if repeats else F.lit(0).cast("bigint")


def _texts(docs: DataFrame, repeats: bool) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select("doc_id", fingerprint("text", repeats).alias("f"), "text")


def anchor_table(texts: DataFrame, p: Params) -> DataFrame:
    """``key, ctx, doc_id, f, at, n``: the anchors with their contexts and runs of passages."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 2):
            w = words_of(b.column(2))
            key, context, d, at, n = anchors(w.hash, w.first, w.doc, p)
            columns = [pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), *(b.column(i).take(pa.array(d)) for i in (0, 1)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int16))]
            yield from _sent(["key", "ctx", "doc_id", "f", "at", "n"], columns)

    return texts.mapInArrow(run, "key bigint, ctx bigint, doc_id bigint, f bigint, at int, n smallint")


def suffix_table(texts: DataFrame, p: Params, runs: DataFrame | None = None) -> DataFrame:
    """``print, doc_id, f, at`` of the suffixes in ``runs`` (doc_id, f, runs of (at, n)), or of all."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 2):
            w = words_of(b.column(2))
            total = prefix_sums(w.hash)
            if b.num_columns > 3:
                lists = b.column(3)
                flat = lists.flatten()
                at, n = flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(np.int64)
                d = np.repeat(np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy())), n)
                start = np.repeat(at.astype(np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + w.first[d]
                # Runs of one document may overlap.
                start = np.unique(start)
                d = w.doc[start]
            else:
                start = np.arange(max(0, len(w.hash) - p.min_words + 1))
                start = start[w.doc[start] == w.doc[start + p.min_words - 1]]
                d = w.doc[start]
            columns = [pa.array(prints(total, start, start + p.min_words).view(np.int64)), *(b.column(i).take(pa.array(d)) for i in (0, 1)), pa.array((start - w.first[d]).astype(np.int32))]
            yield from _sent(["print", "doc_id", "f", "at"], columns)

    if runs is not None:
        # The texts move: hints keep a small list of runs from being sent to every task by its estimated size alone.
        texts = texts.join(runs.hint("merge"), ["doc_id", "f"]).select("doc_id", "f", "text", "runs")
    return texts.mapInArrow(run, SUFFIX)


class SuffixIndex:
    """The levels: (rank, table of ``print, doc_id, f, at``), newest last, their passages all distinct.

    Lies in ``folder``; its state is written last, so that a run that was lost
    leaves the state before it. The batch that comes first counts as the earlier,
    whatever its ids.
    """

    PLACE = ("doc_id", "f", "at")

    def __init__(self, spark: SparkSession, folder: str, p: Params = Params(), buckets: int | None = None):
        self.spark, self.folder, self.p = spark, folder.rstrip("/"), p
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.scratch = Scratch(spark, self.folder)
        self.levels: list[tuple[int, DataFrame]] = []
        self.names: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SuffixIndex:
        """The index of an earlier run."""
        state = json.loads(read_text(spark, f"{folder.rstrip('/')}/index.json"))
        index = cls(spark, folder, Params(state["min_words"]), state["buckets"])
        index.levels = [(rank, index._table(path)) for rank, path in state["levels"]]
        return index

    def save(self) -> None:
        state = {"min_words": self.p.min_words, "buckets": self.buckets, "levels": [(rank, t._scratch_path) for rank, t in self.levels]}
        write_text(self.spark, f"{self.folder}/index.json", json.dumps(state))

    def _table(self, path: str, columns: str = SUFFIX) -> DataFrame:
        """A bucketed table that lies at ``path``; the catalogue only tells Spark of its buckets."""
        name = f"quarry_{uuid.uuid4().hex}"
        self.names.append(name)
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (print) SORTED BY (print) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        out = self.spark.table(name)
        out._scratch_path = path
        return out

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        path, table = self.scratch.path(name), f"quarry_{uuid.uuid4().hex}"
        self.names.append(table)
        rows.repartition(self.buckets, "print").write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(self.buckets, "print").sortBy("print").saveAsTable(table)
        out = self.spark.table(table)
        out._scratch_path = path
        return out

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Takes in a batch; returns ``doc_id, f, at, src_doc, src_f, src_at`` of its suffixes that repeat an earlier one, of the batch or a level."""
        place = F.struct(*self.PLACE)
        reduced = suffixes.groupBy("print").agg(F.min(place).alias("first"), (F.count("*") > 1).alias("again"))
        # The batch's array goes bucket by bucket past each level.
        scan, known = reduced.select("print", "first.*", "again"), []
        for i, (_, level) in enumerate(self.levels):
            scan = scan.join(level.select("print", place.alias(f"old{i}")).hint("merge"), "print", "left")
            known.append(F.col(f"old{i}"))
        old = F.coalesce(*known) if known else F.lit(None).cast("struct<doc_id:bigint,f:bigint,at:int>")
        scanned = self._write(scan.select("print", *self.PLACE, "again", old.alias("known")), "scanned")
        plain = self.spark.read.schema(scanned.schema).parquet(scanned._scratch_path)
        source = plain.where("again or known is not null").select("print", F.coalesce("known", place).alias("src"))
        source = source.select("print", F.col("src.doc_id").alias("src_doc"), F.col("src.f").alias("src_f"), F.col("src.at").alias("src_at"))
        # A hot print has one source and many suffixes, which adaptive execution can split.
        itself = (F.col("doc_id") == F.col("src_doc")) & (F.col("f") == F.col("src_f")) & (F.col("at") == F.col("src_at"))
        found = suffixes.join(source.hint("merge"), "print").where(~itself).select(*self.PLACE, "src_doc", "src_f", "src_at")
        found = self.scratch.write(found, "matches")
        rank, fresh, used = 0, scanned.where("known is null").select("print", *self.PLACE), []
        while self.levels and self.levels[-1][0] == rank:
            _, other = self.levels.pop()
            both = fresh.select("print", place.alias("x")).join(other.select("print", place.alias("y")).hint("merge"), "print", "full")
            fresh, rank = both.select("print", F.coalesce("x", "y").alias("z")).select("print", "z.*"), rank + 1
            used.append(other)
        self.levels.append((rank, self._write(fresh, "level")))
        self.scratch.drop(scanned)
        self.used = used
        return found

    def add_documents(self, docs: DataFrame) -> DataFrame:
        """``add`` for all suffixes of ``docs``, and the state is saved."""
        texts = _texts(docs, _repeats(docs))
        found = self.add(self.scratch.write(suffix_table(texts, self.p), "suffixes"))
        self.save()
        self.drop_merged()
        return found

    def drop_merged(self) -> None:
        """The levels that went into the last merge."""
        self.scratch.drop(*self.used)

    def close(self) -> None:
        """Takes the tables out of the catalogue; the files stay."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []


def matches(docs: DataFrame, p: Params, scratch: Scratch, repeats: bool) -> tuple[DataFrame, DataFrame]:
    """Runs of passages that repeat a context, and single passages that repeat another: ``doc_id, f, at, n, src_doc, src_f, src_at``.

    The sources of the second are first occurrences; those of the first may be among the second themselves.
    """
    texts = _texts(docs, repeats)
    all_anchors = scratch.write(anchor_table(texts, p), "anchors")
    count = lambda t, *by: t.groupBy(*by).agg(F.count("*").alias("c")).where("c > 1").select(*by)
    # Written first, so that the join reads two plain shuffles, which adaptive execution can split where a key is hot.
    keys = scratch.write(count(all_anchors, "key"), "keys")
    again = scratch.write(all_anchors.join(keys.hint("merge"), "key", "left_semi"), "again")
    scratch.drop(all_anchors, keys)
    contexts = again.groupBy("key", "ctx").agg(F.min(F.struct("doc_id", "f", "at", "n")).alias("first"), F.count("*").alias("c"))
    contexts = scratch.write(contexts.select("key", "ctx", "first.*", "c"), "contexts")
    copied = contexts.where("c > 1").select("key", "ctx", F.col("doc_id").alias("src_doc"), F.col("f").alias("src_f"), F.col("at").alias("src_at"))
    itself = (F.col("doc_id") == F.col("src_doc")) & (F.col("f") == F.col("src_f")) & (F.col("at") == F.col("src_at"))
    place = ("doc_id", "f", "at", "n", "src_doc", "src_f", "src_at")
    runs = scratch.write(again.join(copied.hint("merge"), ["key", "ctx"]).where(~itself).select(*place), "runs")
    contested = scratch.write(count(contexts, "key"), "contested")
    firsts = contexts.join(contested.hint("merge"), "key", "left_semi").groupBy("doc_id", "f").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    firsts = scratch.write(firsts, "firsts")
    shares = [i / p.batches for i in range(1, p.batches)]
    bounds = firsts.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] if shares else []
    if firsts.count() <= p.broadcast_ids:
        texts = texts.join(F.broadcast(firsts.select("doc_id").distinct()), "doc_id", "left_semi").select(*texts.columns)
    suffixes = scratch.write(suffix_table(texts, p, firsts), "suffixes")
    scratch.drop(again, contexts, contested, firsts)
    index, points = SuffixIndex(docs.sparkSession, scratch.path("index"), p), []
    try:
        low = F.lit(True)
        for x in (*sorted({int(x) for x in bounds or []}), None):
            points.append(index.add(suffixes.where(low & (F.col("doc_id") <= x if x is not None else F.lit(True)))))
            index.drop_merged()
            low = F.col("doc_id") > x if x is not None else low
        found = points[0]
        for m in points[1:]:
            found = found.unionByName(m)
        found = found.withColumn("n", F.lit(1).cast("smallint")).select(*place)
        if repeats:
            # Rows that repeat id and text give the same suffixes.
            found = scratch.write(found.distinct(), "points")
            scratch.drop(*points)
        scratch.drop(suffixes, *[level for _, level in index.levels])
        scratch.tables += points
    finally:
        index.close()
    return runs, found


def joined(runs: DataFrame, p: Params) -> DataFrame:
    """``doc_id, f, start_word, end_word, src``: the maximal runs of repeated words, with the source of the first passage."""
    ahead = Window.partitionBy("doc_id", "f").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id", "f").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.col("at") + F.col("n") - 1).over(ahead)
    rows = runs.withColumn("new", F.when(F.col("at") <= last + p.min_words, 0).otherwise(1)).withColumn("run", F.sum("new").over(upto))
    src = F.struct("src_doc", "src_f", "src_at")
    return rows.groupBy("doc_id", "f", "run").agg(
        F.min("at").cast("bigint").alias("start_word"), F.max(F.col("at") + F.col("n") - 1 + p.min_words).cast("bigint").alias("end_word"), F.min(F.struct("at", src.alias("src"))).alias("m")
    ).select("doc_id", "f", "start_word", "end_word", F.col("m.src").alias("src"))


def spans_by_text(docs: DataFrame, p: Params, scratch: Scratch, repeats: bool) -> DataFrame:
    """As ``spans``, with the fingerprint ``f`` of the text."""
    runs, points = matches(docs, p, scratch, repeats)
    whole = joined(runs.unionByName(points), p)
    # A run's source may repeat an earlier passage in turn.
    true = points.select(F.struct(F.col("doc_id").alias("src_doc"), F.col("f").alias("src_f"), F.col("at").alias("src_at")).alias("src"), F.col("src_doc").alias("true_doc"))
    return whole.join(true, "src", "left").select("doc_id", "f", "start_word", "end_word", F.coalesce("true_doc", "src.src_doc").alias("src_doc_id"))


def spans(docs: DataFrame, p: Params = Params(), scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, start_word, end_word, src_doc_id``: the maximal runs of repeated words, end exclusive.

    ``src_doc_id`` is the document of the first occurrence of the run's first
    ``min_words`` words.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    out = scratch.write(spans_by_text(docs, p, scratch, _repeats(docs)), "spans")
    scratch.keep_only(out)
    return out.drop("f")


def cut_spans(docs: DataFrame, found: DataFrame, repeats: bool = False) -> DataFrame:
    """``docs`` without the words of the spans (doc_id, f, start_word, end_word); a document that has no words left goes."""
    cuts = found.groupBy(F.col("doc_id").alias("id"), "f").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("cuts"))
    rows = docs.select(F.col("doc_id").alias("id"), fingerprint(docs["text"], repeats).alias("f"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.join(cuts, ["id", "f"], "left")

    @F.arrow_udf("string")
    def rest(text: pa.Array, cuts: pa.Array) -> pa.Array:
        return pa.array((cut(t.as_py(), c.as_py()) for t, c in zip(text, cuts)), pa.string())

    text = F.when(F.col("cuts").isNull(), F.col("row.text")).otherwise(F.col("new"))
    # Only documents with spans pass through Python.
    whole = rows.where("cuts is null").select("row.*")
    changed = rows.where("cuts is not null").withColumn("new", rest("row.text", "cuts")).where("length(new) > 0")
    fields = [text.alias(c) if c == "text" else F.length("new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return whole.unionByName(changed.select(*fields))


def cut(text: str | None, cuts: list) -> str:
    w = words_of(pa.array([text]), lower=False, hashes=False)
    keep, at = [], 0
    data = w.data.tobytes()
    for c in cuts:
        s, e = (c["start_word"], c["end_word"]) if isinstance(c, dict) else (c[0], c[1])
        keep.append(data[at : w.start[s]])
        at = w.start[e] if e < len(w.start) else len(data)
    keep.append(data[at:])
    return b"".join(keep).decode().strip()


def drop_repeats(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with every passage of ``min_words`` words or more left where it comes first only."""
    scratch, repeats = Scratch(docs.sparkSession), _repeats(docs)
    found = scratch.write(spans_by_text(docs, p, scratch, repeats), "spans")
    scratch.keep_only(found)
    return cut_spans(docs, found, repeats)
