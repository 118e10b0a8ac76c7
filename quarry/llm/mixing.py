"""Time-varying curriculum over sources.

A schedule gives each source a weight at knots of the training time t in [0, 1];
between knots the weights are linear and at each knot they are scaled to sum to
one, so the share of a source at t is its weight. Its token demand by time t is
the budget times the integral of the share: piecewise quadratic. The documents
of a source, in a hashed order, are laid end to end; the document that starts at
token c is trained on at the time where the demand reaches c. Documents that the
demand never reaches are left out, and where it exceeds the supply the source
starts again as epoch 1, 2, ... The result is range-sorted by position.

The running token counts are computed in two levels, so that a source however
large is spread over tasks: sums per slice of the hash range, a running sum over
those few rows, and a window inside each slice.

A segment starts where the one before it ends, to the bit, so that every document
that the demand reaches is in one segment.

``mix`` gives the rows themselves. Time is the share of the budget that is spent,
so equal steps of position hold about equal numbers of tokens and serve as ranges
without a sample. Positions are sent to the rows while they are at most
``broadcast_positions`` and the texts move once; beyond that rows and positions are
joined by a shuffle first, with the same result.

Edge cases: rows without an id or of no words (null or empty text) have no
tokens and get no position; a null source is a source of its own, written as
``''``; repeated rows are laid one after the other; documents whose hashes tie are
laid by id, then length, and positions that tie are ordered by source, id and
epoch; very long texts count whole and shift those after them; columns of any name
pass through ``mix`` unchanged; an empty table gives an empty result; the sources
of the schedule that have no documents only lose their share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.workdir import Scratch

#: Positions are whole numbers of this part of the training time.
SCALE = 1_000_000_000


@dataclass(frozen=True)
class Curriculum:
    """From natural token shares at t = 0 to shares ~ tokens^``flat`` at t = 1, by way of ``knots`` equal steps."""

    flat: float = 0.5
    knots: int = 4
    slice_rows: int = 50_000
    broadcast_rows: int = 200_000
    broadcast_positions: int = 1_000_000


def natural_schedule(supply: DataFrame, c: Curriculum) -> DataFrame:
    """``source, knot, weight`` from ``source, tokens``."""
    knots = F.explode(F.sequence(F.lit(0), F.lit(c.knots))).alias("knot")
    raw = supply.select("source", "tokens", knots).withColumn("exponent", 1.0 - (1.0 - c.flat) * F.col("knot") / c.knots)
    return raw.select("source", "knot", F.pow(F.col("tokens").cast("double"), F.col("exponent")).alias("weight"))


def segments(schedule: DataFrame, supply: DataFrame, budget: float, knots: int) -> DataFrame:
    """Per source and segment: time and demand at its start, share at its start, slope of the share, demand at its end."""
    w = schedule.join(supply.select("source", "tokens"), "source")
    per_knot = Window.partitionBy("knot")
    per_source = Window.partitionBy("source").orderBy("knot")
    share = w.withColumn("share", F.col("weight") / F.sum("weight").over(per_knot))
    seg = share.withColumn("next", F.lead("share").over(per_source)).where("next is not null")
    step = 1.0 / knots
    seg = seg.withColumn("area", (F.col("share") + F.col("next")) * F.lit(0.5 * step * budget))
    seg = seg.withColumn("until", F.sum("area").over(per_source))
    return seg.select(
        "source", "tokens", (F.col("knot") * step).alias("t0"), "share", ((F.col("next") - F.col("share")) / step).alias("slope"),
        F.coalesce(F.lag("until").over(per_source), F.lit(0.0)).alias("from_tokens"), "until",
    )


def positions(docs: DataFrame, c: Curriculum = Curriculum(), schedule: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """``doc_id, source, epoch, position, n_tokens``, one row for each time a document is trained on, not yet sorted.

    ``schedule`` is ``source, knot, weight`` with knots 0..c.knots; by default
    it follows from the corpus. ``budget`` tokens are trained on; by default as
    many as the corpus has.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.regexp_count("text", F.lit(r"\S+")).cast("bigint").alias("n_tokens")
    )
    rows = scratch.write(rows.where("n_tokens > 0"), "lengths")
    total = rows.agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).first()
    tokens, n = total["t"] or 0, total["n"]
    budget = budget or tokens
    slices = max(1, -(-n // c.slice_rows))
    # A hash of the id alone orders a source; the slices are ranges of that hash.
    h = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    rows = rows.withColumn("h", h).withColumn("part", F.floor(F.col("h") / float(1 << 32) * slices).cast("int"))
    sums = rows.groupBy("source", "part").agg(F.sum("n_tokens").alias("part_tokens"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "part", F.coalesce(F.sum("part_tokens").over(ahead), F.lit(0)).alias("before_part"))
    inside = Window.partitionBy("source", "part").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.join(sums, ["source", "part"]).select(
        "doc_id", "source", "n_tokens", (F.col("before_part") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start")
    )
    supply = scratch.write(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "supply")
    # One source can hold most rows: a join by source would put them in one task, so a list of sources of checked size is sent along.
    small = F.broadcast if supply.count() * c.knots <= c.broadcast_rows else (lambda t: t)
    seg = segments(schedule if schedule is not None else natural_schedule(supply, c), supply, float(budget), c.knots)
    demand = seg.groupBy("source").agg(F.max("until").alias("demand"), F.max("tokens").alias("tokens"))
    epochs = F.sequence(F.lit(0), F.floor((F.col("demand") - F.col("start") - 1e-6) / F.col("tokens")).cast("int"))
    laid = laid.join(small(demand), "source").where(F.col("start") + 1e-6 < F.col("demand"))
    laid = laid.select("doc_id", "source", "n_tokens", "start", "tokens", F.explode(epochs).alias("epoch"))
    laid = laid.withColumn("at", (F.col("start") + F.col("epoch") * F.col("tokens")).cast("double"))
    found = laid.join(small(seg.drop("tokens")), "source").where((F.col("at") >= F.col("from_tokens")) & (F.col("at") < F.col("until")))
    need = (F.col("at") - F.col("from_tokens")) / F.lit(float(max(1, budget)))
    # share * x + slope / 2 * x^2 = need, by the root that stays stable for any slope.
    x = 2.0 * need / (F.col("share") + F.sqrt(F.greatest(F.col("share") * F.col("share") + 2.0 * F.col("slope") * need, F.lit(0.0))))
    return found.select("doc_id", "source", "epoch", F.floor((F.col("t0") + x) * SCALE).cast("bigint").alias("position"), "n_tokens")


def curriculum(docs: DataFrame, c: Curriculum = Curriculum()) -> DataFrame:
    """The positions, range-sorted."""
    return positions(docs, c).orderBy("position", "source", "doc_id", "epoch")


def mix(docs: DataFrame, c: Curriculum = Curriculum()) -> DataFrame:
    """The rows of ``docs`` in training order; a row comes once for each epoch that reaches it."""
    spark = docs.sparkSession
    words = F.regexp_count("text", F.lit(r"\S+"))
    rows = docs.select(F.col("doc_id").alias("id"), words.alias("n"), F.struct(*[docs[x] for x in docs.columns]).alias("row"))
    nth = Window.partitionBy("id", "epoch").orderBy("n_tokens", "position")
    repeats = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    at = positions(docs, c).withColumnRenamed("doc_id", "id")
    at = at.withColumn("k", F.row_number().over(nth)) if repeats else at.withColumn("k", F.lit(1))
    at = Scratch(spark).write(at.select("id", "epoch", "position", "k"), "positions")
    if repeats:
        rows = rows.where("n > 0").withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("n")))
    else:
        rows = rows.withColumn("k", F.lit(1))
    placed = rows.join(F.broadcast(at) if at.count() <= c.broadcast_positions else at.hint("merge"), ["id", "k"])
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = F.least(F.floor(F.col("position") * F.lit(ranges) / F.lit(SCALE)), F.lit(ranges - 1)).cast("int")
    return placed.repartitionById(ranges, part).sortWithinPartitions("position", "id", "epoch").select("row.*")
