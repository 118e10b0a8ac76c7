"""Near duplicates by Order MinHash and banded alignment.

Sketch: the word k-grams of a text are labelled with their occurrence number, so
that a gram that comes twice counts as two. For each of ``sketches`` seeds the
``ell`` labelled grams with the smallest hashes are kept in the order in which
they stand in the text; texts that share such a tuple become candidates. Unlike
plain MinHash this falls with edit distance, not only with the overlap of sets.

Verification: words are aligned in a band about the diagonal that is as wide as
the largest distance accepted, which makes the distance exact wherever it is
accepted: at most ``1 - similarity`` of the longer text's words.

Every candidate pair is accounted for. Equal texts collapse to one representative
first. In a bucket every member is aligned with the smallest id, its hub, so that n
copies cost n alignments, and hot hubs are spread over tasks. The members then fall
into components; pairs of a component are connected already. Where a bucket still
holds members of several components, all pairs across them are held against each
other, each pair in the first bucket that it shares, until the two components meet
or no pair is left: a count of common words that can't rule out a match wrongly,
then the alignment. Buckets too large for one task are cut into blocks, and each
pair of blocks is a task of its own. The classes are those of aligning all pairs
of all buckets.

Edge cases: null or blank texts and null ids are in no group; rows that repeat an
id are one document, whose text is the smallest by fingerprint; texts of fewer
words than a sketch needs use all they have; very long texts are sketched and
aligned whole; similarities that tie with the limit count as near; a table without
duplicates, as an empty one, gives no rows. Only ``doc_id`` (bigint) and ``text``
are read; columns of other names pass through ``drop_near_duplicates`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.wordhash import U64, batches, grams, mix, words_of
from quarry.workdir import Scratch


@dataclass(frozen=True)
class Params:
    k: int = 2
    ell: int = 3
    #: So many that a pair of just the similarity asked for shares a bucket in more than nine of ten cases, from 20 words up.
    sketches: int = 32
    similarity: float = 0.8
    #: Members of a hub that one task aligns.
    fan: int = 256
    #: Members and words of a block of a large bucket.
    block: int = 512
    block_words: int = 4_000_000


def sketch(h: np.ndarray, p: Params, odd: np.ndarray) -> np.ndarray:
    """The Order MinHash values of one document's word hashes."""
    g = grams(h, p.k) if len(h) >= p.k else h
    order = np.argsort(g, kind="stable")
    s = g[order]
    new = np.empty(len(s), dtype=bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    run = np.flatnonzero(new)
    label = np.empty(len(s), dtype=U64)
    label[order] = (np.arange(len(s)) - np.repeat(run, np.diff(np.append(run, len(s))))).astype(U64)
    u = mix(g + label * U64(0xC2B2AE3D27D4EB4F))
    v = u[None, :] * odd[:, None]
    if len(u) > p.ell:
        at = np.sort(np.argpartition(v, p.ell - 1, axis=1)[:, : p.ell], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(u)), (len(odd), len(u)))
    out = np.arange(len(odd), dtype=U64)
    for j in range(at.shape[1]):
        out = mix(out * U64(0xD6E8FEB86659FD93) + g[at[:, j]])
    return out


def odds(p: Params) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 63, p.sketches, dtype=U64) * U64(2) + U64(1)


def fingerprint(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a sequence of words."""
    at = np.arange(1, len(h) + 1, dtype=U64)
    return int(mix(h + mix(at)).sum(dtype=U64).view(np.int64)), int((mix(h ^ U64(0x5851F42D4C957F2D)) * (at * U64(2) + U64(1))).sum(dtype=U64).view(np.int64))


def sketches_of(docs: DataFrame, p: Params) -> DataFrame:
    """``doc_id, f1, f2, n, sk`` for the documents with words: a 128-bit fingerprint of the word sequence, its length, and the sketch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = odds(p)
        for b in batches(it, 1):
            w = words_of(b.column(1))
            ids, f1, f2, n, sk = [], [], [], [], []
            for d, doc_id in enumerate(b.column(0).to_pylist()):
                h = w.hash[w.first[d] : w.first[d + 1]]
                if len(h):
                    ids.append(doc_id)
                    n.append(len(h))
                    for out, x in zip((f1, f2), fingerprint(h)):
                        out.append(x)
                    sk.append(sketch(h, p, odd).view(np.int64))
            flat = np.concatenate(sk) if sk else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sk) + 1, dtype=np.int32) * p.sketches), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(n, pa.int32()), lists], ["doc_id", "f1", "f2", "n", "sk"])

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, "doc_id bigint, f1 bigint, f2 bigint, n int, sk array<bigint>")


def word_ids(docs: DataFrame, repeats: bool) -> DataFrame:
    """``doc_id, w``: the words as 32-bit hashes, packed; of an id that repeats those of the text that was sketched."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 1):
            w = words_of(b.column(1))
            h = (w.hash >> U64(32)).astype(np.uint32)
            each = list(zip(w.first[:-1], w.first[1:]))
            prints = [fingerprint(w.hash[s:e]) if repeats and e > s else (0, 0) for s, e in each]
            columns = [b.column(0), *(pa.array([f[i] for f in prints], pa.int64()) for i in (0, 1)), pa.array([h[s:e].tobytes() for s, e in each], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "f1", "f2", "w"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, f1 bigint, f2 bigint, w binary")
    if repeats:
        out = out.where("length(w) > 0").groupBy("doc_id").agg(F.min(F.struct("f1", "f2", "w")).alias("m")).select("doc_id", "m.w")
    return out.select("doc_id", "w")


def common_words(x_sorted: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two multisets."""
    both = np.sort(np.concatenate([x_sorted, y]), kind="stable")
    ux, cx = np.unique(x_sorted, return_counts=True)
    ub, cb = np.unique(both, return_counts=True)
    return int(np.minimum(cx, cb[np.searchsorted(ub, ux)] - cx).sum())


def banded(x: np.ndarray, ys: list[np.ndarray], band: int) -> np.ndarray:
    """Edit distances of x to each y, exact where at most ``band``, else more than ``band``."""
    n, m = len(x), max(map(len, ys))
    width = 2 * band + 1
    # Column j of row i stands at i - band + b; padding never equals a word.
    padded = np.full((len(ys), n + m + width + 1), -1, dtype=np.int64)
    for r, y in enumerate(ys):
        padded[r, band : band + len(y)] = y
    b = np.arange(width, dtype=np.int32)
    big = np.int32(1 << 29)
    row = np.where(b >= band, b - band, big).astype(np.int32)[None, :].repeat(len(ys), 0)
    lens = np.array([len(y) for y in ys])
    xs = x.astype(np.int64)
    up = np.empty_like(row)
    for i in range(1, n + 1):
        # At (i, j): the word before j is padded[j - 1 + band], j = i - band + b.
        differ = padded[:, i - 1 : i - 1 + width] != xs[i - 1]
        np.add(row[:, 1:], 1, out=up[:, :-1])
        up[:, -1] = big
        np.minimum(row + differ, up, out=row)
        if i <= band:
            row[:, : band - i] = big
            row[:, band - i] = i
        row -= b
        np.minimum.accumulate(row, axis=1, out=row)
        row += b
    at = lens - n + band
    inside = (at >= 0) & (at < width)
    return np.where(inside, row[np.arange(len(ys)), np.clip(at, 0, width - 1)], big)


def near(x: np.ndarray, ys: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which ys are as similar to x as asked."""
    ok = np.zeros(len(ys), dtype=bool)
    xs = np.sort(x)
    todo: dict[int, list[int]] = {}
    for r, y in enumerate(ys):
        longer = max(len(x), len(y))
        most = int((1 - similarity) * longer + 1e-9)
        if abs(len(x) - len(y)) > most or longer - common_words(xs, y) > most:
            continue
        todo.setdefault(most, []).append(r)
    # A narrow band first: copies are mostly far closer than the limit.
    rows = [(r, most) for most, group in todo.items() for r in group]
    for share in (0.25, 0.6, 1.0):
        rows.sort(key=lambda t: t[1])
        left = []
        for at in range(0, len(rows), 32):
            part = rows[at : at + 32]
            band = max(4, int(np.ceil(share * part[-1][1])))
            d = banded(x, [ys[r] for r, _ in part], band)
            for (r, most), dist in zip(part, d):
                if dist <= min(band, most):
                    ok[r] = True
                elif band < most:
                    left.append((r, most))
        rows = left
    return ok


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def verified(pairs: DataFrame, words: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """The (a, b) of ``pairs`` that are near, by streaming each hub's members past its words."""
    per_hub = scratch.write(pairs.groupBy("a").agg(F.ceil(F.count("*") / p.fan).cast("int").alias("salts")), "salts")
    hubs = per_hub.join(words.hint("merge"), per_hub["a"] == words["doc_id"]).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("b"), "w")
    members = pairs.join(per_hub.hint("merge"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    members = members.join(words.hint("merge"), members["b"] == words["doc_id"]).select("a", "salt", "b", "w")
    # A number is given, as adaptive execution would join partitions by their bytes, which say little of the work.
    rows = hubs.unionByName(members).repartition(tasks(pairs), "a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, x, ids, ys = None, None, [], []

        def flush() -> pa.RecordBatch:
            ok = near(x, ys, p.similarity) if ys else []
            found = [i for i, o in zip(ids, ok) if o]
            ids.clear()
            ys.clear()
            return pa.RecordBatch.from_arrays([pa.array([hub] * len(found), pa.int64()), pa.array(found, pa.int64())], ["a", "b"])

        for batch in it:
            for a, b, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                v = np.frombuffer(w.as_buffer(), dtype=np.uint32).copy()
                if b is None:
                    if ys:
                        yield flush()
                    hub, x = a, v
                else:
                    ids.append(b)
                    ys.append(v)
                    if len(ys) >= 64:
                        yield flush()
        if ys:
            yield flush()

    return rows.mapInArrow(run, "a bigint, b bigint")


class Block:
    """Members of a bucket, or of two blocks of it, by component. Pairs of one component, and of one block where there are two, need no look."""

    BINS = 128

    def __init__(self, p: Params):
        self.p = p
        self.rows: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []

    def add(self, doc_id: int, comp: int, side: int, sk: np.ndarray, w: np.ndarray) -> None:
        self.rows.append((doc_id, comp, side, sk, w))

    def links(self, slot: int, two: bool) -> list[tuple[int, int]]:
        """Near pairs that connect all components that near pairs connect."""
        if len({r[1] for r in self.rows}) < 2:
            return []
        ids, comps, sides, sks, words = zip(*self.rows)
        names, comp = np.unique(np.array(comps), return_inverse=True)
        side, sk, lens = np.array(sides), np.array(sks)[:, :slot], np.array([len(w) for w in words])
        bins = np.array([np.minimum(np.bincount(w % self.BINS, minlength=self.BINS), 65535) for w in words], dtype=np.uint16)
        # Labels of components, renamed as they meet.
        root, out = np.arange(len(names)), []
        for i in range(1, len(ids)):
            where = np.flatnonzero((root[comp[:i]] != root[comp[i]]) & ((side[:i] != side[i]) | (not two)))
            longer = np.maximum(lens[where], lens[i])
            most = ((1 - self.p.similarity) * longer + 1e-9).astype(int)
            ok = np.abs(lens[where] - lens[i]) <= most
            where, longer, most = where[ok], longer[ok], most[ok]
            # Words that share no bin can't be equal, so this bounds the common words from above.
            common = np.minimum(bins[where], bins[i]).sum(axis=1, dtype=np.int64)
            where = where[(longer - common <= most) & ~(sk[where] == sk[i]).any(axis=1)]
            share = 1
            while len(where):
                # A few of each component first: one near member is enough.
                order = np.argsort(root[comp[where]], kind="stable")
                by = root[comp[where[order]]]
                nth = np.arange(len(by)) - np.searchsorted(by, by)
                now, where = where[order[nth < share]], where[order[nth >= share]]
                for j, close in zip(now, near(words[i], [words[j] for j in now], self.p.similarity)):
                    if close and root[comp[j]] != root[comp[i]]:
                        out.append((ids[j], ids[i]))
                        root[root == root[comp[j]]] = root[comp[i]]
                where = where[root[comp[where]] != root[comp[i]]]
                share *= 4
        return out


def across(members: DataFrame, comp: DataFrame, exact: DataFrame, words: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """Near (a, b) among members (bucket, b) of a bucket that ``comp`` doesn't connect."""
    labelled = members.join(comp.withColumnRenamed("id", "b").hint("merge"), "b", "left")
    labelled = scratch.write(labelled.select("bucket", "b", F.coalesce("comp", "b").alias("comp")), "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("bucket")
    mixed = scratch.write(mixed, "mixed")
    sk = exact.select(F.col("rep").alias("b"), "n", "sk")
    rows = scratch.write(labelled.join(mixed.hint("merge"), "bucket", "left_semi").join(sk.hint("merge"), "b"), "crossing")
    if rows.isEmpty():
        return rows.select(F.col("b").alias("a"), "b")
    sizes = rows.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / p.block), F.ceil(F.sum("n") / p.block_words)).cast("int").alias("blocks"))
    rows = rows.join(scratch.write(sizes, "sizes").hint("merge"), "bucket").withColumn("own", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    # A member goes to the pairs of its block with every block, itself included.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("bucket", "b", "comp", "sk", "own", other).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    rows = rows.join(words.withColumnRenamed("doc_id", "b").hint("merge"), "b")
    rows = rows.select("bucket", "x", "y", "own", "comp", "b", "sk", "w").repartition(tasks(rows), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "comp", "b")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block, slot = None, Block(p), 0

        def done() -> pa.RecordBatch:
            found = block.links(slot, last is not None and last[1] != last[2])
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in it:
            whole, x, y, own, comps, b = (batch.column(i).to_pylist() for i in range(6))
            flat = batch.column(6).flatten().to_numpy().reshape(-1, p.sketches) if batch.num_rows else None
            for r, w in enumerate(batch.column(7)):
                if (whole[r], x[r], y[r]) != last:
                    yield done()
                    last, block, slot = (whole[r], x[r], y[r]), Block(p), whole[r] & 255
                block.add(b[r], comps[r], own[r], flat[r].copy(), np.frombuffer(w.as_buffer(), dtype=np.uint32).copy())
        yield done()

    return rows.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, comp`` of the vertices of (a, b) edges; comp is the smallest id that is connected. Large-star and small-star in turn."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        # Each vertex sends its neighbours (large: the greater ones, small: the others) to the smallest of them and itself.
        both = e.select(F.col("a").alias("v"), F.col("b").alias("u")).union(e.select(F.col("b").alias("v"), F.col("a").alias("u")))
        if not large:
            both = both.where("u <= v")
        # Written, so that the join reads two plain shuffles, which adaptive execution can split at a vertex of many edges.
        low = scratch.write(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")), "low")
        if large:
            moved = both.join(low, "v").where("u > v").select(F.col("m").alias("a"), F.col("u").alias("b"))
        else:
            moved = both.join(low, "v").select(F.col("m").alias("a"), F.col("u").alias("b")).union(low.select(F.col("m").alias("a"), F.col("v").alias("b")))
        return moved.where("a != b").distinct()

    now = scratch.write(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")
    state = lambda t: tuple(t.agg(F.count("*"), F.sum("a"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())
    was = state(now)
    while True:
        large = scratch.write(star(now, True), "stars")
        new = scratch.write(star(large, False), "stars")
        scratch.drop(now, large)
        now, seen = new, state(new)
        if seen == was:
            break
        was = seen
    return now.select(F.col("b").alias("id"), F.col("a").alias("comp")).union(now.select(F.col("a").alias("id"), F.col("a").alias("comp")).distinct())


def groups(docs: DataFrame, p: Params = Params(), scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, group_id, n_links`` of every document that has a near or exact duplicate.

    ``group_id`` is the smallest id of the group. ``n_links`` counts the other
    texts to which the document's text was aligned and found near; these links
    connect the group. It is 0 where all the others of a group have the same text.
    """
    scratch, repeats = scratch or Scratch(docs.sparkSession), _repeats(docs)
    sk = scratch.write(sketches_of(docs, p), "sketches")
    one = sk.groupBy("doc_id").agg(F.min(F.struct("f1", "f2", "n", "sk")).alias("s")).select("doc_id", "s.*") if repeats else sk
    exact = one.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sk").alias("sk"))
    exact = scratch.write(exact, "exact")
    # Copies stay rows of their own: a group of them may be as large as the table.
    ids = scratch.write(one.select("doc_id", "f1", "f2"), "ids")
    scratch.drop(sk)
    # A bucket is one value of one slot, which stands in its last byte.
    slot = lambda v, j: F.call_function("shiftleft", F.xxhash64(v), F.lit(8)) + j
    slots = exact.select("rep", F.posexplode("sk").alias("j", "v")).select(slot(F.col("v"), F.col("j")).alias("bucket"), "rep")
    hubs = slots.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("c")).where("c > 1").select("bucket", "hub")
    hubs = scratch.write(hubs, "hubs")
    members = slots.join(hubs.hint("merge"), "bucket").where("rep != hub").select("bucket", F.col("hub").alias("a"), F.col("rep").alias("b"))
    members = scratch.write(members, "members")
    pairs = scratch.write(members.select("a", "b").distinct(), "pairs")
    # Merge joins at every size: texts and words move once whether or not the other side would fit in memory.
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text").join(needed.hint("merge"), "doc_id", "left_semi")
    words = scratch.write(word_ids(texts, repeats), "words")
    found = scratch.write(verified(pairs, words, p, scratch), "found")
    comp = scratch.write(components(found, scratch), "components")
    more = scratch.write(across(members.drop("a"), comp, exact, words, p, scratch), "across")
    links = scratch.write(found.union(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if not more.isEmpty():
        # The new links join components, whose members needn't be connected again.
        at = lambda c: comp.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
        between = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = scratch.write(components(between, scratch), "joined").select(F.col("id").alias("comp"), F.col("comp").alias("last"))
        single = between.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comp, "id", "left_anti").select("id", F.col("id").alias("comp"))
        comp = comp.union(single).join(joined, "comp", "left").select("id", F.coalesce("last", "comp").alias("comp"))
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    comp = comp.join(degree, "id", "left").select("id", "comp", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    classes = exact.select("f1", "f2", "rep", "copies").join(comp, F.col("rep") == F.col("id"), "left").where("comp is not null or copies > 1")
    classes = scratch.write(classes.select("f1", "f2", F.coalesce("comp", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links")), "classes")
    scratch.keep_only(ids, classes)
    return ids.join(classes.hint("merge"), ["f1", "f2"]).select("doc_id", "group_id", "n_links")


def _repeats(docs: DataFrame) -> bool:
    """Whether an id comes more than once."""
    return docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count() > 0


def drop_near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest id, and one row of each id."""
    scratch = Scratch(docs.sparkSession)
    losers = scratch.write(groups(docs, p, scratch).where("doc_id != group_id").select("doc_id"), "losers")
    scratch.keep_only(losers)
    kept = docs.join(losers, "doc_id", "left_anti").select(*docs.columns)
    if not _repeats(docs):
        return kept
    row = Window.partitionBy("doc_id").orderBy("text")
    numbered = kept.select(F.struct(*[kept[c] for c in kept.columns]).alias("row"), F.when(F.col("doc_id").isNull(), 1).otherwise(F.row_number().over(row)).alias("k"))
    return numbered.where("k = 1").select("row.*")
