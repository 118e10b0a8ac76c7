"""Language identification: words first, then shorter and shorter character n-grams.

The model counts words by language in a bounded sample of labelled rows: of each
language those of the smallest hash of id and text over the whole table, ``rows``
at most, and no more once they hold ``words`` words (or an equal part of
``entries``, if there are many languages). So rare languages, and languages that
lie at the end of the table, are in it. This bound is the only one: every word of
the sample is kept, and what is identified is read whole. What the driver and the
tasks hold grows with the entries (word, language) of the sample.

A word of the vocabulary scores its log frequency in each language. A word that
isn't there scores, at each of its characters, the longest n-gram from there that
the model knows (``longest`` characters down to 1), and counts as the mean of those.
A document goes to the language of the largest sum; ties go to the name that
comes first.

Edge cases: texts without words (null, empty, signs only) are ``und``; every row
gives one row, so null or repeated ids stay; rows without a label aren't trained
on; without any labelled row, or in an empty table, everything is ``und``; very long
texts are scored whole, and the row of the sample that crosses the bound of words is
taken whole. Only ``doc_id``, ``text`` and, for training, ``lang`` are read, and
columns of other names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.wordhash import PUNCTUATION, U64, batches, mix, words_of


@dataclass(frozen=True)
class Params:
    #: The training sample: rows and words of each language at most, and words of all.
    rows: int = 1000
    words: int = 500_000
    entries: int = 5_000_000
    #: Languages of a list that may be sent to all tasks.
    broadcast_langs: int = 10_000
    longest: int = 5
    alpha: float = 0.1


@dataclass
class Logs:
    """Sorted 64-bit keys with their log frequencies: ``base`` of a language where a key is unseen in it, and ``more`` where it is seen."""

    keys: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    more: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, lang: np.ndarray, n: np.ndarray, n_langs: int, alpha: float, among: int | None = None) -> Logs:
        """From (key, language, count), which may repeat; ``among`` is the number of kinds if it isn't that of the keys."""
        keys, own = np.unique(key, return_inverse=True)
        pairs, at = np.unique(own * max(1, n_langs) + lang, return_inverse=True)
        count = np.bincount(at, weights=n, minlength=len(pairs))
        lang = pairs % max(1, n_langs)
        total = np.bincount(lang, weights=count, minlength=n_langs)
        below = np.log(total + alpha * (len(keys) if among is None else among)) if len(keys) else np.zeros(n_langs)
        base = np.log(alpha) - below
        first = np.searchsorted(pairs // max(1, n_langs), np.arange(len(keys) + 1))
        return cls(keys, first, lang.astype(np.int32), np.log(count + alpha) - np.log(alpha), base)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """Log frequencies in each language of the keys at ``at``."""
        out = np.repeat(self.base[None, :], len(at), axis=0)
        n = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[np.repeat(np.arange(len(at)), n), self.lang[entry]] += self.more[entry]
        return out


@dataclass
class Model:
    """Words by their hashes, and n-grams of each length by their keys."""

    langs: list[str]
    words: Logs
    grams: list[Logs]


def ngram_keys(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each character of the joined words: its word, and the key of the n-gram from there, 0 where the word ends before."""
    text = b"".join(b"\x02" + w + b"\x03" for w in words).decode("utf-8", "replace")
    cp = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(U64)
    word = np.cumsum(cp == 2) - 1
    key = np.zeros(len(cp), U64)
    if n <= len(cp):
        k = np.full(len(cp) - n + 1, n, U64)
        for j in range(n):
            k = k * U64(0x9E3779B97F4A7C15) + cp[j : len(cp) - n + 1 + j] + U64(1)
        ok = word[: len(k)] == word[n - 1 :]
        key[: len(k)][ok] = mix(k[ok]) | U64(1)
    return word, key


def fit(counts: list[tuple[str, str, int]], p: Params = Params()) -> Model:
    """From (language, word, count) of the sample."""
    langs = sorted({r[0] for r in counts})
    col = {x: i for i, x in enumerate(langs)}
    names = sorted({r[1] for r in counts})
    at = {w: i for i, w in enumerate(names)}
    word, lang, n = (np.array([f(r) for r in counts], dtype=np.int64) for f in (lambda r: at[r[1]], lambda r: col[r[0]], lambda r: r[2]))
    order = np.argsort(word, kind="stable")
    word, lang, n = word[order], lang[order], n[order]
    first = np.searchsorted(word, np.arange(len(names) + 1))
    hashed = words_of(pa.array(names, pa.string()), space=PUNCTUATION, lower=False)
    single = np.diff(hashed.first) == 1
    of = np.zeros(len(names), U64)
    of[single] = hashed.hash[hashed.first[:-1][single]]
    known = single[word]
    raw, grams = [w.encode() for w in names], []
    for size in range(1, p.longest + 1):
        own, key = ngram_keys(raw, size)
        own, key = own[key > 0], key[key > 0]
        # Each n-gram counts as often as its word does, in each language of the word.
        each = first[own + 1] - first[own]
        entry = np.repeat(first[own] - np.cumsum(each) + each, each) + np.arange(each.sum())
        grams.append(Logs.of(np.repeat(key, each), lang[entry], n[entry], len(langs), p.alpha))
    return Model(langs, Logs.of(of[word[known]], lang[known], n[known], len(langs), p.alpha), grams)


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def word_scores(m: Model, hashes: np.ndarray, words: list[bytes] | None, longest: int) -> np.ndarray:
    """Rows of scores of distinct words; ``words`` gives the bytes of those that the vocabulary misses, in order."""
    at, hit = _find(m.words.keys, hashes)
    out = np.zeros((len(hashes), len(m.langs)))
    out[hit] = m.words.rows(at[hit])
    if words:
        total, n_chars = np.zeros((len(words), len(m.langs))), np.zeros(len(words))
        open_ = None
        for n in range(longest, 0, -1):
            word, key = ngram_keys(words, n)
            open_ = np.ones(len(key), bool) if open_ is None else open_
            todo = np.flatnonzero(open_ & (key > 0))
            i, found = _find(m.grams[n - 1].keys, key[todo])
            todo, i = todo[found], i[found]
            open_[todo] = False
            logs = m.grams[n - 1].rows(i)
            for j in range(len(m.langs)):
                total[:, j] += np.bincount(word[todo], weights=logs[:, j], minlength=len(words))
            n_chars += np.bincount(word[todo], minlength=len(words))
        out[~hit] = total / np.maximum(n_chars, 1)[:, None]
    return out


def predict(m: Model, texts: pa.Array, longest: int) -> tuple[list[str], np.ndarray]:
    """Languages, and by how much the best beats the next per word."""
    w = words_of(texts, space=PUNCTUATION)
    n = len(w.first) - 1
    if not len(w.hash) or not m.langs:
        return ["und"] * n, np.zeros(n)
    uniq, first, own = np.unique(w.hash, return_index=True, return_inverse=True)
    _, hit = _find(m.words.keys, uniq)
    data = w.data.tobytes()
    unseen = [data[s:e] for s, e in zip(w.start[first[~hit]].tolist(), w.end[first[~hit]].tolist())]
    scores = word_scores(m, uniq, unseen, longest)
    sums = np.stack([np.bincount(w.doc, weights=scores[own, j], minlength=n) for j in range(len(m.langs))], axis=1)
    count = np.diff(w.first)
    best = np.argmax(sums, axis=1)
    top = np.sort(sums, axis=1)
    margin = (top[:, -1] - top[:, -2] if top.shape[1] > 1 else np.zeros(n)) / np.maximum(count, 1)
    return [m.langs[i] if c else "und" for i, c in zip(best, count)], np.where(count > 0, margin, 0.0)


def sample(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``lang, text`` of the training rows."""
    labelled = docs.where("lang is not null and text is not null").select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = sizes.count()
    sizes = F.broadcast(sizes) if n_langs <= p.broadcast_langs else sizes
    # A share of the hashes that holds more rows than are taken but for a vanishing chance, and then the smallest.
    share = F.least(F.lit(1.0), (2.0 * p.rows + 100) / F.col("n"))
    drawn = labelled.join(sizes, "lang").where(F.col("h").cast("double") / float(1 << 63) <= 2.0 * share - 1.0)
    words = F.regexp_count("text", F.lit(r"[a-zA-Z0-9\x{80}-\x{10FFFF}]+"))
    by = Window.partitionBy("lang").orderBy("h", "text")
    ahead = F.coalesce(F.sum(words).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = min(p.words, p.entries // max(1, n_langs))
    return drawn.withColumn("r", F.row_number().over(by)).withColumn("ahead", ahead).where((F.col("r") <= p.rows) & (F.col("ahead") < most)).select("lang", "text")


def train(docs: DataFrame, p: Params = Params()) -> Model:
    """Counts the words of the sample in Spark; the driver gets each (language, word) once."""
    words = sample(docs, p).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9\x{80}-\x{10FFFF}]+)"), F.lit(1))).alias("word"))
    counts = words.groupBy("lang", "word").count().toArrow()
    return fit(list(zip(*(counts[c].to_pylist() for c in ("lang", "word", "count")))), p)


def identify(docs: DataFrame, model: Model | None = None, p: Params = Params()) -> DataFrame:
    """``doc_id, language, margin`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, p))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches(it, 1, 2 << 20):
            lang, margin = predict(m, b.column(1), p.longest)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(margin)], ["doc_id", "language", "margin"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, language string, margin double")
