"""Document quality rules as a short-circuit cascade.

Each rule is a built-in Spark expression that is true for an acceptable text. On
a bounded sample (``sample_rows`` rows of the whole table or, of a table of more
than ``sample_files`` Parquet files, of so many files evenly spread over it) every
rule is timed and its rejections are counted; the rules are then joined by AND in the order of rejections per second of cost, so that
most bad documents stop at a cheap rule. The order changes only the cost: a
document is kept if and only if it passes all the rules.

Toxicity beyond the list of English insults is learned from labelled rows
(``toxicity``): a word's weight in a language is the log ratio of the shares of
toxic and of clean documents that hold it, less ``z`` standard errors, so that
rare words count little. A text fails where the weights of its distinct words
reach the language's threshold: the score that at most ``clean_share`` of the
clean rows reach when each half of the sample is scored by weights fitted on the
other half, or a third of the median score of the toxic rows where that is more. The sample is at most ``toxic_rows`` and ``clean_rows`` rows of each of
at most ``languages`` languages, those of the smallest MD5 of the id. A null
language, or one without weights, is judged by weights over all languages.

Edge cases: a null, empty or blank text is rejected by ``has_text``; rows are
judged one by one, so repeated rows, null ids and very long texts need no special
treatment; other columns are passed on; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Insults of general English; two or more of them reject a text.
BLOCKLIST = (
    "idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "pathetic", "worthless", "disgusting",
    "clown", "clowns", "imbecile", "bastard", "bitch", "asshole", "dumbass", "retard", "scumbag", "jerk", "filth", "vermin",
)


@dataclass(frozen=True)
class Rule:
    name: str
    ok: Column


@dataclass(frozen=True)
class Fit:
    toxic_rows: int = 500
    clean_rows: int = 1500
    languages: int = 20
    words: int = 500
    least_rows: int = 3
    z: float = 1.64
    clean_share: float = 0.005


@dataclass(frozen=True)
class Toxicity:
    """Weights of words and the score that rejects a text, by language; None stands for all languages."""

    weights: dict[str | None, dict[str, float]]
    threshold: dict[str | None, float]


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: int

    @property
    def rank(self) -> float:
        return (self.rejected + 0.5) / max(self.seconds, 1e-6)


def default_rules(text: str = "text") -> list[Rule]:
    t, n = F.col(text), F.length(text)
    count = lambda pattern, c=t: F.regexp_count(c, F.lit(pattern))
    lines = F.split(t, "\n")
    return [
        Rule("has_text", t.rlike(r"\S")),
        Rule("symbol_runs", count(r"[#$%&*]{2,}") <= 0.015 * n),
        Rule("table_bars", n - F.length(F.replace(t, F.lit("|"), F.lit(""))) <= 0.015 * n),
        Rule("shouting", (n < 50) | (count(r"\p{Lu}") <= 0.3 * n)),
        Rule("repeated_lines", F.size(F.array_distinct(lines)) >= 0.5 * F.size(lines)),
        Rule("repeated_words", count(r"(?<!\S)(\S++)(?=\s+\1(?!\S))") <= 0.2 * count(r"\S+")),
        Rule("few_letters", (n < 50) | (count(r"[^\p{L}\s]") <= 0.4 * n)),
        Rule("abuse", count(rf"\b({'|'.join(BLOCKLIST)})\b", F.lower(t)) < 2),
    ]


def word_list(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9\x{80}-\x{10FFFF}]+)"), F.lit(1))


def _weights(code: np.ndarray, doc: np.ndarray, toxic: np.ndarray, n_words: int, p: Fit) -> np.ndarray:
    """The weight of each word from (word, document) pairs; 0 where it says nothing."""
    t = np.bincount(code[toxic[doc]], minlength=n_words)
    c = np.bincount(code, minlength=n_words) - t
    # ``doc`` may cover a part of the rows only.
    has = np.unique(doc)
    n_toxic, n_clean = toxic[has].sum(), (~toxic[has]).sum()
    ratio = np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
    low = ratio - p.z * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    low[(t < p.least_rows) | (low < 1)] = 0
    if np.count_nonzero(low) > p.words:
        low[np.argsort(-low, kind="stable")[p.words :]] = 0
    return low


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", p: Fit = Fit()) -> Toxicity:
    """Fitted on the rows of ``docs`` that ``labels`` (doc_id, toxic 0/1) covers."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.where(F.col("doc_id").isNotNull() & (F.length(F.trim(text)) > 0)).select("doc_id", lang.alias("lang")).join(marked, "doc_id").groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("toxic").alias("toxic"))
    largest = [r[0] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(p.languages).collect()]
    if not largest:
        return Toxicity({}, {})
    nth = F.row_number().over(Window.partitionBy("lang", "toxic").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id"))
    drawn = rows.where(reduce(lambda a, b: a | b, (F.col("lang").eqNullSafe(x) for x in largest))).withColumn("nth", nth)
    # The plain bound lets each task drop what can't be among the first.
    drawn = drawn.where(F.col("nth") <= max(p.toxic_rows, p.clean_rows))
    drawn = drawn.where(F.col("nth") <= F.when(F.col("toxic") == 1, p.toxic_rows).otherwise(p.clean_rows)).select("doc_id", F.col("lang").alias("of"), "toxic")
    one = docs.select("doc_id", text).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "of", "toxic").agg(F.min(text).alias("body"))
    # The driver sorts, so that the halves don't depend on the order of tasks.
    sample = one.select("doc_id", "of", "toxic", F.array_distinct(word_list("body")).alias("words")).toArrow().sort_by("doc_id").combine_chunks()
    words = sample["words"].combine_chunks()
    coded = words.flatten().dictionary_encode()
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    toxic = sample["toxic"].to_numpy() == 1
    of = np.array(sample["of"].to_pylist(), dtype=object)
    out = Toxicity({}, {})
    for name in [None, *sorted(x for x in largest if x is not None)]:
        row = np.ones(len(of), dtype=bool) if name is None else of == name
        if not (row & toxic).any() or not (row & ~toxic).any():
            continue
        # Halves of each class alike.
        half = np.zeros(len(of), dtype=int)
        for kind in (row & toxic, row & ~toxic):
            half[kind] = np.arange(kind.sum()) % 2
        scores = np.zeros(len(of))
        for h in (0, 1):
            fitted, scored = row[doc] & (half[doc] != h), row[doc] & (half[doc] == h)
            w = _weights(code[fitted], doc[fitted], toxic, len(names), p)
            scores += np.bincount(doc[scored], weights=w[code[scored]], minlength=len(of))
        clean = np.sort(scores[row & ~toxic])
        above = clean[len(clean) - 1 - int(p.clean_share * len(clean))]
        w = _weights(code[row[doc]], doc[row[doc]], toxic, len(names), p)
        out.weights[name] = {names[i]: float(w[i]) for i in np.flatnonzero(w)}
        # Never under two: a single word of little weight isn't evidence. Where toxic rows score high, more is asked.
        out.threshold[name] = float(max(2.0, np.nextafter(above, np.inf), np.median(scores[row & toxic]) / 3))
    return out


def toxicity_rule(t: Toxicity, has_lang: bool, text: str = "text") -> Rule:
    """True for the texts whose score stays under the threshold of their language."""
    words = word_list(text)

    def below(name: str | None) -> Column:
        weights = t.weights[name]
        if not weights:
            return F.lit(True)
        table = F.map_from_arrays(F.lit(list(weights)), F.lit(list(weights.values())))
        found = F.array_intersect(words, F.lit(list(weights)))
        return F.aggregate(found, F.lit(0.0), lambda acc, w: acc + F.element_at(table, w)) < t.threshold[name]

    named = [x for x in t.weights if x is not None] if has_lang else []
    ok = F.lit(True) if None not in t.weights else below(None)
    for name in named:
        ok = F.when(F.col("lang") == name, below(name)).otherwise(ok)
    return Rule("toxicity", ok)


def drawn(docs: DataFrame, columns: list[str], sample_rows: int, sample_files: int, seed: int) -> DataFrame:
    """At most ``sample_rows`` rows, wherever they stand."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        relation = plan.relation()
        if relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().toString() == "Parquet":
            files = sorted(docs.inputFiles())
            if len(files) > sample_files:
                chosen = [files[(2 * i + 1) * len(files) // (2 * sample_files)] for i in range(sample_files)]
                docs = docs.sparkSession.read.schema(docs.schema).parquet(*chosen)
    rows = docs.select(*columns)
    share = min(1.0, (1.2 * sample_rows + 100) / max(1, docs.count()))
    return rows.sample(share, seed).orderBy(F.xxhash64(*columns)).limit(sample_rows)


def measure(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = 1000, sample_files: int = 64, seed: int = 7) -> list[Measured]:
    """Cost and rejections of each rule over the sample."""
    sample = drawn(docs, [text, *[c for c in ("lang",) if c in docs.columns]], sample_rows, sample_files, seed).repartition(4).persist()
    try:
        sample.count()

        def timed(c: Column) -> tuple[float, int]:
            plan, best, n = sample.agg(F.count_if(~F.coalesce(c, F.lit(False)))), 1e9, 0
            for _ in range(2):
                began = time.perf_counter()
                n = plan.first()[0]
                best = min(best, time.perf_counter() - began)
            return best, n

        floor, _ = timed(F.lit(True))
        return [Measured(r, max(s - floor, 1e-3), n) for r, (s, n) in ((r, timed(r.ok)) for r in rules)]
    finally:
        sample.unpersist()


def cascade(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = 1000) -> Column:
    """The one condition of all rules, cheapest rejection first; never null."""
    rules = rules or default_rules(text)
    ordered = sorted(measure(docs, rules, text, sample_rows), key=lambda m: -m.rank)
    return reduce(lambda a, b: a & b, (F.coalesce(m.rule.ok, F.lit(False)) for m in ordered))


def all_rules(docs: DataFrame, labels: DataFrame | None, text: str = "text") -> list[Rule]:
    """The default rules and, with ``labels``, the toxicity that they teach."""
    rules = default_rules(text)
    if labels is not None:
        rules.append(toxicity_rule(toxicity(docs, labels, text), "lang" in docs.columns, text))
    return rules


def judge(docs: DataFrame, text: str = "text", sample_rows: int = 1000, labels: DataFrame | None = None) -> DataFrame:
    """``doc_id, kept`` for every row."""
    return docs.select("doc_id", cascade(docs, all_rules(docs, labels, text), text, sample_rows).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", sample_rows: int = 1000, labels: DataFrame | None = None) -> DataFrame:
    """The rows that pass, with all their columns."""
    return docs.where(cascade(docs, all_rules(docs, labels, text), text, sample_rows))
