"""The queries of this subpackage over the whole tables, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, hamming, language, license_texts, licenses, mixing, near_dedup, packing, quality, suffix_dedup, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.curriculum(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), labels=_table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op9_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest(_table(spark, sf_dir, "embeddings"), asks=F.col("vec_id") % 20 == 0)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.expand(_table(spark, sf_dir, "conversations"))


QUERIES = {q.__name__: q for q in (op1_packing, op2_near_dedup, op3_mixing, op4_suffix_dedup, op5_quality, op6_token_counts, op7_licenses, op8_language, op9_hamming, op10_chat)}

ORACLES: dict[str, str] = {}

# '*' stands for all languages.
ORACLES["op5_quality"] = rf"""
WITH marked AS (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
all_ AS (SELECT doc_id, min(lang) AS lang, min(toxic) AS toxic, min(text) AS text FROM documents JOIN marked USING (doc_id) WHERE length(trim(text)) > 0 GROUP BY doc_id),
r AS (SELECT * FROM all_ WHERE coalesce(lang, '') IN (SELECT coalesce(lang, '') FROM all_ GROUP BY lang ORDER BY count(*) DESC, lang NULLS FIRST LIMIT {quality.Fit.languages})
      QUALIFY row_number() OVER (PARTITION BY lang, toxic ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= CASE toxic WHEN 1 THEN {quality.Fit.toxic_rows} ELSE {quality.Fit.clean_rows} END),
g AS (SELECT lang AS g, * FROM r WHERE lang IS NOT NULL UNION ALL SELECT '*' AS g, * FROM r),
h AS (SELECT *, (row_number() OVER (PARTITION BY g, toxic ORDER BY doc_id) - 1) % 2 AS half FROM g),
w AS (SELECT g, doc_id, toxic, half, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+'))) AS word FROM h),
fits AS (SELECT DISTINCT g, fit FROM h, range(0, 3) f(fit) WHERE g IN (SELECT g FROM h GROUP BY g HAVING min(toxic) = 0 AND max(toxic) = 1)),
sizes AS (SELECT g, fit, count(DISTINCT CASE WHEN toxic = 1 THEN doc_id END) AS nt, count(DISTINCT CASE WHEN toxic = 0 THEN doc_id END) AS nc
          FROM w JOIN fits USING (g) WHERE half <> fit GROUP BY ALL),
counts AS (SELECT g, fit, word, sum(toxic) AS t, sum(1 - toxic) AS c FROM w JOIN fits USING (g) WHERE half <> fit GROUP BY ALL),
lows AS (SELECT g, fit, word, t, ln((t + 0.5) / (nt + 1)) - ln((c + 0.5) / (nc + 1)) - 1.64 * sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) AS low FROM counts JOIN sizes USING (g, fit)),
weights AS (SELECT * FROM lows WHERE t >= 3 AND low >= 1 QUALIFY row_number() OVER (PARTITION BY g, fit ORDER BY low DESC, word) <= 500),
scores AS (SELECT h.g, h.doc_id, h.toxic, coalesce(sum(low), 0) AS score FROM h JOIN fits ON h.g = fits.g AND fits.fit = h.half
           LEFT JOIN w ON w.g = h.g AND w.doc_id = h.doc_id LEFT JOIN weights x ON x.g = h.g AND x.fit = fits.fit AND x.word = w.word GROUP BY ALL),
cleans AS (SELECT g, list_sort(list(score)) AS c FROM scores WHERE toxic = 0 GROUP BY g),
limits AS (SELECT g, c[len(c) - CAST(floor(0.005 * len(c)) AS BIGINT)] AS above, greatest(2.0, median(score) / 3) AS least FROM scores JOIN cleans USING (g) WHERE toxic = 1 GROUP BY ALL),
d AS (SELECT *, row_number() OVER () AS rid FROM documents),
of AS (SELECT rid, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+'))) AS word, CASE WHEN lang IN (SELECT g FROM limits) THEN lang ELSE '*' END AS g FROM d),
toxic AS (SELECT rid FROM of JOIN weights USING (g, word) JOIN limits USING (g) WHERE fit = 2 GROUP BY rid, above, least HAVING sum(low) > above AND sum(low) >= least)
SELECT doc_id, coalesce(
  regexp_matches(text, '\S')
  AND rid NOT IN (SELECT rid FROM toxic)
  AND len(regexp_extract_all(text, '[#$%&*]{{2,}}')) <= 0.015 * length(text)
  AND length(text) - length(replace(text, '|', '')) <= 0.015 * length(text)
  AND (length(text) < 50 OR len(regexp_extract_all(text, '\p{{Lu}}')) <= 0.3 * length(text))
  AND len(list_distinct(string_split(text, chr(10)))) >= 0.5 * len(string_split(text, chr(10)))
  AND len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) <= 0.2 * len(w)
  AND (length(text) < 50 OR len(regexp_extract_all(text, '[^\p{{L}}\s]')) <= 0.4 * length(text))
  AND len(regexp_extract_all(lower(text), '\b({'|'.join(quality.BLOCKLIST)})\b')) < 2, false) AS kept
FROM (SELECT *, regexp_extract_all(text, '\S+') AS w FROM d)
"""

ORACLES["op3_mixing"] = """
WITH r AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(text, '\\S+')) AS n_tokens,
         ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT AS h
  FROM documents WHERE doc_id IS NOT NULL),
rows_ AS (SELECT * FROM r WHERE n_tokens > 0),
total AS (SELECT sum(n_tokens)::DOUBLE AS budget FROM rows_),
laid AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY h, doc_id, n_tokens
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rows_),
supply AS (SELECT source, sum(n_tokens) AS tokens FROM rows_ GROUP BY source),
w AS (SELECT source, tokens, knot, pow(tokens::DOUBLE, 1.0 - (1.0 - 0.5) * knot / 4) AS weight FROM supply, range(0, 5) k(knot)),
shares AS (SELECT *, weight / sum(weight) OVER (PARTITION BY knot) AS share FROM w),
nexts AS (SELECT *, lead(share) OVER (PARTITION BY source ORDER BY knot) AS nxt FROM shares),
areas AS (SELECT nexts.*, budget, (share + nxt) * (0.5 * 0.25 * budget) AS area FROM nexts, total WHERE nxt IS NOT NULL),
untils AS (SELECT *, sum(area) OVER (PARTITION BY source ORDER BY knot) AS until FROM areas),
seg AS (SELECT source, tokens, budget, knot * 0.25 AS t0, share, (nxt - share) / 0.25 AS slope,
        coalesce(lag(until) OVER (PARTITION BY source ORDER BY knot), 0.0) AS from_tokens, until FROM untils),
demand AS (SELECT source, tokens, max(until) AS demand FROM seg GROUP BY ALL),
places AS (
  SELECT doc_id, source, n_tokens, start + epoch * tokens AS pos, epoch
  FROM laid JOIN demand USING (source),
       LATERAL (SELECT unnest(range(0, CAST(floor((demand - start - 1e-6) / tokens) AS BIGINT) + 1)) AS epoch)
  WHERE start + 1e-6 < demand),
found AS (
  SELECT p.*, t0, share, slope, (pos - from_tokens) / budget AS need
  FROM places p JOIN seg ON p.source = seg.source AND pos >= from_tokens AND pos < until)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch,
       CAST(floor((t0 + 2.0 * need / (share + sqrt(greatest(share * share + 2.0 * slope * need, 0.0)))) * 1000000000) AS BIGINT) AS position,
       CAST(n_tokens AS BIGINT) AS n_tokens
FROM found
"""

ORACLES["op4_suffix_dedup"] = """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f\\v]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 49], ' ') AS passage
      FROM t, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)),
f AS (SELECT doc_id, pos, first_value(doc_id) OVER p AS src_doc, first_value(pos) OVER p AS src_at
      FROM s WINDOW p AS (PARTITION BY passage ORDER BY doc_id, pos)),
m AS (SELECT * FROM f WHERE (doc_id, pos) <> (src_doc, src_at)),
n AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS new FROM m),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM n)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS start_word, CAST(max(pos) + 50 AS BIGINT) AS end_word, arg_min(src_doc, pos) AS src_doc_id
FROM r GROUP BY doc_id, run
"""

ORACLES["op10_chat"] = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT *, row_number() OVER w - 1 AS n_context,
             coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '')
               OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')
               || '<|assistant|>' || chr(10) AS prompt
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, turn, n_context, prompt, text || '<|end|>' || chr(10) AS target, length(prompt) AS trainable_from
FROM o WHERE role = 'assistant' AND text <> ''
"""

ORACLES["op9_hamming"] = """
WITH c AS (SELECT vec_id, min(array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN embedding[65 - i] > 0 THEN '1' ELSE '0' END), '')) AS code
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY vec_id),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, CAST(bit_count(xor(a.code::BIT, b.code::BIT)) AS INTEGER) AS distance
      FROM c a JOIN c b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d)
SELECT * FROM r WHERE rank <= 10
"""

_split = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower())
_must_values = ", ".join(f"('{n}', {i})" for n, t in licenses.TEMPLATES.items() for i in license_texts.telling(_split(t)))
_template_values = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in licenses.TEMPLATES.items())
ORACLES["op7_licenses"] = rf"""
WITH t AS (SELECT license, regexp_extract_all(lower(body), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM (VALUES {_template_values}) v(license, body)),
tg AS (SELECT license, len(w) AS size, i - 1 AS tp, array_to_string(w[i:i + 2], ' ') AS gram FROM t, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
dg AS (SELECT doc_id, i - 1 AS dp, array_to_string(w[i:i + 2], ' ') AS gram FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
hits AS (SELECT DISTINCT doc_id, license, size, dp - tp AS diagonal, tp FROM dg JOIN tg USING (gram)),
votes AS (SELECT DISTINCT doc_id, license, size, diagonal FROM hits),
steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= greatest(1, least(8, size // 4)) THEN 0 ELSE 1 END AS step
          FROM votes WINDOW w AS (PARTITION BY doc_id, license ORDER BY diagonal)),
runs AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, license ORDER BY diagonal) AS span FROM steps),
cover AS (SELECT doc_id, license, size, span, tp + k AS tw, tp + diagonal + k AS dw FROM hits JOIN runs USING (doc_id, license, size, diagonal), range(0, 3) r(k)),
spans AS (SELECT doc_id, license, size, span, count(DISTINCT tw) AS matched, count(DISTINCT dw) AS words, min(dw) AS start_word, max(dw) + 1 AS end_word
          FROM cover GROUP BY ALL),
must(license, tw) AS (VALUES {_must_values}),
told AS (SELECT doc_id, license, size, span, count(DISTINCT tw) AS told FROM cover JOIN must USING (license, tw) GROUP BY ALL),
need AS (SELECT license, count(*) AS need FROM must GROUP BY license),
good AS (SELECT s.*, row_number() OVER (PARTITION BY doc_id ORDER BY matched DESC, matched / size DESC, license, start_word) AS place
         FROM spans s LEFT JOIN told USING (doc_id, license, size, span) LEFT JOIN need USING (license)
         WHERE matched >= 0.8 * size AND words >= 0.8 * (end_word - start_word) AND coalesce(told, 0) = coalesce(need, 0))
SELECT doc_id, license, CAST(start_word AS BIGINT) AS start_word, CAST(end_word AS BIGINT) AS end_word, matched, CAST(size AS BIGINT) AS template_words
FROM good g WHERE NOT EXISTS (SELECT 1 FROM good b WHERE b.doc_id = g.doc_id AND b.place < g.place AND b.start_word < g.end_word AND g.start_word < b.end_word)
"""
