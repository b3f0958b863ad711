"""The operators over the driver's tables, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontaminate, htmltemplate, linededup, minhash, packing, pii, quality, repeats, simhash, tokencount
from lodestar.llm.common import fresh_dir, load


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_spans(load(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an empty cache of its own: all distinct texts are encoded, whatever ran before
    return tokencount.token_counts(load(spark, sf_dir, "documents"), fresh_dir(spark, "token-counts"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(load(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(load(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.good_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltemplate.extract(load(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(load(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.similar_documents(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_pii, op3_token_counts, op4_simhash, op5_repeats, op6_quality, op7_decontaminate, op8_html, op9_line_dedup, op10_minhash)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (doc_id, w): the words of each text, ASCII letters folded.
_WORDS = f"""SELECT doc_id, text, list_filter(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '[ \\t\\n\\r\\v\\f]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL"""

ORACLE: dict[str, str] = {
    # every window of 50 words that occurs more than once, and the runs of words that such windows cover
    "op5_repeats": f"""
WITH docs AS ({_WORDS}),
windows AS (SELECT doc_id, unnest(range(0, len(w) - 49)) AS pos, w FROM docs WHERE len(w) >= 50),
keyed AS (SELECT doc_id, pos, md5(array_to_string(w[pos + 1 : pos + 50], ' ')) AS key FROM windows),
marked AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM keyed) WHERE n > 1),
steps AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS fresh FROM marked),
runs AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM steps)
SELECT doc_id, min(pos) AS start, max(pos) + 50 AS stop FROM runs GROUP BY doc_id, run""",
    # exact Jaccard of all different texts that share a shingle; each stands for its documents through the smallest id
    "op10_minhash": f"""
WITH RECURSIVE docs AS ({_WORDS}),
classes AS (SELECT min(doc_id) AS rep, any_value(w) AS w, text FROM docs WHERE len(w) > 0 GROUP BY text),
shingles AS (SELECT DISTINCT rep, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS g FROM classes),
sizes AS (SELECT rep, count(*) AS n FROM shingles GROUP BY rep),
shared AS (SELECT a.rep AS doc_a, b.rep AS doc_b, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
pairs AS MATERIALIZED (SELECT doc_a, doc_b FROM shared s JOIN sizes x ON x.rep = doc_a JOIN sizes y ON y.rep = doc_b WHERE s.n / CAST(x.n + y.n - s.n AS DOUBLE) >= 0.5),
edges AS MATERIALIZED (SELECT doc_a AS a, doc_b AS b FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs),
reach AS (SELECT DISTINCT a AS x, a AS y FROM edges UNION SELECT x, b FROM reach JOIN edges ON a = y),
roots AS (SELECT x AS rep, min(y) AS root FROM reach GROUP BY x),
counts AS (SELECT a AS rep, count(*) AS links FROM edges GROUP BY a)
SELECT doc_id, coalesce(root, c.rep) AS class_id, coalesce(links, 0) AS links
FROM docs d JOIN classes c ON c.text = d.text LEFT JOIN roots r ON r.rep = c.rep LEFT JOIN counts n ON n.rep = c.rep""",
}
