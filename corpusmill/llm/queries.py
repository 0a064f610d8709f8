"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.io import table, texts
from corpusmill.llm import bpe, leakage, neardup, pii, reading, split


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    spans = pii.personal_spans(pii.text_parts(spark, d), chinese=pii.text_parts(spark, d, chinese=True))
    return spans.select("record_table", "record_id", F.col("kind").alias("pii_kind"), F.col("value").alias("pii_value")).distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    parts = pii.text_parts(spark, d)
    return pii.redacted(parts, pii.personal_spans(parts, chinese=pii.text_parts(spark, d, chinese=True)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split.split_texts(split.oversized_units(table(spark, d, "graded_units")), "id", "body")
    lists = split.split_lists(table(spark, d, "material_summary_attempts"), table(spark, d, "material_blocks"))
    units = pieces.where("pieces > 1 and pos = 0").select(F.lit("graded_units").alias("record_table"), F.col("id").alias("record_id"))
    attempts = lists.where("size(sublists) > 1").select(
        F.lit("material_summary_attempts").alias("record_table"), F.col("attempt_id").alias("record_id")
    )
    return units.unionByName(attempts).distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_texts(split.oversized_units(table(spark, d, "graded_units")), "id", "body")


def p4_sublists(spark: SparkSession, d: str) -> DataFrame:
    lists = split.split_lists(table(spark, d, "material_summary_attempts"), table(spark, d, "material_blocks"))
    return lists.where("size(sublists) > 1").select("attempt_id", F.posexplode("sublists").alias("pos", "block_ids"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(texts(spark, d, "graded_units"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_groups(texts(spark, d, "graded_units"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(texts(spark, d, "documents"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(texts(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("share >= 0.5").select("doc_id", "case_id").distinct()


def p7_edited(spark: SparkSession, d: str) -> DataFrame:
    """Leaks that come out with edits only: half of the passage stands in windows with few edits, but not in whole runs."""
    return _leaks(spark, d).where("share < 0.5").select("doc_id", "case_id", F.round("covered", 6).alias("covered"), "distance")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Of each leaked item: documents that hold it, and the largest share."""
    found = _leaks(spark, d).where("share >= 0.5")
    return found.groupBy("case_id").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.max("share"), 6).alias("share"))


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(
        texts(spark, d, "documents"), table(spark, d, "reading_labels"), table(spark, d, "eval_items")
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_levels(spark, d).where("reading_level = 'expert'").select("doc_id")


QUERIES = {q.__name__: q for q in (p3_found, p3_redacted, p4_found, p4_pieces, p4_sublists, p5_found, p5_groups, p6_ids, p7_found, p7_edited, p7_items, p8_levels, p8_found)}

SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"

def _words(text: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower({text}), '([\x{{3400}}-\x{{9fff}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"


_LEAKS = rf"""
WITH items AS (SELECT case_id, w, len(w) AS n,
    CASE WHEN 2 * len(list_filter(w, lambda x: regexp_matches(x, '[\x{{3400}}-\x{{9fff}}]'))) > len(w) THEN 32 ELSE 16 END AS run
  FROM (SELECT DISTINCT case_id, {_words("passage")} AS w FROM eval_items WHERE passage IS NOT NULL)),
runs AS (SELECT case_id, n, run, i, w[i:i+run-1] AS g FROM (SELECT *, unnest(range(1, n - run + 2)) AS i FROM items WHERE n >= run)),
docs AS (SELECT doc_id, {_words("text")} AS w FROM documents WHERE text IS NOT NULL),
here AS (SELECT DISTINCT doc_id, run, w[i:i+run-1] AS g FROM (SELECT *, unnest(range(1, len(w) - run + 2)) AS i
  FROM docs, (VALUES (16), (32)) r(run) WHERE len(w) >= run)),
covered AS (SELECT DISTINCT doc_id, case_id, n, unnest(range(i, i + runs.run)) AS p FROM runs JOIN here ON here.run = runs.run AND here.g = runs.g),
leaks AS (SELECT doc_id, case_id, count(*) / n AS share FROM covered GROUP BY doc_id, case_id, n HAVING 2 * count(*) >= n)
"""

ORACLES = {
    "p5_found": rf"""
WITH valid AS (SELECT lower(regexp_replace(id, '{SPACE}', '', 'g')) AS id, body FROM graded_units WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(id, '{SPACE}', '', 'g')) ORDER BY revision DESC NULLS LAST) = 1),
words AS (SELECT id, {_words("body")} AS w FROM valid WHERE body IS NOT NULL),
grams AS (SELECT DISTINCT id, w[i:i+4] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 20)),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY 1),
common AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM common JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b WHERE c >= 0.5 * (x.n + y.n - c)""",
    "p7_found": _LEAKS + "SELECT doc_id, case_id FROM leaks",
    "p7_items": _LEAKS + "SELECT case_id, count(DISTINCT doc_id) AS documents, round(max(share), 6) AS share FROM leaks GROUP BY 1",
    "p4_found": rf"""
WITH valid AS (SELECT lower(regexp_replace(id, '{SPACE}', '', 'g')) AS id, body FROM graded_units WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(id, '{SPACE}', '', 'g')) ORDER BY revision DESC NULLS LAST) = 1),
lists AS (SELECT DISTINCT attempt_id, try_cast(block_ids AS JSON)::VARCHAR[] AS ids FROM material_summary_attempts
  WHERE json_valid(block_ids) AND json_type(block_ids) = 'ARRAY'),
blocks AS (SELECT block_id, max(n_bytes) AS n FROM material_blocks GROUP BY 1),
sums AS (SELECT attempt_id, sum(n) AS n FROM (SELECT DISTINCT attempt_id, unnest(ids) AS block_id FROM lists)
  LEFT JOIN blocks USING (block_id) GROUP BY 1)
SELECT DISTINCT 'graded_units' AS record_table, id AS record_id FROM valid WHERE octet_length(encode(body)) > 16384
UNION ALL
SELECT DISTINCT 'material_summary_attempts', attempt_id FROM lists JOIN sums USING (attempt_id)
WHERE len(ids) > 8 OR n > 65536""",
}
