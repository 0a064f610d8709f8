"""Queries of the general problems: snapshot changes and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.io import table
from corpusmill.operators.hierarchy import back_edges, closure, paths, roots
from corpusmill.operators.snapshots import snapshot_changes


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "unit_snapshots")).select("snapshot_id", "id", "delta")


def p1_changed_columns(spark: SparkSession, d: str) -> DataFrame:
    changes = snapshot_changes(table(spark, d, "unit_snapshots"))
    return changes.groupBy("snapshot_id", "delta", "changed").agg(F.count("*").alias("n"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return roots(table(spark, d, "graded_units"))


def p2_closure(spark: SparkSession, d: str) -> DataFrame:
    return closure(table(spark, d, "graded_units"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Of each unit or missing parent with children: how many stand below it, and how far the nearest way to the last."""
    return (
        p2_closure(spark, d)
        .groupBy(F.col("ancestor_id").alias("id"))
        .agg(F.count("*").alias("descendants"), F.max("depth").alias("height"))
    )


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return paths(table(spark, d, "graded_units")).withColumn("path", F.array_join("path", "/"))


def p2_back_edges(spark: SparkSession, d: str) -> DataFrame:
    return back_edges(table(spark, d, "graded_units"))


def p2_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Of each unit on a cycle how many of its parents are on it too."""
    return p2_back_edges(spark, d).groupBy("id").agg(F.count("*").alias("links"))


QUERIES = {q.__name__: q for q in (p1_found, p1_changed_columns, p2_found, p2_closure, p2_descendants, p2_paths, p2_back_edges, p2_cycles)}

SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
_CHANGES = rf"""
WITH clean AS (
  SELECT snapshot_id, lower(regexp_replace(id, '{SPACE}', '', 'g')) AS id, delivered_at, revision,
    nullif(regexp_replace(lower(regexp_replace(content_sha256, '{SPACE}', '', 'g')), '^sha256:\s*', ''), '') AS digest
  FROM unit_snapshots WHERE snapshot_id IS NOT NULL AND id IS NOT NULL),
latest AS (
  SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY snapshot_id, id
    ORDER BY delivered_at DESC NULLS LAST, revision DESC NULLS LAST, digest DESC NULLS LAST) = 1),
seq AS (SELECT snapshot_id, lead(snapshot_id) OVER (ORDER BY snapshot_id) AS next_id
  FROM (SELECT DISTINCT snapshot_id FROM latest)),
a AS (SELECT seq.next_id AS snapshot_id, latest.* EXCLUDE (snapshot_id) FROM latest JOIN seq USING (snapshot_id)
  WHERE next_id IS NOT NULL),
b AS (SELECT * FROM latest WHERE snapshot_id > (SELECT min(snapshot_id) FROM latest)),
deltas AS (
  SELECT coalesce(a.snapshot_id, b.snapshot_id) AS snapshot_id, coalesce(a.id, b.id) AS id,
    CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS delta,
    a.id IS NOT NULL AND b.id IS NOT NULL AS both_there,
    a.revision IS DISTINCT FROM b.revision AS rev, coalesce(a.digest <> b.digest, false) AS dig
  FROM a FULL JOIN b ON a.snapshot_id = b.snapshot_id AND a.id = b.id)
"""
_TREE = rf"""
WITH RECURSIVE valid AS (
  SELECT lower(regexp_replace(id, '{SPACE}', '', 'g')) AS id, inherits_from FROM graded_units WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(id, '{SPACE}', '', 'g')) ORDER BY revision DESC NULLS LAST) = 1),
links AS (
  SELECT DISTINCT id AS child, lower(regexp_replace(p, '{SPACE}', '', 'g')) AS parent
  FROM (SELECT id, unnest(inherits_from) AS p FROM valid)
  WHERE p IS NOT NULL AND regexp_replace(p, '{SPACE}', '', 'g') <> ''),
reach AS (
  SELECT child AS id, parent AS ancestor_id FROM links
  UNION SELECT r.id, l.parent FROM reach r JOIN links l ON l.child = r.ancestor_id),
loops AS (SELECT id FROM reach WHERE id = ancestor_id),
bad AS (SELECT id FROM loops UNION SELECT id FROM reach WHERE ancestor_id IN (SELECT id FROM loops)),
above AS (
  SELECT child AS id, parent AS ancestor_id, 1 AS depth FROM links WHERE child NOT IN (SELECT id FROM bad)
  UNION SELECT a.id, l.parent, a.depth + 1 FROM above a JOIN links l ON l.child = a.ancestor_id),
near AS (SELECT id, ancestor_id, min(depth) AS depth FROM above GROUP BY 1, 2)
"""
ORACLES = {
    "p1_found": _CHANGES + "SELECT snapshot_id, id, delta FROM deltas WHERE NOT both_there OR rev OR dig",
    "p1_changed_columns": _CHANGES
    + """SELECT snapshot_id, delta, CASE WHEN NOT both_there THEN NULL WHEN rev AND dig THEN 'revision,content_sha256'
    WHEN rev THEN 'revision' ELSE 'content_sha256' END AS changed, count(*) AS n
    FROM deltas WHERE NOT both_there OR rev OR dig GROUP BY ALL""",
    "p2_found": _TREE
    + """SELECT id, 'cycle' AS root_id, -1::INT AS depth FROM valid WHERE id IN (SELECT id FROM bad)
    UNION ALL SELECT id, id, 0::INT FROM valid WHERE id NOT IN (SELECT child FROM links)
    UNION ALL SELECT id, ancestor_id, depth::INT FROM near
    WHERE ancestor_id NOT IN (SELECT child FROM links) AND id NOT IN (SELECT id FROM bad)""",
    "p2_closure": _TREE
    + "SELECT id, ancestor_id, depth::INT AS depth FROM near WHERE id NOT IN (SELECT id FROM bad)",
    "p2_paths": _TREE
    + """, tops AS (SELECT id, 0 AS depth FROM valid WHERE id NOT IN (SELECT child FROM links)
      UNION ALL SELECT id, min(depth) FROM near WHERE ancestor_id NOT IN (SELECT child FROM links) GROUP BY 1),
    via AS (SELECT t.id, l.parent FROM tops t JOIN links l ON l.child = t.id LEFT JOIN tops u ON u.id = l.parent
      QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY coalesce(u.depth, 0), l.parent) = 1),
    ways AS (SELECT id, id AS top, depth, id AS path FROM tops
      UNION ALL SELECT w.id, v.parent, w.depth, v.parent || '/' || w.path FROM ways w JOIN via v ON v.id = w.top)
    SELECT id, top AS root_id, depth::INT AS depth, path FROM ways WHERE top NOT IN (SELECT id FROM via)
    UNION ALL SELECT id, 'cycle', -1, NULL FROM valid WHERE id IN (SELECT id FROM bad)""",
    "p2_back_edges": _TREE
    + """SELECT child AS id, parent FROM links l
    WHERE child = parent OR EXISTS (SELECT 1 FROM reach r WHERE r.id = l.parent AND r.ancestor_id = l.child)""",
    "p2_cycles": _TREE
    + """SELECT child AS id, count(*) AS links FROM links l
    WHERE child = parent OR EXISTS (SELECT 1 FROM reach r WHERE r.id = l.parent AND r.ancestor_id = l.child) GROUP BY 1""",
    "p2_descendants": _TREE
    + """SELECT ancestor_id AS id, count(*) AS descendants, max(depth)::INT AS height FROM near
    WHERE id NOT IN (SELECT id FROM bad) GROUP BY 1""",
}
