"""Queries that review units, blocks and attempts against each other, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.functions.clean import clean_id
from corpusmill.io import table
from corpusmill.operators import ranking, redact, state as st, units as u
from corpusmill.operators.hierarchy import closure, roots
from corpusmill.operators.snapshots import snapshot_changes
from corpusmill.plans.general import _CHANGES, _TREE
from corpusmill.plans.retrieval import _STATUS, _VALID, OBSERVED, ORACLES as RETRIEVAL, V, _queries
from corpusmill.plans.state import A
from corpusmill.streaming import carried, events as ev

#: Estimated tokens that a page of ranked units may hold.
BUDGET = 600
PRIVATE = r"\b(?:10\.[0-9]{1,3}|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168)\.[0-9]{1,3}\.[0-9]{1,3}\b"


def q02_explain_units(spark: SparkSession, d: str) -> DataFrame:
    """Of every unit why it may or may not be delivered: itself, then what it inherits, then the conditions."""
    source = table(spark, d, "graded_units")
    valid = u.valid_units(source, "status", "conditions")
    state = valid.select("id", F.coalesce("status", F.lit("active")).alias("unit_status"))
    above = closure(source)
    named = above.join(state.select(F.col("id").alias("ancestor_id"), F.col("unit_status").alias("s")), "ancestor_id", "left")
    worst = named.groupBy("id").agg(
        F.max(F.col("s").isNull()).alias("lost"), F.max(F.coalesce(F.col("s") == "suspect", F.lit(False))).alias("suspect")
    )
    rows = state.join(worst, "id", "left").join(u.match_conditions(valid, OBSERVED), "id")
    verdict = (
        F.when(F.col("unit_status").isin("archived", "superseded"), "gone")
        .when(F.col("lost"), "parent_lost")
        .when(F.col("suspect"), "parent_in_doubt")
        .when(F.col("status") != "matched", F.concat(F.lit("condition_"), "status"))
        .otherwise("usable")
    )
    return rows.select("id", verdict.alias("verdict"))


def w07_budget(spark: SparkSession, d: str) -> DataFrame:
    """Of each query's twenty best units those that fit a budget, taken in order of rank; one that does not fit is skipped."""
    valid = u.valid_units(table(spark, d, "graded_units"), "title", "triggers", "body")
    ranked = ranking.top_k(ranking.bm25(ranking.header_text(valid), _queries(spark, d), parts=False), 20)
    tokens = t.token_estimate(F.coalesce("body", F.lit(""))).cast("bigint")
    sizes = u.valid_units(table(spark, d, "graded_units").withColumn("tokens", tokens), "tokens").select("id", "tokens")
    lists = ranked.join(sizes, "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "tokens"))).alias("rows"))
    state = "struct<taken: array<string>, used: bigint>"
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.lit(0).cast("bigint").alias("used")).cast(state)

    def take(s, x):
        more = F.struct(F.concat(s["taken"], F.array(x["id"])).alias("taken"), (s["used"] + x["tokens"]).alias("used"))
        return F.when(s["used"] + x["tokens"] <= BUDGET, more.cast(state)).otherwise(s)

    folded = lists.select("query_id", F.aggregate("rows", start, take).alias("s"))
    return folded.select("query_id", F.size("s.taken").alias("units"), F.col("s.used").alias("tokens"))


def j09_successors(spark: SparkSession, d: str) -> DataFrame:
    """The unit at the end of each chain of superseded_by; a chain that turns in a circle ends in ``cycle``."""
    source = table(spark, d, "graded_units")
    chained = source.withColumn("inherits_from", F.when(F.col("superseded_by").isNotNull(), F.array("superseded_by")))
    return roots(chained).where("depth != 0").select("id", F.col("root_id").alias("successor"), F.col("depth").alias("steps"))


def j18_closure_check(spark: SparkSession, d: str) -> DataFrame:
    """Delivered closures against the right ones: pairs that are in both, missing as delivered, or there by mistake."""
    source = table(spark, d, "graded_units")
    right = closure(source).select("id", "ancestor_id", F.lit(1).alias("r"))
    given = u.valid_units(source, "inherits_from_closure").select("id", F.explode("inherits_from_closure").alias("a"))
    given = given.select("id", clean_id("a").alias("ancestor_id")).where("ancestor_id != ''").distinct().withColumn("g", F.lit(1))
    state = F.when(F.col("g").isNull(), "missing").when(F.col("r").isNull(), "mistaken").otherwise("both")
    return right.join(given, ["id", "ancestor_id"], "full").groupBy(state.alias("state")).agg(F.count("*").alias("pairs"))


def q21_unadvanced(spark: SparkSession, d: str) -> DataFrame:
    """Units whose content changed between deliveries while the revision stayed."""
    changes = snapshot_changes(table(spark, d, "unit_snapshots"))
    return changes.where("changed = 'content_sha256'").select("snapshot_id", "id")


def m01_block_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Block ids that stand for more than one content or task."""
    rows = table(spark, d, "material_blocks").groupBy("block_id")
    seen = rows.agg(F.countDistinct("sha256").alias("contents"), F.countDistinct("task_id").alias("tasks"), F.count("*").alias("n"))
    return seen.where("contents > 1 or tasks > 1 or n > 1")


def m26_covered_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Attempts whose listed blocks all are described and indexed; an attempt without a list is not covered."""
    lists = st.attempts(table(spark, d, "material_summary_attempts")).select(
        "attempt_id", F.explode(F.array_distinct(F.from_json("block_ids", "array<string>"))).alias("block_id")
    )
    ready = table(spark, d, "material_blocks").groupBy("block_id").agg(F.max(F.col("indexed").cast("int")).alias("indexed"))
    per = lists.join(ready, "block_id", "left").groupBy("attempt_id")
    counted = per.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("indexed"), F.lit(0)).alias("ready"))
    return counted.where("blocks = ready").select("attempt_id", "blocks")


def m43_latest_fault(spark: SparkSession, d: str) -> DataFrame:
    """The newest attempt of each policy that is decided, and its error if it has one."""
    rows = st.attempts(table(spark, d, "material_summary_attempts")).where("status in ('returned', 'applied', 'failed')")
    last = F.max_by(F.struct("status", "error"), F.struct("updated", "attempt_id"))
    return rows.groupBy("policy_identity").agg(last.alias("r")).select("policy_identity", "r.status", "r.error")


def w10_interleaved(spark: SparkSession, d: str) -> DataFrame:
    """The three newest documents of each kind, by turns: first the newest of every kind, then the next."""
    w = Window.partitionBy("doc_kind").orderBy(F.desc("collected_at"), "doc_id")
    rows = table(spark, d, "documents").withColumn("turn", F.row_number().over(w)).where("turn <= 3")
    return rows.select("turn", "doc_kind", "doc_id")


def a21_generations(spark: SparkSession, d: str) -> DataFrame:
    """A value of the units under each path that changes with any of them: the sum of their hashes, in any order."""
    key = F.md5(F.concat_ws("|", "id", F.col("revision").cast("string"), F.coalesce("tier", F.lit(""))))
    part = F.conv(F.substring(key, 1, 12), 16, 10).cast("bigint")
    valid = u.valid_units(table(spark, d, "graded_units"), "domain_path", "tier")
    return valid.groupBy("domain_path").agg(F.count("*").alias("units"), F.sum(part).alias("generation"))


def r31_masked(spark: SparkSession, d: str) -> DataFrame:
    """Findings with their value as it may be shown."""
    rows = table(spark, d, "findings").where("value is not null").distinct()
    return rows.select("finding_id", "rule", redact.shown(F.col("value")).alias("masked"))


def r35_private_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Units and private addresses in them; the text without them."""
    hits = F.regexp_extract_all("body", F.lit(PRIVATE), F.lit(0))
    valid = u.valid_units(table(spark, d, "graded_units"), "body")
    clean = F.sha2(F.regexp_replace("body", PRIVATE, "<private-address>"), 256)
    return valid.select("id", F.size(hits).alias("n"), clean.alias("digest")).where("n > 0")


def t26_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths and whether they are relative and plain: no empty, dot or hidden part, nothing but letters, digits, - and _."""
    ok = F.coalesce(F.col("domain_path").rlike(r"^[a-z0-9_][a-z0-9_-]*(/[a-z0-9_][a-z0-9_-]*)*$"), F.lit(False))
    return u.valid_units(table(spark, d, "graded_units"), "domain_path").groupBy("domain_path", ok.alias("plain")).agg(F.count("*").alias("units"))


def e02_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose rows do not agree on title or kind."""
    rows = table(spark, d, "entries").where("entry_id is not null").groupBy("entry_id")
    return rows.agg(F.countDistinct("title").alias("titles"), F.countDistinct("kind").alias("kinds")).where("titles > 1 or kinds > 1")


def x05_streamed_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a stream, cut into pieces with ids of their own, each admitted once; pieces and bytes of each document."""
    source = table(spark, d, "documents")
    rows = spark.readStream.schema(source.schema).parquet(f"{d}/documents.parquet*").where("text != ''")
    pieces = rows.select("doc_id", F.posexplode(t.lossless_pieces("text", 16_384)).alias("pos", "piece"))
    block = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("pos").cast("string"), "piece"), 256)
    once = pieces.select("doc_id", "pos", F.octet_length("piece").alias("n_bytes"), block.alias("block_id"))
    return ev.drained(once, spark).dropDuplicates(["block_id"]).groupBy("doc_id").agg(F.sum("n_bytes").alias("n_bytes"))


def x04_carried_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Pages of documents as a stream: characters in fenced blocks, which are carried from page to page."""
    source = table(spark, d, "documents")
    rows = spark.readStream.schema(source.schema).parquet(f"{d}/documents.parquet*")
    found = ev.drained(carried.fenced_characters(carried.pages(rows.where("doc_id is not null"))), spark)
    return found.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("n_chars").alias("n_chars"), F.sum("inside").alias("inside"))


def x12_refreshed_index(spark: SparkSession, d: str) -> DataFrame:
    """Term counts of the last delivery, kept up from the one before by its changes alone: what is gone is taken away, what is new added.

    terms are the parts of ``domain_path``; the rows equal a count over the last delivery.
    """
    rows = table(spark, d, "unit_snapshots").where("snapshot_id is not null and id is not null")
    valid = rows.groupBy("snapshot_id", clean_id("id").alias("id")).agg(F.max(F.struct("delivered_at", "revision", "domain_path")).alias("r"))
    ids = [r[0] for r in rows.select("snapshot_id").distinct().orderBy(F.desc("snapshot_id")).limit(2).collect()]  # two deliveries
    terms = valid.where(F.col("snapshot_id").isin(ids)).select(
        "id", (F.col("snapshot_id") == max(ids, default=0)).alias("new"), F.explode(F.split(F.coalesce("r.domain_path", F.lit("")), "/")).alias("term")
    )
    old = terms.where("not new").groupBy("term").agg(F.count("*").alias("n"))
    mark = terms.groupBy("id", "term").agg((F.count_if("new") - F.count_if(~F.col("new"))).alias("change")).where("change != 0")
    delta = mark.groupBy("term").agg(F.sum("change").alias("change"))
    kept = old.join(delta, "term", "full").select("term", (F.coalesce("n", F.lit(0)) + F.coalesce("change", F.lit(0))).alias("n"))
    return kept.where("n > 0")


QUERIES = {
    q.__name__: q
    for q in (
        q02_explain_units, w07_budget, j09_successors, j18_closure_check, q21_unadvanced, m01_block_conflicts,
        m26_covered_attempts, m43_latest_fault, w10_interleaved, a21_generations, r31_masked, r35_private_addresses, t26_paths,
        e02_disagreements, x04_carried_blocks, x05_streamed_pieces, x12_refreshed_index,
    )
}

_FULL = _VALID.replace("valid AS", "full_rows AS")
_CHAIN = _TREE.replace("inherits_from FROM graded_units", "CASE WHEN superseded_by IS NOT NULL THEN [superseded_by] END AS inherits_from FROM graded_units")
_FULL_STATUS = _STATUS.replace("FROM valid)", "FROM full_rows)")
ORACLES = {
    "q02_explain_units": _TREE + "," + _FULL + "," + _FULL_STATUS + """, w AS (SELECT n.id, bool_or(f.id IS NULL) AS lost, bool_or(coalesce(f.status = 'suspect', false)) AS suspect
        FROM near n LEFT JOIN full_rows f ON f.id = n.ancestor_id WHERE n.id NOT IN (SELECT id FROM bad) GROUP BY 1)
      SELECT f.id, CASE WHEN f.status IN ('archived', 'superseded') THEN 'gone' WHEN w.lost THEN 'parent_lost' WHEN w.suspect THEN 'parent_in_doubt'
        WHEN a.status <> 'matched' THEN 'condition_' || a.status ELSE 'usable' END AS verdict FROM full_rows f JOIN applied a USING (id) LEFT JOIN w ON w.id = f.id""",
    "w07_budget": "WITH RECURSIVE " + RETRIEVAL["a02_bm25_topk"].strip()[5:].rsplit("SELECT *, row_number()", 1)[0] + f""", top AS (SELECT query_id, id,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 20),
      sized AS (SELECT query_id, rank, ceil(octet_length(encode(coalesce(body, ''))) / 4)::BIGINT AS n FROM top JOIN valid USING (id)),
      fold AS (SELECT query_id, rank, CASE WHEN n <= {BUDGET} THEN 1 ELSE 0 END AS units, CASE WHEN n <= {BUDGET} THEN n ELSE 0 END AS used FROM sized WHERE rank = 1
        UNION ALL SELECT s.query_id, s.rank, CASE WHEN f.used + n <= {BUDGET} THEN f.units + 1 ELSE f.units END, CASE WHEN f.used + n <= {BUDGET} THEN f.used + n ELSE f.used END
        FROM fold f JOIN sized s ON s.query_id = f.query_id AND s.rank = f.rank + 1)
      SELECT query_id, max(units)::INT AS units, max(used)::BIGINT AS tokens FROM fold GROUP BY 1""",
    "j09_successors": _CHAIN + """SELECT id, 'cycle' AS successor, -1::INT AS steps FROM valid WHERE id IN (SELECT id FROM bad)
      UNION ALL SELECT id, ancestor_id, depth::INT FROM near WHERE ancestor_id NOT IN (SELECT child FROM links) AND id NOT IN (SELECT id FROM bad)""",
    "j18_closure_check": _TREE + "," + _FULL + r""", given AS (SELECT DISTINCT id, lower(regexp_replace(a, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS ancestor_id
        FROM (SELECT id, unnest(inherits_from_closure) AS a FROM full_rows) WHERE a IS NOT NULL AND trim(a) <> ''),
      right_ones AS (SELECT id, ancestor_id FROM near WHERE id NOT IN (SELECT id FROM bad))
      SELECT CASE WHEN g.id IS NULL THEN 'missing' WHEN r.id IS NULL THEN 'mistaken' ELSE 'both' END AS state, count(*) AS pairs
      FROM right_ones r FULL JOIN given g ON g.id = r.id AND g.ancestor_id = r.ancestor_id GROUP BY 1""",
    "q21_unadvanced": _CHANGES + "SELECT snapshot_id, id FROM deltas WHERE both_there AND dig AND NOT rev",
    "m01_block_conflicts": "SELECT block_id, count(DISTINCT sha256) AS contents, count(DISTINCT task_id) AS tasks, count(*) AS n FROM material_blocks GROUP BY 1 HAVING contents > 1 OR tasks > 1 OR n > 1",
    "m26_covered_attempts": A + """, l AS (SELECT DISTINCT attempt_id, unnest(block_ids::JSON::VARCHAR[]) AS block_id FROM att WHERE json_valid(block_ids) AND json_type(block_ids) = 'ARRAY'),
      r AS (SELECT block_id, bool_or(indexed) AS indexed FROM material_blocks GROUP BY 1)
      SELECT attempt_id, count(*) AS blocks FROM l LEFT JOIN r USING (block_id) GROUP BY 1 HAVING count(*) = count(*) FILTER (WHERE indexed)""",
    "m43_latest_fault": A + """SELECT policy_identity, status, error FROM att WHERE status IN ('returned', 'applied', 'failed')
      QUALIFY row_number() OVER (PARTITION BY policy_identity ORDER BY updated DESC, attempt_id DESC) = 1""",
    "w10_interleaved": "SELECT row_number() OVER (PARTITION BY doc_kind ORDER BY collected_at DESC NULLS LAST, doc_id)::INT AS turn, doc_kind, doc_id FROM documents QUALIFY turn <= 3",
    "a21_generations": V + "SELECT domain_path, count(*) AS units, sum(('0x' || substr(md5(concat_ws('|', id, revision::VARCHAR, coalesce(tier, ''))), 1, 12))::BIGINT)::BIGINT AS generation FROM valid GROUP BY 1",
    "r31_masked": "SELECT finding_id, rule, CASE WHEN length(value) > 6 THEN left(value, 1) || '*' || right(value, 1) ELSE '*' END || ' ' || length(value) || ' ' || left(sha256(value), 8) AS masked FROM (SELECT DISTINCT * FROM findings WHERE value IS NOT NULL)",
    "r35_private_addresses": V + f"SELECT id, len(regexp_extract_all(body, '{PRIVATE}'))::INT AS n, sha256(regexp_replace(body, '{PRIVATE}', '<private-address>', 'g')) AS digest FROM valid WHERE regexp_matches(body, '{PRIVATE}')",
    "t26_paths": V + "SELECT domain_path, coalesce(regexp_matches(domain_path, '^[a-z0-9_][a-z0-9_-]*(/[a-z0-9_][a-z0-9_-]*)*$'), false) AS plain, count(*) AS units FROM valid GROUP BY ALL",
    "e02_disagreements": "SELECT entry_id, count(DISTINCT title) AS titles, count(DISTINCT kind) AS kinds FROM entries WHERE entry_id IS NOT NULL GROUP BY 1 HAVING titles > 1 OR kinds > 1",
    "x04_carried_blocks": """WITH p AS (SELECT doc_id, length(text) AS n, string_split(text, '```') AS parts FROM documents WHERE text <> '')
      SELECT doc_id, ceil(n / 2000)::BIGINT AS pages, n AS n_chars, coalesce(list_sum(list_transform(range(2, len(parts) + 1, 2), lambda i: length(parts[i]))), 0)::BIGINT AS inside FROM p""",
    "x12_refreshed_index": r"""WITH l AS (SELECT domain_path FROM unit_snapshots WHERE id IS NOT NULL AND snapshot_id = (SELECT max(snapshot_id) FROM unit_snapshots WHERE id IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) ORDER BY delivered_at DESC NULLS LAST, revision DESC NULLS LAST, domain_path DESC NULLS LAST) = 1)
      SELECT term, count(*) AS n FROM (SELECT unnest(string_split(coalesce(domain_path, ''), '/')) AS term FROM l) GROUP BY 1""",
    "x05_streamed_pieces": "SELECT doc_id, octet_length(encode(text)) AS n_bytes FROM documents WHERE text <> ''",
}
