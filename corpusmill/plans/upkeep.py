"""Queries that keep a corpus in order: checks, references, histories; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.functions.clean import clean_id
from corpusmill.io import table
from corpusmill.operators import state as st, units as u
from corpusmill.operators.hierarchy import closure
from corpusmill.plans.general import _TREE
from corpusmill.plans.retrieval import LEX, V
from corpusmill.plans.state import A

# A reference names a source and a revision of it.
REFERENCE = r"[a-z0-9_-]+/[a-z0-9_-]+@[0-9a-f]{4,40}"


def t11_citations(spark: SparkSession, d: str) -> DataFrame:
    """References in each document, each once, in order of their first place."""
    refs = F.array_distinct(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(0)))
    return table(spark, d, "documents").select("doc_id", F.size(refs).alias("n"), F.array_join(refs, " ").alias("refs")).where("n > 0")


def t12_body_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Distinct lexemes of each document beside its references."""
    rest = F.regexp_replace(F.lower("text"), REFERENCE, " ")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.array_distinct(t.lexemes(rest))).alias("tokens"))


def t13_short_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of blocks cut to their first six characters: the block it stands for, or nothing where it is ambiguous."""
    ids = table(spark, d, "material_blocks").where("block_id is not null").select("block_id").distinct()
    found = ids.groupBy(F.substring("block_id", 1, 6).alias("short")).agg(F.count("*").alias("n"), F.min("block_id").alias("block_id"))
    return found.select("short", F.when(F.col("n") == 1, F.col("block_id")).alias("block_id"), "n")


def t21_framework_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of frameworks in conditions, runs of - _ . written as one dash, in lower case."""
    valid = u.valid_units(table(spark, d, "graded_units"), "conditions")
    names = valid.select(F.explode(F.map_keys(F.from_json(F.get_json_object("conditions", "$.framework"), "map<string,string>"))).alias("name"))
    return names.groupBy(F.regexp_replace(F.lower("name"), "[-_.]+", "-").alias("name")).agg(F.count("*").alias("units"))


def t25_identities(spark: SparkSession, d: str) -> DataFrame:
    """An identity of each attempt that does not change with its outcome: a digest of task, batch and input."""
    rows = st.attempts(table(spark, d, "material_summary_attempts"))
    parts = F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in ("task_id", "batch_id", "input_digest")])
    return rows.groupBy(F.sha2(parts, 256).alias("identity")).agg(F.count("*").alias("attempts"))


def q17_lint(spark: SparkSession, d: str) -> DataFrame:
    """Valid units by what is wrong with them; a unit may have several faults."""
    source = table(spark, d, "graded_units")
    valid = u.valid_units(source.withColumn("size", F.length(F.trim("body"))), "tier", "title", "inherits_from", "size")
    ids = valid.select(F.col("id").alias("parent"))
    parents = valid.select("id", F.explode("inherits_from").alias("p")).select("id", clean_id("p").alias("parent")).where("parent != ''")
    lost = parents.join(ids, "parent", "left_anti").groupBy("id").agg(F.count("*").alias("lost"))
    rows = valid.join(lost, "id", "left")
    faults = F.array(
        F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "no title"),
        F.when(F.coalesce("size", F.lit(0)) == 0, "no body"),
        F.when(~F.coalesce(F.col("tier").isin("L1", "L2", "L3", "L4"), F.lit(False)), "no tier"),
        F.when(~F.coalesce(F.col("revision") >= 1, F.lit(False)), "no revision"),
        F.when(F.col("lost").isNotNull(), "parent without a row"),
        F.when(F.size(F.array_distinct("inherits_from")) < F.size("inherits_from"), "repeated parent"),
    )
    return rows.select(F.explode(F.array_compact(faults)).alias("fault")).groupBy("fault").agg(F.count("*").alias("units"))


def a16_usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """Calls by policy: answered, open (no answer yet) and failed, and the seconds they took."""
    rows = st.attempts(table(spark, d, "material_summary_attempts")).groupBy("policy_identity")
    return rows.agg(
        F.count("*").alias("calls"),
        F.count("response").alias("answered"),
        F.expr("count_if(response is null and error is null)").alias("open"),
        F.count("error").alias("failed"),
        F.floor(F.sum(F.col("updated") - F.col("created"))).cast("bigint").alias("seconds"),
    )


def _last_two(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "unit_snapshots").where("snapshot_id is not null and id is not null")
    ids = [r[0] for r in rows.select("snapshot_id").distinct().orderBy(F.desc("snapshot_id")).limit(2).collect()]  # two deliveries
    latest = rows.where(F.col("snapshot_id").isin(ids)).groupBy("snapshot_id", clean_id("id").alias("id"))
    best = latest.agg(F.max(F.struct("delivered_at", "revision", "tier")).alias("r"))
    return best.select((F.col("snapshot_id") == max(ids, default=0)).alias("new"), "id", "r.revision", "r.tier")


def a20_before_after(spark: SparkSession, d: str) -> DataFrame:
    """Units by tier in the last delivery and the one before, the change, and how many stayed."""
    both = _last_two(spark, d).groupBy("id").agg(F.max(F.when(F.col("new"), F.col("tier"))).alias("after"), F.max(F.when(~F.col("new"), F.col("tier"))).alias("before"))
    sides = F.array(F.struct(F.col("before").alias("tier"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(F.col("after").alias("tier"), F.lit(0).alias("b"), F.lit(1).alias("a")))
    rows = both.select(F.inline(sides), (F.col("before") == F.col("after")).alias("same")).where("tier is not null")
    return rows.groupBy("tier").agg(F.sum("b").alias("before"), F.sum("a").alias("after"), F.count_if(F.col("same") & (F.col("a") == 1)).alias("stayed"))


def l05_delivery_order(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors of each unit in the order in which they are handed out: the farthest first."""
    w = Window.partitionBy("id").orderBy(F.desc("depth"), "ancestor_id")
    return closure(table(spark, d, "graded_units")).select("id", "ancestor_id", F.row_number().over(w).alias("place"))


def e04_merged_refs(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of all units under a path, each reference once."""
    rows = u.valid_units(table(spark, d, "graded_units"), "domain_path", "provenance").select("domain_path", F.explode("provenance.evidence_refs").alias("ref"))
    return rows.where("ref is not null").groupBy("domain_path").agg(F.countDistinct("ref").alias("refs"), F.min("ref").alias("first_ref"))


def e07_not_yet_known(spark: SparkSession, d: str) -> DataFrame:
    """Units that the last delivery did not hold in the revision that is valid now."""
    known = _last_two(spark, d).where("new").select("id", "revision")
    return u.valid_units(table(spark, d, "graded_units"), "tier").select("id", "revision").join(known, ["id", "revision"], "left_anti")


def w13_first_gate(spark: SparkSession, d: str) -> DataFrame:
    """Attempts by the first check that they fail."""
    rows = st.attempts(table(spark, d, "material_summary_attempts"))
    gate = (
        F.when(F.col("task_id").isNull(), "task").when(F.coalesce("block_ids", F.lit("")) == "", "blocks").when(F.col("error").isNotNull(), "error")
        .when(F.col("response").isNull(), "response").otherwise("none")
    )
    return rows.groupBy(gate.alias("gate")).agg(F.count("*").alias("attempts"))


def m10_history(spark: SparkSession, d: str) -> DataFrame:
    """Revisions of each unit over the deliveries as spans: from the first delivery of a revision up to the next one's."""
    rows = table(spark, d, "unit_snapshots").where("snapshot_id is not null and id is not null and revision is not null")
    first = rows.groupBy(clean_id("id").alias("id"), "revision").agg(F.min("snapshot_id").alias("since"))
    w = Window.partitionBy("id").orderBy("since", "revision")
    return first.select("id", "revision", "since", F.lead("since").over(w).alias("until"))


def m36_unbound_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of tasks that have no blocks."""
    tasks = table(spark, d, "material_blocks").select("task_id").distinct()
    return st.attempts(table(spark, d, "material_summary_attempts")).join(tasks, "task_id", "left_anti").select("attempt_id")


def m54_availability(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries by how they follow: in time, after a gap of more than a week, or partly late."""
    rows = table(spark, d, "unit_snapshots").where("snapshot_id is not null")
    per = rows.groupBy("snapshot_id").agg(F.min("delivered_at").alias("begun"), F.max("delivered_at").alias("ended"))
    w = Window.orderBy("snapshot_id")  # one row a delivery
    gap = F.datediff("begun", F.lag("begun").over(w))
    state = F.when(F.datediff("ended", "begun") > 7, "late rows").when(gap > 7, "gap").otherwise("ready")
    return per.select("snapshot_id", state.alias("state"))


def j11_votes_of_observers(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type by users who had an event of another type before: the others are dropped."""
    rows = table(spark, d, "events")
    first = rows.groupBy("user_id", "event_type").agg(F.min("ts").alias("first"))
    two = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("x"))  # one element a type
    seen = two.select("user_id", F.col("x")[0]["event_type"].alias("opening"))
    return rows.join(seen, "user_id").where("event_type != opening").groupBy("event_type").agg(F.count("*").alias("n"))


def j21_bound_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings by rule whose file is a unit, is none, or is not named."""
    ids = u.valid_units(table(spark, d, "graded_units"), "tier").select("id", F.lit(True).alias("there"))
    rows = table(spark, d, "findings").distinct().select("rule", clean_id(F.regexp_replace("file", r"\.md$", "")).alias("id"))
    state = F.when(F.col("id").isNull(), "unnamed").when(F.col("there"), "bound").otherwise("lost")
    return rows.join(ids, "id", "left").groupBy("rule", state.alias("state")).agg(F.count("*").alias("n"))


QUERIES = {
    q.__name__: q
    for q in (
        t11_citations, t12_body_tokens, t13_short_ids, t21_framework_names, t25_identities, q17_lint, a16_usage_totals,
        a20_before_after, l05_delivery_order, e04_merged_refs, e07_not_yet_known, w13_first_gate, m10_history,
        m36_unbound_attempts, m54_availability, j11_votes_of_observers, j21_bound_findings,
    )
}

_ID = r"lower(regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
_TWO = f"""WITH s AS (SELECT DISTINCT snapshot_id FROM unit_snapshots WHERE id IS NOT NULL AND snapshot_id IS NOT NULL ORDER BY 1 DESC LIMIT 2),
  l AS (SELECT snapshot_id = (SELECT max(snapshot_id) FROM s) AS new, {_ID.format('id')} AS id, revision, tier FROM unit_snapshots
    WHERE id IS NOT NULL AND snapshot_id IN (SELECT snapshot_id FROM s) QUALIFY row_number() OVER (PARTITION BY snapshot_id, {_ID.format('id')}
    ORDER BY delivered_at DESC NULLS LAST, revision DESC NULLS LAST, tier DESC NULLS LAST) = 1)"""
ORACLES = {
    "t11_citations": f"""WITH r AS (SELECT doc_id, regexp_extract_all(text, '{REFERENCE}') AS x FROM documents),
      o AS (SELECT doc_id, list_filter(x, lambda v, i: list_position(x, v) = i) AS x FROM r WHERE len(x) > 0)
      SELECT doc_id, len(x)::INT AS n, array_to_string(x, ' ') AS refs FROM o""",
    "t12_body_tokens": f"SELECT doc_id, len(list_distinct(regexp_extract_all(regexp_replace(lower(text), '{REFERENCE}', ' ', 'g'), '{LEX}')))::INT AS tokens FROM documents WHERE text IS NOT NULL",
    "t13_short_ids": "SELECT block_id[:6] AS short, CASE WHEN count(DISTINCT block_id) = 1 THEN min(block_id) END AS block_id, count(DISTINCT block_id) AS n FROM material_blocks WHERE block_id IS NOT NULL GROUP BY 1",
    "t21_framework_names": V + """, k AS (SELECT unnest(json_keys(conditions, '$.framework')) AS name FROM valid WHERE json_valid(conditions))
      SELECT regexp_replace(lower(name), '[-_.]+', '-', 'g') AS name, count(*) AS units FROM k GROUP BY 1""",
    "t25_identities": A + "SELECT sha256(concat_ws(chr(31), coalesce(task_id, ''), coalesce(batch_id, ''), coalesce(input_digest, ''))) AS identity, count(*) AS attempts FROM att GROUP BY 1",
    "q17_lint": V + f""", p AS (SELECT DISTINCT id, {_ID.format('x')} AS parent FROM (SELECT id, unnest(inherits_from) AS x FROM valid) WHERE x IS NOT NULL),
      f AS (SELECT 'no title' AS fault FROM valid WHERE coalesce(trim(title), '') = '' UNION ALL SELECT 'no body' FROM valid WHERE coalesce(length(trim(body)), 0) = 0
        UNION ALL SELECT 'no tier' FROM valid WHERE NOT coalesce(tier IN ('L1', 'L2', 'L3', 'L4'), false) UNION ALL SELECT 'no revision' FROM valid WHERE NOT coalesce(revision >= 1, false)
        UNION ALL SELECT 'parent without a row' FROM valid WHERE id IN (SELECT id FROM p WHERE parent <> '' AND parent NOT IN (SELECT id FROM valid))
        UNION ALL SELECT 'repeated parent' FROM valid WHERE len(inherits_from) > (SELECT count(*) FROM (SELECT DISTINCT unnest(inherits_from))))
      SELECT fault, count(*) AS units FROM f GROUP BY 1""",
    "a16_usage_totals": A + """SELECT policy_identity, count(*) AS calls, count(response) AS answered, count(*) FILTER (WHERE response IS NULL AND error IS NULL) AS open,
      count(error) AS failed, floor(sum(updated - created))::BIGINT AS seconds FROM att GROUP BY 1""",
    "a20_before_after": _TWO + """, b AS (SELECT id, max(CASE WHEN new THEN tier END) AS after, max(CASE WHEN NOT new THEN tier END) AS before FROM l GROUP BY 1),
      x AS (SELECT before AS tier, 1 AS b, 0 AS a, false AS same FROM b UNION ALL SELECT after, 0, 1, coalesce(before = after, false) FROM b)
      SELECT tier, sum(b)::BIGINT AS before, sum(a)::BIGINT AS after, count(*) FILTER (WHERE same) AS stayed FROM x WHERE tier IS NOT NULL GROUP BY 1""",
    "l05_delivery_order": _TREE + "SELECT id, ancestor_id, row_number() OVER (PARTITION BY id ORDER BY depth DESC, ancestor_id)::INT AS place FROM near",
    "e04_merged_refs": V + "SELECT domain_path, count(DISTINCT r) AS refs, min(r) AS first_ref FROM (SELECT domain_path, unnest(provenance.evidence_refs) AS r FROM valid) WHERE r IS NOT NULL GROUP BY 1",
    "e07_not_yet_known": _TWO + "," + V[5:] + "SELECT id, revision FROM valid v WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.new AND l.id = v.id AND l.revision = v.revision)",
    "w13_first_gate": A + """SELECT CASE WHEN task_id IS NULL THEN 'task' WHEN coalesce(block_ids, '') = '' THEN 'blocks' WHEN error IS NOT NULL THEN 'error'
      WHEN response IS NULL THEN 'response' ELSE 'none' END AS gate, count(*) AS attempts FROM att GROUP BY 1""",
    "m10_history": f"""WITH f AS (SELECT {_ID.format('id')} AS id, revision, min(snapshot_id) AS since FROM unit_snapshots
      WHERE id IS NOT NULL AND snapshot_id IS NOT NULL AND revision IS NOT NULL GROUP BY 1, 2)
      SELECT id, revision, since, lead(since) OVER (PARTITION BY id ORDER BY since, revision) AS until FROM f""",
    "m36_unbound_attempts": A + "SELECT attempt_id FROM att WHERE NOT EXISTS (SELECT 1 FROM material_blocks b WHERE b.task_id = att.task_id)",
    "m54_availability": """WITH p AS (SELECT snapshot_id, min(delivered_at) AS begun, max(delivered_at) AS ended FROM unit_snapshots WHERE snapshot_id IS NOT NULL GROUP BY 1)
      SELECT snapshot_id, CASE WHEN ended::DATE - begun::DATE > 7 THEN 'late rows' WHEN begun::DATE - lag(begun::DATE) OVER (ORDER BY snapshot_id) > 7 THEN 'gap' ELSE 'ready' END AS state FROM p""",
    "j11_votes_of_observers": """WITH o AS (SELECT user_id, event_type AS opening FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) = 1)
      SELECT event_type, count(*) AS n FROM events JOIN o USING (user_id) WHERE event_type <> opening GROUP BY 1""",
    "j21_bound_findings": V + f""", f AS (SELECT DISTINCT * FROM findings), x AS (SELECT rule, {_ID.format("regexp_replace(file, '[.]md$', '')")} AS id FROM f)
      SELECT rule, CASE WHEN id IS NULL THEN 'unnamed' WHEN id IN (SELECT id FROM valid) THEN 'bound' ELSE 'lost' END AS state, count(*) AS n FROM x GROUP BY ALL""",
}
