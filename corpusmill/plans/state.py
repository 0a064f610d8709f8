"""Queries over attempts, blocks, events, evidence and sinks, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.io import shared_folder, table
from corpusmill.operators import evidence, redact, state as st
from corpusmill.operators.units import valid_units
from corpusmill.plans.retrieval import V
from corpusmill.sources import files
from corpusmill.streaming import events as ev

UNIT = {"id": "string", "revision": "bigint", "tier": "string", "domain_path": "string", "inherits_from": "array<string>"}


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    return st.attempts(table(spark, d, "material_summary_attempts"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return st.blocks(table(spark, d, "material_blocks"))


def w05_latest_attempts(spark: SparkSession, d: str) -> DataFrame:
    return _attempts(spark, d).select("attempt_id", "status", "updated")


def w06_stagnation(spark: SparkSession, d: str) -> DataFrame:
    return st.stagnation(_attempts(spark, d))


def a17_status_rollup(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.floor(F.avg(F.col("updated") - F.col("created"))).cast("bigint")
    return _attempts(spark, d).groupBy("status", "error").agg(F.count("*").alias("attempts"), seconds.alias("mean_seconds"))


def a18_settled_batches(spark: SparkSession, d: str) -> DataFrame:
    return st.settled(_attempts(spark, d))


def w09_newest_failures(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("task_id").orderBy(F.desc("updated"), "attempt_id")
    rows = _attempts(spark, d).where("status = 'failed'").withColumn("place", F.row_number().over(w))
    return rows.where("place <= 5").select("task_id", "attempt_id", "place")


def x08_retry_delays(spark: SparkSession, d: str) -> DataFrame:
    fails = _attempts(spark, d).where("status = 'failed'").groupBy("task_id").agg(F.count("*").alias("failures"))
    return fails.select("task_id", "failures", t.delay("failures", 30.0, 3600.0).alias("delay"))


def w11_block_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return st.neighbours(_blocks(spark, d))


def m29_coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    return st.coverage_gaps(_blocks(spark, d))


def t16_prompt_batches(spark: SparkSession, d: str) -> DataFrame:
    return st.packed(_blocks(spark, d))


def j17_block_references(spark: SparkSession, d: str) -> DataFrame:
    check = st.reference_check(table(spark, d, "material_blocks"), table(spark, d, "material_summary_attempts"))
    return check.groupBy("state").agg(F.count("*").alias("blocks"))


def m08_task_index(spark: SparkSession, d: str) -> DataFrame:
    per = _blocks(spark, d).groupBy("task_id").agg(
        F.count("*").alias("blocks"), F.count_if("indexed").alias("indexed"), F.sum("n_bytes").alias("n_bytes")
    )
    phase = F.when(F.col("indexed") == F.col("blocks"), "ready").when(F.col("indexed") > 0, "partial").otherwise("empty")
    return per.withColumn("phase", phase)


def l02_page(spark: SparkSession, d: str) -> DataFrame:
    """The page of twenty attempts that follows the newest failure, by time, newest first: a keyset page."""
    rows = _attempts(spark, d)
    anchor = rows.where("status = 'failed'").agg(F.max(F.struct("updated", "attempt_id")).alias("anchor"))
    after = rows.join(F.broadcast(anchor)).where(F.struct("updated", "attempt_id") < F.col("anchor"))  # one row
    return after.orderBy(F.desc("updated"), F.desc("attempt_id")).limit(20).select("attempt_id", "status")


def w04_first_related(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("task_id").orderBy("pos", "block_id")
    rows = _blocks(spark, d).where("title is not null").withColumn("place", F.row_number().over(w))
    return rows.where("place <= 2").select("task_id", "block_id", "place")


def x09_status_moves(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "unit_snapshots").where("id is not null and snapshot_id is not null")
    last = rows.groupBy("snapshot_id", F.lower(F.trim("id")).alias("id")).agg(F.max(F.struct("delivered_at", "revision", "status")).alias("r"))
    return st.transitions(last.select("id", "snapshot_id", "r.status"))


def a09_usage(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, d, "events").groupBy("event_type")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.sum(k).alias("k"))


def a10_latest_votes(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user and type counts: how many stand above their type's mean of all."""
    rows = table(spark, d, "events")
    last = rows.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return last.groupBy("event_type").agg(F.count("*").alias("votes"), F.count_if(F.col("value") >= 50).alias("up"))


def f06_eligible_entries(spark: SparkSession, d: str) -> DataFrame:
    """Visible entries that fit the facts: an absent key passes, and only the kind with most rows is filtered."""
    rows = table(spark, d, "entries").where("feed_active = 1 or published_revision is null").distinct()
    device = F.get_json_object("conditions", "$.device")
    first = table(spark, d, "entries").where("kind is not null").groupBy("kind").count().orderBy(F.desc("count"), "kind").first()
    fits = (F.col("kind") != (first[0] if first else "")) | device.isNull() | device.isin("any", "a3")
    return rows.where(fits).groupBy("kind", "origin").agg(F.countDistinct("entry_id").alias("entries"))


def e03_withdrawn(spark: SparkSession, d: str) -> DataFrame:
    """Entries that were published once and are not in the feed now."""
    rows = table(spark, d, "entries").where("entry_id is not null")
    gone = rows.where("published_revision is not null").select("entry_id").distinct()
    return gone.join(rows.where("feed_active = 1").select("entry_id"), "entry_id", "left_anti")


def e01_visible(spark: SparkSession, d: str) -> DataFrame:
    """One row an entry, the feed's before an imported before a local one, then the latest."""
    order = F.when(F.col("origin") == "feed", 2).when(F.col("origin") == "import", 1).otherwise(0)
    best = F.max_by(F.struct("origin", "kind", "title"), F.struct(order, "updated", "title"))
    rows = table(spark, d, "entries").where("entry_id is not null").groupBy("entry_id").agg(best.alias("r"))
    return rows.select("entry_id", "r.*")


def l06_frontier(spark: SparkSession, d: str) -> DataFrame:
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "supplier")
    rate = F.expr("10000 * count_if(l_returnflag != 'R') div count(*)")  # whole numbers: the same in any order of rows
    cost = F.expr("sum(cast(round(l_extendedprice * 100) as bigint)) div count(*)")
    per = lines.groupBy("l_suppkey").agg(rate.alias("pass_rate"), cost.alias("cost"))
    named = per.join(parts, per.l_suppkey == parts.s_suppkey).select("l_suppkey", "s_nationkey", "pass_rate", "cost")
    return evidence.pareto_frontier(named, "s_nationkey", "pass_rate", "cost")


def a13_retention(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    mean = lambda odd: F.avg(F.when(F.col("l_linenumber") % 2 == odd, F.col("l_extendedprice").cast("double")))
    passed = lambda odd: F.min(F.when(F.col("l_linenumber") % 2 == odd, F.col("l_returnflag") != "R"))
    cases = lines.groupBy("l_orderkey").agg(
        passed(1).alias("baseline_pass"), passed(0).alias("candidate_pass"), mean(1).alias("baseline_ms"), mean(0).alias("candidate_ms"),
        (F.max("l_quantity") < 20).alias("guard"),
    )
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    joined = cases.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return evidence.retention(joined, "o_orderpriority")


def a14_timings(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    x = F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")
    return lines.groupBy("l_linestatus", "l_returnflag").agg(
        F.count("*").alias("samples"), F.round(F.min(x), 9).alias("low"), F.round(F.max(x), 9).alias("high"), F.round(F.exp(F.avg(F.log(x))), 6).alias("geomean")
    )


def r28_scan_units(spark: SparkSession, d: str) -> DataFrame:
    found = redact.scan(valid_units(table(spark, d, "graded_units"), "body"), "id", "body")
    return found.groupBy("kind").agg(F.count("*").alias("findings"), F.countDistinct("key").alias("units"))


def r29_scan_entries(spark: SparkSession, d: str) -> DataFrame:
    """Fields of entry documents, their names included, that hold a secret or identifier."""
    docs = table(spark, d, "entries").where("entry_id is not null").select("entry_id", "doc").distinct()
    return redact.scan_tree(docs, "entry_id", "doc").groupBy("pointer", "part", "kind").agg(F.count("*").alias("findings"))


def r30_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Findings by kind where tickets are allowed: these are claimed, but not reported."""
    found = redact.scan(valid_units(table(spark, d, "graded_units"), "body"), "id", "body", allow=r"[A-Z]+-\d+(?:-\d+)?")
    return found.groupBy("kind").agg(F.count("*").alias("findings"))


def r32_redacted_units(spark: SparkSession, d: str) -> DataFrame:
    """Bodies with all findings replaced, by digest."""
    done = redact.marked(valid_units(table(spark, d, "graded_units"), "body").where("body is not null"), "body")
    return done.select("id", F.size("findings").alias("findings"), F.sha2("redacted", 256).alias("digest"))


def r37_outbound(spark: SparkSession, d: str) -> DataFrame:
    """Units by path that may leave, and those that are held back for a finding in title or body."""
    valid = valid_units(table(spark, d, "graded_units"), "domain_path", "title", "body")
    seen = redact.marked(valid.withColumn("text", F.concat_ws("\n", "title", "body")), "text")
    held = F.size("findings") > 0
    return seen.groupBy("domain_path").agg(F.count_if(held).alias("held"), F.count_if(~held).alias("free"))


def r08_mac_addresses(spark: SparkSession, d: str) -> DataFrame:
    found = redact.scan(table(spark, d, "findings").where("finding_id is not null"), "finding_id", "value")
    return found.where("kind = 'mac'").groupBy("key").agg(F.count("*").alias("n")).withColumnRenamed("key", "finding_id")


def s12_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Units written as JSON lines and read again."""
    path = f"{shared_folder(spark).rstrip('/')}/json-{uuid.uuid4().hex}"
    files.write_json_lines(valid_units(table(spark, d, "graded_units"), "tier", "title", "body").select("id", "revision", "tier", "title", "body"), path)
    back = files.read_json_lines(spark, path, "id string, revision bigint, tier string, title string, body string")
    return back.where("_damaged is null").select("id", "revision", "tier", F.sha2(F.coalesce("body", F.lit("")), 256).alias("digest"))


def s02_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Units rendered as Markdown with front matter and parsed again."""
    rows = valid_units(table(spark, d, "graded_units"), "tier", "domain_path", "inherits_from", "body").select(*UNIT, "body")
    back = files.parse_markdown(files.unit_markdown(rows).select("markdown"), UNIT)
    return back.select("id", "revision", F.size("inherits_from").alias("parents"), F.sha2("body", 256).alias("digest"), "error")


def x01_admitted_once(spark: SparkSession, d: str) -> DataFrame:
    rows = ev.drained(ev.admitted(ev.stream(spark, d)), spark)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


def x10_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of the stream that are complete (an addition); the open ones at the end stay in the state."""
    return ev.drained(ev.per_window(ev.stream(spark, d)), spark)


def x11_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user with gaps of at most six hours (an addition)."""
    rows = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("s"))
    per = rows.agg(F.count("*").alias("n"))
    return per.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {
    q.__name__: q
    for q in (
        w05_latest_attempts, w06_stagnation, a17_status_rollup, a18_settled_batches, w09_newest_failures, x08_retry_delays,
        w11_block_neighbours, m29_coverage_gaps, t16_prompt_batches, j17_block_references, m08_task_index, l02_page,
        w04_first_related, x09_status_moves, a09_usage, a10_latest_votes, f06_eligible_entries, e03_withdrawn, e01_visible,
        l06_frontier, a13_retention, a14_timings, r28_scan_units, r29_scan_entries, r30_allowed, r32_redacted_units, r37_outbound, r08_mac_addresses, s12_json_lines, s02_markdown,
        x01_admitted_once, x10_event_windows, x11_sessions,
    )
}

_ATT = """att AS (SELECT * FROM material_summary_attempts WHERE attempt_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY attempt_id ORDER BY updated DESC NULLS LAST, status DESC NULLS LAST) = 1)"""
A = f"WITH {_ATT} "
B = """WITH RECURSIVE blk AS (SELECT DISTINCT ON (task_id, block_id) * FROM material_blocks ORDER BY task_id, block_id, pos DESC NULLS LAST,
  n_bytes DESC NULLS LAST, sha256 DESC NULLS LAST, title DESC NULLS LAST, source_range.range_start DESC NULLS LAST) """
ORACLES = {
    "w05_latest_attempts": A + "SELECT attempt_id, status, updated FROM att",
    "w06_stagnation": A + """, f AS (SELECT *, max(CASE WHEN status IN ('applied', 'returned') THEN created END) OVER (PARTITION BY task_id) AS up FROM att),
      g AS (SELECT task_id, count(*) AS attempts, count(*) FILTER (WHERE status = 'failed' AND (up IS NULL OR created > up)) AS streak, bool_or(up IS NOT NULL) AS ever FROM f GROUP BY 1)
      SELECT task_id, attempts, streak, CASE WHEN streak >= 3 THEN 'stuck' WHEN streak > 0 THEN 'slowing' WHEN ever THEN 'moving' ELSE 'unproven' END AS state FROM g""",
    "a17_status_rollup": A + "SELECT status, error, count(*) AS attempts, floor(avg(updated - created))::BIGINT AS mean_seconds FROM att GROUP BY ALL",
    "a18_settled_batches": A + "SELECT batch_id, count(*) AS attempts, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'applied') THEN 'complete' ELSE 'pending' END AS state FROM att GROUP BY 1",
    "w09_newest_failures": A + "SELECT task_id, attempt_id, row_number() OVER (PARTITION BY task_id ORDER BY updated DESC, attempt_id)::INT AS place FROM att WHERE status = 'failed' QUALIFY place <= 5",
    "x08_retry_delays": A + "SELECT task_id, count(*) AS failures, least(3600.0::DOUBLE, 30.0::DOUBLE * pow(2, least(count(*) - 1, 20))) AS delay FROM att WHERE status = 'failed' GROUP BY 1",
    "w11_block_neighbours": B + "SELECT task_id, pos, block_id, lag(block_id) OVER w AS previous, lead(block_id) OVER w AS following FROM blk WINDOW w AS (PARTITION BY task_id ORDER BY pos, block_id)",
    "m29_coverage_gaps": B + """, r AS (SELECT task_id, source_range.range_start AS a, source_range.range_end AS b FROM blk WHERE source_range.range_start IS NOT NULL AND source_range.range_end IS NOT NULL),
      q AS (SELECT *, max(b) OVER (PARTITION BY task_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM r)
      SELECT task_id, reached AS gap_start, a AS gap_end FROM q WHERE a > reached""",
    "t16_prompt_batches": B + """, s AS (SELECT task_id, coalesce(n_bytes, 0) AS n, row_number() OVER (PARTITION BY task_id ORDER BY pos, block_id) AS i FROM blk),
      fold AS (SELECT task_id, i, 0 AS batch, 1 AS blocks, n AS n_bytes FROM s WHERE i = 1
        UNION ALL SELECT s.task_id, s.i, CASE WHEN f.blocks < 8 AND f.n_bytes + s.n <= 65536 THEN f.batch ELSE f.batch + 1 END,
          CASE WHEN f.blocks < 8 AND f.n_bytes + s.n <= 65536 THEN f.blocks + 1 ELSE 1 END,
          CASE WHEN f.blocks < 8 AND f.n_bytes + s.n <= 65536 THEN f.n_bytes + s.n ELSE s.n END
        FROM fold f JOIN s ON s.task_id = f.task_id AND s.i = f.i + 1)
      SELECT task_id, batch::INT AS batch, max(blocks)::INT AS blocks, max(n_bytes)::BIGINT AS n_bytes FROM fold GROUP BY 1, 2""",
    "j17_block_references": """WITH l AS (SELECT DISTINCT unnest(block_ids::JSON::VARCHAR[]) AS block_id FROM material_summary_attempts WHERE json_valid(block_ids) AND json_type(block_ids) = 'ARRAY'),
      t AS (SELECT DISTINCT block_id FROM material_blocks)
      SELECT CASE WHEN t.block_id IS NULL THEN 'missing' WHEN l.block_id IS NULL THEN 'unreferenced' ELSE 'both' END AS state, count(*) AS blocks
      FROM l FULL JOIN t ON l.block_id = t.block_id GROUP BY 1""",
    "m08_task_index": B + """SELECT task_id, count(*) AS blocks, count(*) FILTER (WHERE indexed) AS indexed, sum(n_bytes)::BIGINT AS n_bytes,
      CASE WHEN count(*) FILTER (WHERE indexed) = count(*) THEN 'ready' WHEN count(*) FILTER (WHERE indexed) > 0 THEN 'partial' ELSE 'empty' END AS phase FROM blk GROUP BY 1""",
    "l02_page": A + """, a AS (SELECT max((updated, attempt_id)) AS x FROM att WHERE status = 'failed')
      SELECT attempt_id, status FROM att, a WHERE (updated, attempt_id) < x ORDER BY updated DESC, attempt_id DESC LIMIT 20""",
    "w04_first_related": B + "SELECT task_id, block_id, row_number() OVER (PARTITION BY task_id ORDER BY pos, block_id)::INT AS place FROM blk WHERE title IS NOT NULL QUALIFY place <= 2",
    "x09_status_moves": """WITH l AS (SELECT snapshot_id, lower(trim(id)) AS id, coalesce(status, 'active') AS after FROM unit_snapshots WHERE id IS NOT NULL AND snapshot_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY snapshot_id, lower(trim(id)) ORDER BY delivered_at DESC NULLS LAST, revision DESC NULLS LAST, status DESC NULLS LAST) = 1),
      m AS (SELECT lag(after) OVER (PARTITION BY id ORDER BY snapshot_id) AS before, after FROM l)
      SELECT before, after, count(*) AS moves FROM m WHERE before <> after GROUP BY ALL""",
    "a09_usage": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum(json_extract_string(props, '$.k')::INT)::BIGINT AS k FROM events GROUP BY 1",
    "a10_latest_votes": """WITH l AS (SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
      SELECT event_type, count(*) AS votes, count(*) FILTER (WHERE value >= 50) AS up FROM l GROUP BY 1""",
    "f06_eligible_entries": """SELECT kind, origin, count(DISTINCT entry_id) AS entries FROM entries WHERE (feed_active = 1 OR published_revision IS NULL)
      AND (kind <> (SELECT kind FROM entries WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, kind LIMIT 1) OR json_extract_string(conditions, '$.device') IS NULL OR json_extract_string(conditions, '$.device') IN ('any', 'a3')) GROUP BY ALL""",
    "e03_withdrawn": "SELECT DISTINCT entry_id FROM entries WHERE published_revision IS NOT NULL AND entry_id NOT IN (SELECT entry_id FROM entries WHERE feed_active = 1 AND entry_id IS NOT NULL)",
    "e01_visible": """SELECT entry_id, origin, kind, title FROM entries WHERE entry_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entry_id
      ORDER BY CASE origin WHEN 'feed' THEN 2 WHEN 'import' THEN 1 ELSE 0 END DESC, updated DESC NULLS LAST, title DESC NULLS LAST) = 1""",
    "l06_frontier": """WITH c AS (SELECT l_suppkey, s_nationkey, 10000 * count(*) FILTER (WHERE l_returnflag <> 'R') // count(*) AS pass_rate,
        (sum(round(l_extendedprice * 100)::BIGINT) // count(*))::BIGINT AS cost FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
      SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.s_nationkey = a.s_nationkey AND b.pass_rate >= a.pass_rate AND b.cost <= a.cost
        AND (b.pass_rate > a.pass_rate OR b.cost < a.cost))""",
    "a13_retention": """WITH c AS (SELECT l_orderkey, bool_and(CASE WHEN l_linenumber % 2 = 1 THEN l_returnflag <> 'R' END) AS bp, bool_and(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag <> 'R' END) AS cp,
        avg(CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice::DOUBLE END) AS bm, avg(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice::DOUBLE END) AS cm,
        max(l_quantity) < 20 AS guard FROM lineitem GROUP BY 1),
      r AS (SELECT o_orderpriority, guard, CASE WHEN bp IS NULL OR cp IS NULL OR coalesce(bm <= 0 OR cm <= 0, false) THEN 'faulty' WHEN bp AND cp THEN 'kept_pass'
        WHEN bp THEN 'lost' WHEN cp THEN 'gained' ELSE 'kept_fail' END AS bucket, bm / cm AS ratio FROM c JOIN orders ON o_orderkey = l_orderkey)
      SELECT o_orderpriority, count(*) FILTER (WHERE bucket = 'kept_pass') AS kept_pass, count(*) FILTER (WHERE bucket = 'lost') AS lost,
        count(*) FILTER (WHERE bucket = 'gained') AS gained, count(*) FILTER (WHERE bucket = 'kept_fail') AS kept_fail,
        count(*) FILTER (WHERE bucket = 'faulty') AS faulty,
        round(count(*) FILTER (WHERE bucket = 'kept_pass') / nullif(count(*) FILTER (WHERE bucket IN ('kept_pass', 'lost')), 0), 6) AS retention,
        round(exp(avg(ln(ratio)) FILTER (WHERE bucket = 'kept_pass')), 6) AS speedup,
        bool_and(coalesce(bucket = 'kept_pass' AND ratio >= 1, false)) FILTER (WHERE guard) AS guard_ok FROM r GROUP BY 1""",
    "a14_timings": """SELECT l_linestatus, l_returnflag, count(*) AS samples, round(min(x), 9) AS low, round(max(x), 9) AS high, round(exp(avg(ln(x))), 6) AS geomean
      FROM (SELECT l_linestatus, l_returnflag, l_extendedprice::DOUBLE / l_quantity::DOUBLE AS x FROM lineitem) GROUP BY ALL""",
    "r08_mac_addresses": r"SELECT finding_id, sum(len(regexp_extract_all(value, '(?i)\b(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}\b')))::BIGINT AS n FROM findings WHERE finding_id IS NOT NULL GROUP BY 1 HAVING n > 0",
    "s12_json_lines": V + "SELECT id, revision, tier, sha256(coalesce(body, '')) AS digest FROM valid",
    "s02_markdown": V + "SELECT id, revision, len(inherits_from)::INT AS parents, sha256(coalesce(body, '')) AS digest, NULL::VARCHAR AS error FROM valid",
    "x01_admitted_once": "SELECT event_type, count(DISTINCT event_id) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY 1",
    "x10_event_windows": """SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events
      WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES GROUP BY ALL""",
    "x11_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g),
      n AS (SELECT user_id, session, count(*) AS n FROM s GROUP BY ALL)
      SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1""",
}
