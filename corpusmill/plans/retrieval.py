"""Queries over texts and units, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.functions.clean import clean_id
from corpusmill.io import table, texts
from corpusmill.operators import ranking, units as u
from corpusmill.operators.hierarchy import closure
from corpusmill.plans.general import _TREE, SPACE

#: What a caller observes of its own set-up, for the queries on conditions.
OBSERVED = {"device": "a3", "batch": "8", "framework.qxserve": "2.5"}


def t01_lexemes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.explode(t.lexemes(F.lower("text"))).alias("lexeme"))
    return docs.groupBy("lexeme").agg(F.count("*").alias("n"))


def t05_term_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.explode(t.terms("text", parts=False)).alias("term"))
    per = docs.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"), F.max("tf").alias("most"))


def t03_identifier_parts(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling once. The parts come out of a generator, so that the filter on them stays behind the aggregation."""
    docs = table(spark, d, "documents").select(F.explode(t.lexemes("text")).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    return docs.select("raw", "n", F.explode(F.array(F.array_join(t.identifier_parts(F.col("raw")), " "))).alias("parts")).where("parts != ''")


def t08_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), t.token_estimate("text").cast("bigint").alias("tokens"))


def t09_byte_excerpt(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", t.byte_excerpt("text", 64).alias("excerpt"), (F.octet_length("text") > 256).alias("truncated"))


def t10_term_window(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lower(text) like '%because%'")
    return docs.select("doc_id", t.term_window("text", F.lit("because")).alias("excerpt"))


def t14_lossless_pieces(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text != ''").select("doc_id", F.explode(t.lossless_pieces("text", 4096)).alias("piece"))
    return docs.groupBy("doc_id").agg(
        F.sum(F.octet_length("piece")).alias("n_bytes"), (F.max(F.octet_length("piece")) <= 4096).alias("within")
    )


def t15_line_pieces(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text != ''").select("doc_id", F.posexplode(t.lossless_pieces("text", 4096, "\n")))
    return docs.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(F.octet_length("col")).alias("n_bytes"))


def t18_repeated_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    p = F.split("body", "\n\n")
    counted = table(spark, d, "graded_units").select("id", "revision", F.when(p.isNotNull(), F.size(p)).alias("paragraphs"), F.size(F.array_distinct(p)).alias("kept"))
    return u.valid_units(counted, "paragraphs", "kept").where("kept < paragraphs").select("id", "paragraphs", "kept")


def t19_error_codes(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(?:E[0-9]{4,6}|rc=[0-9]+)\b"), F.lit(0))))
    return table(spark, d, "documents").select("doc_id", F.array_join(codes, ",").alias("codes")).where("codes != ''")


def t23_normal_triggers(spark: SparkSession, d: str) -> DataFrame:
    rows = u.valid_units(table(spark, d, "graded_units"), "triggers").select(F.explode("triggers.keywords").alias("keyword"))
    return rows.groupBy(t.normal_trigger("keyword").alias("trigger")).agg(F.count("*").alias("units"))


def t24_body_digests(spark: SparkSession, d: str) -> DataFrame:
    digests = table(spark, d, "graded_units").withColumn("digest", F.sha2("body", 256))
    rows = u.valid_units(digests, "digest", "content_sha256").where("digest is not null")
    return rows.select("id", "digest", F.coalesce(F.col("digest") == F.lower("content_sha256"), F.lit(False)).alias("as_delivered"))


def t27_locators(spark: SparkSession, d: str) -> DataFrame:
    rows = u.valid_units(table(spark, d, "graded_units"), "provenance").select(t.locator("provenance.source_locator").alias("l"))
    return rows.groupBy("l.repo").agg(F.count("*").alias("units"), F.countDistinct("l.revision").alias("revisions"))


def s19_table_rows(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("body", F.lit(r"(?m)^\|[^\n]*\|$"), F.lit(0))
    cells = F.array_max(F.transform(found, lambda r: F.size(F.split(r, r"\|")) - 2))
    counted = table(spark, d, "graded_units").select("id", "revision", F.size(found).cast("bigint").alias("n_rows"), cells.alias("cells"))
    return u.valid_units(counted, "n_rows", "cells").where("n_rows > 0").select("id", "n_rows", "cells")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").where("query_text is not null")
    return items.select(F.col("case_id").alias("query_id"), F.col("query_text").alias("query"))


def a02_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    corpus = ranking.header_text(u.valid_units(table(spark, d, "graded_units"), "title", "triggers", "body"))
    return ranking.top_k(ranking.bm25(corpus, _queries(spark, d), parts=False)).select("query_id", "id", "score", "rank")


def q01_graded_query(spark: SparkSession, d: str) -> DataFrame:
    """BM25 with identifier parts, of active units that apply to what is observed; one tier weighs less, one path more."""
    valid = u.valid_units(table(spark, d, "graded_units"), "title", "triggers", "body", "conditions", "status", "tier", "domain_path")
    status = u.match_conditions(valid, OBSERVED)
    live = valid.where("coalesce(status, 'active') not in ('archived', 'superseded', 'suspect')").select("id", "tier", "domain_path")
    fit = live.join(status.where("status != 'mismatch'"), "id")
    scored = ranking.bm25(ranking.header_text(valid), _queries(spark, d))
    weight = F.when(F.col("tier") == "L4", 0.55).otherwise(1.0) * F.when(F.col("domain_path").startswith("serving"), 1.1).otherwise(1.0)
    best = scored.join(fit, "id").withColumn("score", F.round(F.col("score") * weight, 6))
    return ranking.top_k(best).select("query_id", "rank", "id", "score", "tier", "status", "open_keys")


def a12_known_item_eval(spark: SparkSession, d: str) -> DataFrame:
    """Titles of every fiftieth unit (by a digest of its id) as queries, over all units."""
    source = texts(spark, d, "graded_units")
    valid = u.valid_units(source, "title", "triggers", "body")
    asked = u.valid_units(source, "title").where(F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("int") % 50 == 0).where("title is not null")
    queries = asked.select(F.col("id").alias("query_id"), F.col("title").alias("query"))
    ranked = ranking.best_units(ranking.header_text(valid), queries, 10)
    return ranking.known_item_metrics(ranked, asked.select(F.col("id").alias("query_id"), "id"))


def f01_applicability(spark: SparkSession, d: str) -> DataFrame:
    return u.match_conditions(u.valid_units(table(spark, d, "graded_units"), "conditions"), OBSERVED)


def a03_exclusions(spark: SparkSession, d: str) -> DataFrame:
    valid = u.valid_units(table(spark, d, "graded_units"), "status", "conditions")
    rows = valid.select("id", F.coalesce("status", F.lit("active")).alias("unit_status")).join(u.match_conditions(valid, OBSERVED), "id")
    return rows.groupBy("unit_status", "status").agg(F.count("*").alias("units"))


def j06_promoted_parents(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "graded_units")
    tiers = u.valid_units(source, "tier").select("id", "tier")
    above = closure(source)
    parents = tiers.where("tier in ('L1', 'L2')").select(F.col("id").alias("ancestor_id"), F.col("tier").alias("parent_tier"))
    return above.join(tiers.where("tier = 'L3'").select("id"), "id").join(parents, "ancestor_id").select("id", "ancestor_id", "parent_tier")


def j04_unusable_ancestors(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "graded_units")
    status = u.valid_units(source, "status").select(F.col("id").alias("ancestor_id"), F.coalesce("status", F.lit("active")).alias("s"))
    above = closure(source).join(status, "ancestor_id", "left")
    return (
        above.groupBy("id")
        .agg(F.count_if(F.col("s").isNull()).alias("missing"), F.count_if(F.col("s") != "active").alias("inactive"))
        .where("missing + inactive > 0")
    )


def a04_duplicate_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = table(spark, d, "graded_units").withColumn("rule", u.rule_key())
    return u.duplicate_rules(u.valid_units(rules, "rule", "provenance")).drop("rule")


def a05_shared_rules(spark: SparkSession, d: str) -> DataFrame:
    valid = u.valid_units(table(spark, d, "graded_units").withColumn("rule", u.rule_key(body_only=True)), "rule")
    groups = valid.groupBy("rule").agg(F.count("*").alias("occurrences"), F.min("id").alias("first_id"))
    total = valid.agg(F.count("*").alias("units"))
    joined = groups.where("occurrences > 1").join(F.broadcast(total))  # one row
    return joined.select("first_id", "occurrences", F.round(F.col("occurrences") / F.col("units"), 6).alias("ratio"))


def a06_shard_metrics(spark: SparkSession, d: str) -> DataFrame:
    sized = u.with_size(table(spark, d, "graded_units"))
    return u.shard_metrics(u.valid_units(sized, "domain_path", "bytes"))


def a08_tiers_by_path(spark: SparkSession, d: str) -> DataFrame:
    valid = u.valid_units(table(spark, d, "graded_units"), "domain_path", "tier")
    return valid.groupBy("domain_path").pivot("tier", ["L1", "L2", "L3", "L4"]).count().na.fill(0)


def j10_trigger_classes(spark: SparkSession, d: str) -> DataFrame:
    return u.trigger_classes(u.valid_units(table(spark, d, "graded_units"), "triggers", "conditions"))


def a07_growth(spark: SparkSession, d: str) -> DataFrame:
    """Units by status at each delivery and the change of active units since the one before."""
    rows = table(spark, d, "unit_snapshots").where("snapshot_id is not null and id is not null")
    latest = rows.groupBy("snapshot_id", clean_id("id").alias("id")).agg(
        F.max(F.struct("delivered_at", "revision", F.coalesce("status", F.lit("active")).alias("status"))).alias("r")
    )
    per = latest.groupBy("snapshot_id").agg(
        F.count("*").alias("units"),
        *[F.count_if(F.col("r.status") == s).alias(s) for s in ("active", "suspect", "archived", "superseded")],
    )
    w = Window.orderBy("snapshot_id")  # one row a delivery
    return per.withColumn("delta_active", F.col("active") - F.lag("active").over(w))


QUERIES = {
    q.__name__: q
    for q in (
        t01_lexemes, t03_identifier_parts, t05_term_counts, t08_token_estimate, t09_byte_excerpt, t10_term_window,
        t14_lossless_pieces, t15_line_pieces, t18_repeated_paragraphs, t19_error_codes, t23_normal_triggers,
        t24_body_digests, t27_locators, s19_table_rows, a02_bm25_topk, q01_graded_query, a12_known_item_eval,
        f01_applicability, a03_exclusions, j04_unusable_ancestors, j06_promoted_parents, a04_duplicate_rules,
        a05_shared_rules, a06_shard_metrics, a08_tiers_by_path, j10_trigger_classes, a07_growth,
    )
}

LEX = r"[a-z0-9_]+(?:[./+:-][a-z0-9_]+)*|[\x{3400}-\x{9fff}]+"
_VALID = rf"""
valid AS (SELECT lower(regexp_replace(id, '{SPACE}', '', 'g')) AS id, * EXCLUDE (id) FROM graded_units WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(id, '{SPACE}', '', 'g')) ORDER BY revision DESC NULLS LAST, body DESC NULLS LAST) = 1)
"""
V = "WITH " + _VALID


def _terms(text: str) -> str:
    return rf"""flatten(list_transform(regexp_extract_all(lower({text}), '{LEX}'), lambda w:
      CASE WHEN regexp_matches(w, '^[\x{{3400}}-\x{{9fff}}]') AND length(w) > 1
      THEN list_transform(range(1, length(w)), lambda i: w[i:i+1]) ELSE [w] END))"""


_STATUS = rf"""
keys AS (SELECT id, json_extract(conditions, '$.device') AS device, json_extract(conditions, '$.batch') AS batch,
  regexp_extract(json_extract_string(conditions, '$.framework.qxserve'), '>=(\d+)\.(\d+)', 1)::INT * 1000
  + regexp_extract(json_extract_string(conditions, '$.framework.qxserve'), '>=(\d+)\.(\d+)', 2)::INT AS need FROM valid),
marks AS (SELECT id,
  CASE WHEN device IS NULL THEN 0 WHEN device::VARCHAR = '"unknown"' THEN 1 WHEN device::VARCHAR = '"any"' THEN 0
    WHEN device::VARCHAR LIKE '%"a3"%' THEN 0 ELSE 2 END AS d,
  CASE WHEN batch IS NULL THEN 0 WHEN batch::VARCHAR = '8' THEN 0 ELSE 2 END AS b,
  CASE WHEN need <= 2005 THEN 0 ELSE 2 END AS f FROM keys),
applied AS (SELECT id, CASE greatest(d, b, f) WHEN 2 THEN 'mismatch' WHEN 1 THEN 'unknown' ELSE 'matched' END AS status,
  CASE WHEN d = 1 THEN 'device' ELSE '' END AS open_keys FROM marks)
"""


def _parts(w: str) -> str:
    """SQL of identifier_parts: borders in two steps, as RE2 looks neither ahead nor behind."""
    border = r"regexp_replace(regexp_replace(c, '([a-z])([A-Z0-9])', '\1 \2', 'g'), '([A-Z0-9])([A-Z][a-z])', '\1 \2', 'g')"
    spellings = rf"""flatten(list_transform(list_filter(regexp_split_to_array({w}, '[-./:+]'), lambda p: regexp_matches(p, '^\D\w*$')),
      lambda p: list_transform([p] || flatten(list_transform(regexp_split_to_array(p, '_+'), lambda c: [c] || string_split({border}, ' '))), lambda x: lower(x))))"""
    once = f"list_transform([{spellings}], lambda l: list_filter(l, lambda x, i: list_position(l, x) = i))[1]"
    return f"list_filter({once}, lambda x: length(x) > 1 AND x <> lower({w}))"


def _terms_with_parts(text: str) -> str:
    return rf"""flatten(list_transform(regexp_extract_all({text}, '(?i){LEX}'), lambda w:
      CASE WHEN regexp_matches(w, '^[a-z]*[0-9]*$') THEN [w]
      WHEN regexp_matches(w, '^[\x{{3400}}-\x{{9fff}}]') THEN CASE WHEN length(w) > 1 THEN list_transform(range(1, length(w)), lambda i: w[i:i+1]) ELSE [w] END
      ELSE [lower(w)] || {_parts('w')} END))"""


_UNIT_DOCS = """SELECT id, body, coalesce(title, '') || CASE WHEN len(x) > 0 THEN chr(10) || array_to_string(x, chr(10)) ELSE '' END AS h
  FROM (SELECT *, coalesce(triggers.error_signatures, []) || coalesce(triggers.keywords, []) AS x FROM valid)"""


def _scored(docs: str, p: str = "", terms=_terms) -> str:
    """Common table expressions that end in ``{p}scored`` (query_id, id, score) of ``wanted`` against ``docs``."""
    return f"""{p}docs AS (SELECT id, {terms("h || chr(10) || coalesce(body, '')")} AS terms, list_distinct({terms('h')}) AS header FROM ({docs})),
      {p}totals AS (SELECT count(*) AS n, avg(len(terms)) AS average FROM {p}docs),
      {p}postings AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM {p}docs) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
      {p}df AS (SELECT term, count(*) AS df FROM {p}postings GROUP BY 1),
      {p}parts AS (SELECT id, term, CASE WHEN list_contains(header, term) THEN 1.25 ELSE 1.0 END * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
        / (tf + 1.2 * (0.25 + 0.75 * len(terms) / average)) AS part FROM {p}postings JOIN {p}df USING (term) JOIN {p}docs USING (id), {p}totals),
      {p}scored AS (SELECT query_id, id, round(sum(part), 6) AS score FROM wanted JOIN {p}parts USING (term) GROUP BY ALL)"""


_PICKED = "('0x' || md5(id)[1:6])::INT % 50 = 0"
_PROVENANCE = "coalesce(provenance::VARCHAR, '')"
ORACLES = {
    "t01_lexemes": f"SELECT lexeme, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{LEX}')) AS lexeme FROM documents) GROUP BY 1",
    "t05_term_counts": f"""WITH x AS (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents),
      per AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL)
      SELECT term, count(*) AS df, sum(tf)::BIGINT AS n, max(tf) AS most FROM per GROUP BY 1""",
    "t08_token_estimate": "SELECT doc_id, octet_length(encode(text)) AS n_bytes, ceil(octet_length(encode(text)) / 4)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL",
    "t09_byte_excerpt": """WITH e AS (SELECT doc_id, text, list_max(list_filter(range(0, least(length(text), 256) + 1), lambda i: octet_length(encode(substr(text, 1, i))) <= 256)) AS n
      FROM documents WHERE text IS NOT NULL) SELECT doc_id, substr(text, 1, n) AS excerpt, octet_length(encode(text)) > 256 AS truncated FROM e""",
    "t10_term_window": """SELECT doc_id, CASE WHEN instr(lower(text), 'because') - 120 > 1 THEN '…' ELSE '' END
      || substr(text, greatest(instr(lower(text), 'because') - 120, 1), 1200) AS excerpt FROM documents WHERE lower(text) LIKE '%because%'""",
    "t14_lossless_pieces": "SELECT doc_id, octet_length(encode(text)) AS n_bytes, true AS within FROM documents WHERE text <> ''",
    "t18_repeated_paragraphs": V + "SELECT id, len(p) AS paragraphs, len(list_distinct(p)) AS kept FROM (SELECT id, string_split(body, chr(10) || chr(10)) AS p FROM valid WHERE body IS NOT NULL) WHERE len(list_distinct(p)) < len(p)",
    "t19_error_codes": r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b(?:E[0-9]{4,6}|rc=[0-9]+)\b'))), ',') AS codes
      FROM documents WHERE len(regexp_extract_all(text, '\b(?:E[0-9]{4,6}|rc=[0-9]+)\b')) > 0""",
    "t23_normal_triggers": V + "SELECT array_to_string(regexp_extract_all(lower(k), '[a-z0-9]+'), ' ') AS trigger, count(*) AS units FROM (SELECT unnest(triggers.keywords) AS k FROM valid) GROUP BY 1",
    "t24_body_digests": V + "SELECT id, sha256(body) AS digest, coalesce(sha256(body) = lower(content_sha256), false) AS as_delivered FROM valid WHERE body IS NOT NULL",
    "t27_locators": V + r"""SELECT regexp_extract(l, '^([^@\s]+)@([0-9a-f]+)(?::(.+))?$', 1) AS repo, count(*) AS units,
      count(DISTINCT regexp_extract(l, '^([^@\s]+)@([0-9a-f]+)(?::(.+))?$', 2)) AS revisions
      FROM (SELECT provenance.source_locator AS l FROM valid) GROUP BY 1""",
    "s19_table_rows": V + r"""SELECT id, count(*) AS n_rows, max(len(string_split(r, '|')) - 2)::INT AS cells
      FROM (SELECT id, unnest(regexp_extract_all(body, '(?m)^\|[^\n]*\|$')) AS r FROM valid) GROUP BY 1""",
    "a02_bm25_topk": V + f""", wanted AS (SELECT case_id AS query_id, unnest(list_distinct({_terms('query_text')})) AS term FROM eval_items WHERE query_text IS NOT NULL),
      {_scored(_UNIT_DOCS)} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM scored QUALIFY rank <= 5""",
    "t03_identifier_parts": f"""WITH r AS (SELECT raw, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?i){LEX}')) AS raw FROM documents) GROUP BY 1)
      SELECT raw, n, array_to_string({_parts('raw')}, ' ') AS parts FROM r WHERE len({_parts('raw')}) > 0""",
    "q01_graded_query": V + "," + _STATUS + f""", wanted AS (SELECT case_id AS query_id, unnest(list_distinct({_terms_with_parts('query_text')})) AS term FROM eval_items WHERE query_text IS NOT NULL),
      {_scored(_UNIT_DOCS, terms=_terms_with_parts)}, w AS (SELECT query_id, s.id, tier, a.status AS status, a.open_keys,
        round(s.score * (CASE WHEN tier = 'L4' THEN 0.55::DOUBLE ELSE 1.0 END * CASE WHEN starts_with(domain_path, 'serving') THEN 1.1::DOUBLE ELSE 1.0 END), 6) AS score
        FROM scored s JOIN valid v ON v.id = s.id JOIN applied a ON a.id = s.id
        WHERE coalesce(v.status, 'active') NOT IN ('archived', 'superseded', 'suspect') AND a.status <> 'mismatch')
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM w QUALIFY rank <= 5""",
    "a12_known_item_eval": V + f""", asked AS (SELECT * FROM valid WHERE {_PICKED} AND title IS NOT NULL),
      wanted AS (SELECT id AS query_id, unnest(list_distinct({_terms_with_parts('title')})) AS term FROM asked), {_scored(_UNIT_DOCS, terms=_terms_with_parts)},
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 10),
      h AS (SELECT a.id, r.rank FROM asked a LEFT JOIN r ON r.query_id = a.id AND r.id = a.id)
      SELECT count(*) AS cases, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1,
        round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(coalesce(1 / rank, 0.0)), 6) AS mrr FROM h""",
    "f01_applicability": V + "," + _STATUS + "SELECT * FROM applied",
    "a03_exclusions": V + "," + _STATUS + "SELECT coalesce(valid.status, 'active') AS unit_status, applied.status AS status, count(*) AS units FROM applied JOIN valid USING (id) GROUP BY ALL",
    "j04_unusable_ancestors": _TREE + "," + _VALID.replace("valid AS", "full_rows AS") + """
      SELECT n.id, count(*) FILTER (WHERE f.id IS NULL) AS missing, count(*) FILTER (WHERE f.id IS NOT NULL AND coalesce(f.status, 'active') <> 'active') AS inactive
      FROM near n LEFT JOIN full_rows f ON f.id = n.ancestor_id WHERE n.id NOT IN (SELECT id FROM bad) GROUP BY 1 HAVING missing + inactive > 0""",
    "j06_promoted_parents": _TREE + "," + _VALID.replace("valid AS", "full_rows AS") + """
      SELECT n.id, n.ancestor_id, p.tier AS parent_tier FROM near n JOIN full_rows c ON c.id = n.id AND c.tier = 'L3'
      JOIN full_rows p ON p.id = n.ancestor_id AND p.tier IN ('L1', 'L2') WHERE n.id NOT IN (SELECT id FROM bad)""",
    "a04_duplicate_rules": V + f"""SELECT count(*) AS units, min(id) AS first_id, count(DISTINCT {_PROVENANCE}) AS variants,
      CASE WHEN count(DISTINCT {_PROVENANCE}) > 1 THEN 'other_source' ELSE 'same_source' END AS disposition
      FROM valid GROUP BY body, conditions, tier, category, evidence_strength, list_sort(inherits_from) HAVING count(*) > 1""",
    "a05_shared_rules": V + "SELECT min(id) AS first_id, count(*) AS occurrences, round(count(*) / (SELECT count(*) FROM valid), 6) AS ratio FROM valid GROUP BY body, conditions HAVING count(*) > 1",
    "a06_shard_metrics": V + """, p AS (SELECT list_filter(string_split(coalesce(domain_path, ''), '/'), lambda x: x NOT IN ('', '.')) AS parts,
        octet_length(encode(coalesce(body, ''))) AS b FROM valid),
      l AS (SELECT 'leaf' AS kind, parts AS x, b FROM p UNION ALL
        SELECT 'subtree', CASE WHEN len(parts) >= 3 THEN parts[:-2] ELSE parts[:2] END, b FROM p UNION ALL SELECT 'federation', parts[:1], b FROM p)
      SELECT kind, CASE WHEN len(x) = 0 THEN '.' ELSE array_to_string(x, '/') END AS path, count(*) AS units, sum(b)::BIGINT AS bytes,
        sum(ceil(b / 4))::BIGINT AS estimated_tokens FROM l GROUP BY ALL""",
    "a08_tiers_by_path": V + """SELECT domain_path, count(*) FILTER (WHERE tier = 'L1') AS "L1", count(*) FILTER (WHERE tier = 'L2') AS "L2",
      count(*) FILTER (WHERE tier = 'L3') AS "L3", count(*) FILTER (WHERE tier = 'L4') AS "L4" FROM valid GROUP BY 1""",
    "j10_trigger_classes": V + """, w AS (SELECT id, coalesce(conditions, '') AS conditions, array_to_string(list_sort(list_distinct(flatten(list_transform(
        coalesce(triggers.error_signatures, []) || coalesce(triggers.keywords, []), lambda s: regexp_extract_all(lower(s), '[a-z0-9]+'))))), ' ') AS triggers FROM valid)
      SELECT triggers, count(*) AS units, min(id) AS first_id, count(DISTINCT conditions) AS condition_sets FROM w WHERE triggers <> ''
      GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT conditions) > 1""",
    "a07_growth": rf"""WITH latest AS (SELECT snapshot_id, coalesce(status, 'active') AS status FROM unit_snapshots WHERE snapshot_id IS NOT NULL AND id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY snapshot_id, lower(regexp_replace(id, '{SPACE}', '', 'g'))
        ORDER BY delivered_at DESC NULLS LAST, revision DESC NULLS LAST, coalesce(status, 'active') DESC) = 1)
      SELECT snapshot_id, count(*) AS units, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'suspect') AS suspect,
        count(*) FILTER (WHERE status = 'archived') AS archived, count(*) FILTER (WHERE status = 'superseded') AS superseded,
        count(*) FILTER (WHERE status = 'active') - lag(count(*) FILTER (WHERE status = 'active')) OVER (ORDER BY snapshot_id) AS delta_active
      FROM latest GROUP BY snapshot_id""",
}
