"""Queries over material blocks, searches, and results that depend on one another; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.functions.clean import clean_id
from corpusmill.io import table, texts
from corpusmill.operators import materials as m, ranking, state as st, units as u
from corpusmill.operators.hierarchy import closure
from corpusmill.plans import retrieval
from corpusmill.plans.general import _TREE, SPACE
from corpusmill.plans.retrieval import _PICKED, _STATUS, _UNIT_DOCS, _VALID, OBSERVED, V, _queries, _scored, _terms
from corpusmill.plans.state import A, B, _ATT
from corpusmill.plans.upkeep import _TWO, _last_two

#: Hits of a query that a foundation is looked for among, and bytes that a page of blocks shares.
HITS, PAGE, BUDGET, BLOCK = 20, 8, 8192, 16384


def _units(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return u.valid_units(table(spark, d, "graded_units"), *columns)


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return st.blocks(table(spark, d, "material_blocks"))


def _tries(spark: SparkSession, d: str) -> DataFrame:
    return st.attempts(table(spark, d, "material_summary_attempts"))


def _unit_scores(spark: SparkSession, d: str, queries: DataFrame) -> DataFrame:
    return ranking.bm25(ranking.header_text(_units(spark, d, "title", "triggers", "body")), queries, parts=False)


def q04_material_search(spark: SparkSession, d: str) -> DataFrame:
    """Five tasks of each query, each by the best of its blocks."""
    scored = ranking.bm25(m.block_texts(table(spark, d, "material_blocks")), _queries(spark, d), parts=False)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "task_id")
    return m.best_of_tasks(scored).withColumn("rank", F.row_number().over(w)).where("rank <= 5")


def q06_mixed_query(spark: SparkSession, d: str) -> DataFrame:
    """Three units and three blocks of each query."""
    queries = _queries(spark, d)
    blocks = ranking.bm25(m.block_texts(table(spark, d, "material_blocks")), queries, parts=False)
    both = [ranking.top_k(s, 3).withColumn("kind", F.lit(k)) for k, s in (("unit", _unit_scores(spark, d, queries)), ("block", blocks))]
    return both[0].unionByName(both[1])


def j05_foundations(spark: SparkSession, d: str) -> DataFrame:
    """The first hits of each query without those that a better one inherits from."""
    hits = ranking.top_k(_unit_scores(spark, d, _queries(spark, d)), HITS).select("query_id", "id", "rank")
    return m.uncovered(hits, closure(table(spark, d, "graded_units")))


def l03_related_units(spark: SparkSession, d: str) -> DataFrame:
    """Three units related to each fiftieth one (by a digest of its id), by its title against all others."""
    picked = F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("int") % 50 == 0
    source = texts(spark, d, "graded_units")
    queries = u.valid_units(source, "title").where("title is not null").where(picked).select(F.col("id").alias("query_id"), F.col("title").alias("query"))
    best = ranking.best_units(ranking.header_text(u.valid_units(source, "title", "triggers", "body")), queries, 4, parts=False)  # itself, and three
    return ranking.top_k(best.where("id != query_id").drop("rank"), 3)


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    rows = _units(spark, d, "triggers", "domain_path").select("domain_path", F.explode("triggers.keywords").alias("phrase"))
    return rows.where("phrase is not null").select(t.normal_trigger("phrase").alias("phrase"), "domain_path").distinct()


def _asked(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entries").where("entry_id is not null").groupBy("entry_id").agg(F.max("title").alias("title"))
    return rows.select(F.col("entry_id").alias("query_id"), F.col("title").alias("query"))


def t06_query_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the titles of entries as queries; fillers are terms that a twentieth of all titles hold."""
    asked = _asked(spark, d)
    per = asked.select(F.explode(F.array_distinct(t.terms("query", parts=False))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    total = asked.agg(F.count("*").alias("titles"))  # one row
    fillers = per.join(F.broadcast(total)).where("n * 20 >= titles").select("term")
    rows = m.query_terms(asked, _phrases(spark, d), fillers)
    return rows.select("query_id", F.array_join("terms", " ").alias("terms"))


def t07_domain_priors(spark: SparkSession, d: str) -> DataFrame:
    """Domains of each title by how many of their phrases it holds: the first five."""
    phrases = _phrases(spark, d).where("domain_path is not null")
    hits = m.phrase_hits(_asked(spark, d), phrases).join(phrases, "phrase").groupBy("query_id", "domain_path").agg(F.count("*").alias("hits"))
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "domain_path")
    return hits.withColumn("rank", F.row_number().over(w)).where("rank <= 5")


def f05_held_back(spark: SparkSession, d: str) -> DataFrame:
    """By domain: L4 units that apply and are held back, because an L3 unit applies there too, and those that are not."""
    rows = _units(spark, d, "tier", "domain_path").join(u.match_conditions(_units(spark, d, "conditions"), OBSERVED), "id").where("status != 'mismatch'")
    per = rows.groupBy("domain_path").agg(F.count_if(F.col("tier") == "L3").alias("l3"), F.count_if(F.col("tier") == "L4").alias("l4"))
    held = F.col("l3") > 0
    return per.select("domain_path", F.when(held, F.col("l4")).otherwise(0).alias("held"), F.when(held, 0).otherwise(F.col("l4")).alias("shown"))


def f13_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards without bodies: what a unit is, whether it applies and what is still to be told."""
    rows = _units(spark, d, "title", "tier", "conditions")
    return rows.select("id", "title", "tier").join(u.match_conditions(rows, OBSERVED), "id")


def f14_inherited(spark: SparkSession, d: str) -> DataFrame:
    """Applicability of units together with all they inherit from."""
    status = u.match_conditions(_units(spark, d, "conditions"), OBSERVED)
    return m.inherited_status(status, closure(table(spark, d, "graded_units")))


def j22_retired(spark: SparkSession, d: str) -> DataFrame:
    status = _units(spark, d, "status").select("id", F.coalesce("status", F.lit("active")).isin("superseded", "archived").alias("withdrawn"))
    return m.retired(status, closure(table(spark, d, "graded_units")))


def j23_rebased(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery with what the units of today hold beyond it and beyond the delivery before."""
    both = _last_two(spark, d)
    return m.rebased(both.where("new"), both.where("not new"), _units(spark, d, "tier"))


def w08_even_shares(spark: SparkSession, d: str) -> DataFrame:
    return m.even_shares(_blocks(spark, d), PAGE, BUDGET)


def m02_documents(spark: SparkSession, d: str) -> DataFrame:
    """Digests of documents that were put into blocks and read back."""
    rows = m.put_together(m.stored_blocks(table(spark, d, "documents"), BLOCK))
    return rows.select("doc_id", F.sha2("text", 256).alias("digest"))


def m03_blocks_of_failures(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of the blocks of tasks with a failed attempt."""
    tasks = _tries(spark, d).where("status = 'failed'").select("task_id").distinct()
    return _blocks(spark, d).join(tasks, "task_id", "left_semi").select("task_id", "block_id", "pos", "n_bytes")


def m04_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of each task that are indexed, before and after the lists of applied attempts."""
    listed = _tries(spark, d).where("status = 'applied'").select("task_id", F.explode(F.from_json("block_ids", "array<string>")).alias("block_id"))
    rows = m.marked_indexed(_blocks(spark, d), listed)
    return rows.groupBy("task_id").agg(F.count("*").alias("blocks"), F.count_if("indexed").alias("before"), F.count_if("now").alias("after"))


def m05_unreferenced(spark: SparkSession, d: str) -> DataFrame:
    """By task, blocks that no attempt lists: they could go."""
    listed = table(spark, d, "material_summary_attempts").select(F.explode(F.from_json("block_ids", "array<string>")).alias("block_id"))
    rows = _blocks(spark, d).join(listed, "block_id", "left_anti")
    return rows.groupBy("task_id").agg(F.count("*").alias("blocks"), F.sum("n_bytes").alias("n_bytes"))


def m44_remedies(spark: SparkSession, d: str) -> DataFrame:
    rows = _tries(spark, d).select("policy_identity", m.remedy("status", "error").alias("remedy")).where("remedy is not null")
    return rows.groupBy("policy_identity", "remedy").agg(F.count("*").alias("attempts"))


def j19_two_policies(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds of attempts by task under the least and the greatest policy."""
    rows = _tries(spark, d)
    ms = F.floor((F.col("updated") - F.col("created")) * 1000).cast("bigint")
    low, high = rows.agg(F.min("policy_identity"), F.max("policy_identity")).first()  # two names
    cases = rows.select(F.coalesce("task_id", F.lit("")).alias("case"), F.col("policy_identity").alias("side"), ms.alias("ms"))
    return m.two_sides(cases, low or "", high or " ")


def a15_sound_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks by whether all sizes and ranges of their blocks hold; what is null is not checked."""
    size = F.col("source_range.range_end") - F.col("source_range.range_start")
    good = F.coalesce(F.col("n_bytes").between(0, BLOCK), F.lit(True)) & F.coalesce((size >= 0) & (size == F.col("n_bytes")), F.lit(True))
    per = _blocks(spark, d).groupBy("task_id").agg(F.bool_and(good).alias("sound"))
    return per.groupBy("sound").agg(F.count("*").alias("tasks"))


def a19_stacks(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d, "category", "evidence_strength").groupBy("category", "evidence_strength").agg(F.count("*").alias("units"))


def a22_published(spark: SparkSession, d: str) -> DataFrame:
    """Entries by origin, those that are published, and bytes of their documents; an entry delivered twice counts once."""
    one = table(spark, d, "entries").groupBy("origin", "entry_id").agg(F.max(F.octet_length("doc")).alias("b"), F.count("published_revision").alias("p"))
    return one.groupBy("origin").agg(F.count("*").alias("entries"), F.count_if(F.col("p") > 0).alias("published"), F.sum("b").alias("n_bytes"))


def f12_allowed_paths(spark: SparkSession, d: str) -> DataFrame:
    """Findings by whether their file is one that may be sent: a unit's Markdown file without steps upwards."""
    allowed = F.coalesce(F.col("file").rlike(r"^unit-[a-z0-9-]+\.md$"), F.lit(False))
    return table(spark, d, "findings").groupBy("rule", allowed.alias("allowed")).agg(F.count("*").alias("findings"))


def f15_domain_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Category of each unit by the catalog of its domain (its most common category, ties the least), else ``unlisted``."""
    rows = _units(spark, d, "domain_path", "category")
    per = rows.where("domain_path is not null and category is not null").groupBy("domain_path", "category").agg(F.count("*").alias("n")).where("n >= 3")
    catalog = per.groupBy("domain_path").agg(F.min(F.struct((-F.col("n")).alias("n"), "category"))["category"].alias("listed"))
    return rows.select("id", "domain_path").join(catalog, "domain_path", "left").select("id", F.coalesce("listed", F.lit("unlisted")).alias("listed"))


def j16_failing_scope(spark: SparkSession, d: str) -> DataFrame:
    """Failed attempts by error, and those whose task has blocks that are not indexed."""
    waiting = _blocks(spark, d).where("not coalesce(indexed, false)").select("task_id").distinct().withColumn("waiting", F.lit(True))
    rows = _tries(spark, d).where("status = 'failed'").join(waiting, "task_id", "left")
    return rows.groupBy("error").agg(F.count("*").alias("attempts"), F.count("waiting").alias("waiting"))


def s18_sections(spark: SparkSession, d: str) -> DataFrame:
    """One row a heading of a document, in order."""
    heads = F.regexp_extract_all("text", F.lit(r"(?md)^#{1,6} [^\n]+$"), F.lit(0))
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(heads).alias("place", "heading"))
    return rows.select("doc_id", "place", F.length(F.regexp_extract("heading", "^(#+)", 1)).alias("level"), F.regexp_replace("heading", r"^#+ *|[ \r]+$", "").alias("heading"))


def s13_manifest(spark: SparkSession, d: str) -> DataFrame:
    """One JSON line a domain: its units and tiers."""
    per = _units(spark, d, "domain_path", "tier").groupBy("domain_path")
    rows = per.agg(F.count("*").alias("units"), *[F.count_if(F.col("tier") == x).alias(x) for x in ("L1", "L2", "L3", "L4")])
    return rows.select("domain_path", F.to_json(F.struct("units", "L1", "L2", "L3", "L4")).alias("line"))


def m47_unit_faults(spark: SparkSession, d: str) -> DataFrame:
    """Rows that stand in the way of a sound set: an id and revision twice, and parents without a row."""
    source = table(spark, d, "graded_units").where("id is not null")
    twice = source.groupBy(clean_id("id").alias("id"), "revision").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated row").alias("fault"))
    valid = _units(spark, d, "inherits_from")
    parents = valid.select("id", F.explode("inherits_from").alias("p")).select("id", clean_id("p").alias("parent")).where("parent != ''")
    lost = parents.join(valid.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", F.lit("parent without a row").alias("fault"))
    return twice.unionByName(lost).distinct()


def m50_charged(spark: SparkSession, d: str) -> DataFrame:
    """By domain: estimated tokens of its units, and of the parents they name, each parent once."""
    source = table(spark, d, "graded_units")
    sized = u.valid_units(source.withColumn("tokens", t.token_estimate(F.coalesce("body", F.lit("")))), "domain_path", "tokens", "inherits_from")
    own = sized.groupBy("domain_path").agg(F.sum("tokens").cast("bigint").alias("own"))
    links = sized.select("domain_path", F.explode("inherits_from").alias("p")).select("domain_path", clean_id("p").alias("parent")).distinct()
    costs = links.join(sized.select(F.col("id").alias("parent"), "tokens"), "parent").groupBy("domain_path").agg(F.sum("tokens").cast("bigint").alias("parents"))
    joined = own.join(costs.withColumnRenamed("domain_path", "p"), F.col("domain_path").eqNullSafe(F.col("p")), "left")
    return joined.select("domain_path", "own", F.coalesce("parents", F.lit(0)).cast("bigint").alias("parents"))


def w03_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Of each domain and category the anchor (highest revision, then id) and the two members next to it."""
    w = Window.partitionBy("domain_path", "category").orderBy(F.desc("revision"), "id")
    rows = _units(spark, d, "domain_path", "category").withColumn("place", F.row_number().over(w)).where("place <= 3")
    return rows.select("domain_path", "category", "id", (F.col("place") == 1).alias("anchor"), "place")


def l04_merge_reviews(spark: SparkSession, d: str) -> DataFrame:
    """The two hundred largest classes of units with the same trigger words and different conditions, as a list to look at."""
    rows = u.trigger_classes(_units(spark, d, "triggers", "conditions"))
    return rows.orderBy(F.desc("units"), "first_id").limit(200).select("first_id", "units", "condition_sets")


QUERIES = {
    q.__name__: q
    for q in (
        q04_material_search, q06_mixed_query, j05_foundations, l03_related_units, t06_query_terms, t07_domain_priors, f05_held_back,
        f13_cards, f14_inherited, j22_retired, j23_rebased, w08_even_shares, m02_documents, m03_blocks_of_failures, m04_indexed,
        m05_unreferenced, m44_remedies, j19_two_policies, a15_sound_tasks, a19_stacks, a22_published, f12_allowed_paths,
        f15_domain_catalog, j16_failing_scope, s18_sections, s13_manifest, m47_unit_faults, m50_charged,
        w03_anchors, l04_merge_reviews,
    )
}

_BLOCK_DOCS = """SELECT task_id || '/' || block_id AS id, summary AS body, coalesce(title, '') AS h FROM (SELECT * FROM material_blocks
  QUALIFY row_number() OVER (PARTITION BY task_id, block_id ORDER BY title DESC NULLS LAST, summary DESC NULLS LAST) = 1)"""
_WANTED = f"wanted AS (SELECT case_id AS query_id, unnest(list_distinct({_terms('query_text')})) AS term FROM eval_items WHERE query_text IS NOT NULL)"


def _top(k: int, p: str = "", where: str = "true") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM {p}scored WHERE {where} QUALIFY rank <= {k}"


_FULL = _VALID.replace("valid AS", "full_rows AS")
_LISTED = "unnest(block_ids::JSON::VARCHAR[]) AS block_id FROM {} WHERE json_valid(block_ids) AND json_type(block_ids) = 'ARRAY'"
_NORMAL = "array_to_string(regexp_extract_all(lower({}), '[a-z0-9]+'), ' ')"
_HITS = f""", phrases AS (SELECT DISTINCT {_NORMAL.format('k')} AS phrase, domain_path FROM (SELECT domain_path, unnest(triggers.keywords) AS k FROM valid) WHERE k IS NOT NULL),
  asked AS (SELECT entry_id AS query_id, max(title) AS query FROM entries WHERE entry_id IS NOT NULL GROUP BY 1),
  hits AS (SELECT DISTINCT query_id, phrase FROM asked JOIN (SELECT DISTINCT phrase FROM phrases WHERE phrase <> '') ON contains(' ' || {_NORMAL.format('query')} || ' ', ' ' || phrase || ' '))"""
_OUT = "('superseded', 'archived')"
ORACLES = {
    "w03_anchors": V + """SELECT domain_path, category, id, place = 1 AS anchor, place FROM (SELECT domain_path, category, id,
      row_number() OVER (PARTITION BY domain_path, category ORDER BY revision DESC NULLS LAST, id)::INT AS place FROM valid QUALIFY place <= 3)""",
    "l04_merge_reviews": "SELECT first_id, units, condition_sets FROM (" + retrieval.ORACLES["j10_trigger_classes"] + ") ORDER BY units DESC, first_id LIMIT 200",
    "q04_material_search": f"WITH {_WANTED}, " + _scored(_BLOCK_DOCS) + """, best AS (SELECT query_id, split_part(id, '/', 1) AS task_id, split_part(id, '/', 2) AS block_id, score FROM scored
      QUALIFY row_number() OVER (PARTITION BY query_id, split_part(id, '/', 1) ORDER BY score DESC, split_part(id, '/', 2)) = 1)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, task_id)::INT AS rank FROM best QUALIFY rank <= 5""",
    "q06_mixed_query": V + f", {_WANTED}, {_scored(_UNIT_DOCS, 'u_')}, {_scored(_BLOCK_DOCS, 'b_')} SELECT *, 'unit' AS kind FROM ({_top(3, 'u_')}) UNION ALL SELECT *, 'block' FROM ({_top(3, 'b_')})",
    "j05_foundations": _TREE + f", {_FULL}, {_WANTED}, {_scored(_UNIT_DOCS.replace('FROM valid', 'FROM full_rows'))}, hits AS ({_top(HITS)})" + """
      SELECT query_id, id, rank FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits b JOIN near n ON n.id = b.id
        WHERE b.query_id = h.query_id AND n.ancestor_id = h.id AND b.rank < h.rank AND b.id NOT IN (SELECT id FROM bad))""",
    "l03_related_units": V + f", wanted AS (SELECT id AS query_id, unnest(list_distinct({_terms('title')})) AS term FROM valid WHERE title IS NOT NULL AND {_PICKED}), "
      + _scored(_UNIT_DOCS) + " " + _top(3, "", "id <> query_id"),
    "t06_query_terms": V + _HITS + f""", words AS (SELECT query_id, list_distinct({_terms('query')}) AS w FROM asked),
      one AS (SELECT DISTINCT query_id, unnest(w) AS term FROM words),
      fill AS (SELECT list(term) AS f FROM (SELECT term FROM one GROUP BY 1 HAVING count(*) * 20 >= (SELECT count(*) FROM asked))),
      seq AS (SELECT query_id, {_terms('query')} AS w FROM asked),
      uniq AS (SELECT query_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM seq),
      kept AS (SELECT query_id, w, list_filter(w, lambda x: NOT list_contains(coalesce(f, []), x)) AS k FROM uniq, fill),
      al AS (SELECT query_id, list_sort(list(DISTINCT replace(phrase, ' ', '_'))) AS a FROM hits GROUP BY 1)
      SELECT a.query_id, array_to_string(coalesce(o, []) || list_filter(coalesce(l.a, []), lambda x: NOT list_contains(coalesce(o, []), x)), ' ') AS terms
      FROM asked a LEFT JOIN (SELECT query_id, CASE WHEN len(k) > 0 THEN k ELSE w END AS o FROM kept) USING (query_id) LEFT JOIN al l USING (query_id)""",
    "t07_domain_priors": V + _HITS + """, n AS (SELECT query_id, domain_path, count(*) AS hits FROM hits JOIN phrases USING (phrase) WHERE domain_path IS NOT NULL GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, domain_path)::INT AS rank FROM n QUALIFY rank <= 5""",
    "f05_held_back": V + "," + _STATUS + """, p AS (SELECT domain_path, count(*) FILTER (WHERE tier = 'L3') AS l3, count(*) FILTER (WHERE tier = 'L4') AS l4
      FROM valid JOIN applied USING (id) WHERE applied.status <> 'mismatch' GROUP BY 1)
      SELECT domain_path, CASE WHEN l3 > 0 THEN l4 ELSE 0 END AS held, CASE WHEN l3 > 0 THEN 0 ELSE l4 END AS shown FROM p""",
    "f13_cards": V + "," + _STATUS + "SELECT id, title, tier, applied.status AS status, open_keys FROM applied JOIN valid USING (id)",
    "f14_inherited": _TREE + "," + _FULL + "," + _STATUS.replace("FROM valid", "FROM full_rows") + """, each AS (SELECT id, status, open_keys FROM applied
      UNION ALL SELECT n.id, a.status, a.open_keys FROM near n JOIN applied a ON a.id = n.ancestor_id WHERE n.id NOT IN (SELECT id FROM bad))
      SELECT id, CASE WHEN bool_or(status = 'mismatch') THEN 'mismatch' WHEN bool_or(status = 'unknown') THEN 'unknown' ELSE 'matched' END AS status, max(open_keys) AS open_keys FROM each GROUP BY 1""",
    "j22_retired": _TREE + "," + _FULL + f""", s AS (SELECT id, coalesce(status, 'active') IN {_OUT} AS out FROM full_rows),
      g AS (SELECT DISTINCT n.id FROM near n LEFT JOIN s ON s.id = n.ancestor_id WHERE coalesce(s.out, true) AND n.id NOT IN (SELECT id FROM bad))
      SELECT id, CASE WHEN out THEN 'withdrawn' ELSE 'dangling' END AS reason FROM s WHERE out OR id IN (SELECT id FROM g)""",
    "j23_rebased": _TWO + "," + V[5:] + """, r AS (SELECT id, revision FROM l WHERE new), sent AS (SELECT id FROM l WHERE NOT new)
      SELECT r.id, r.revision, 'remote' AS origin, v.id IS NOT NULL AND v.revision IS DISTINCT FROM r.revision AS differs FROM r LEFT JOIN valid v USING (id)
      UNION ALL SELECT id, revision, 'draft', false FROM valid WHERE id NOT IN (SELECT id FROM r) AND id NOT IN (SELECT id FROM sent)""",
    "w08_even_shares": B + f""", f AS (SELECT task_id, block_id, coalesce(n_bytes, 0) AS need, row_number() OVER (PARTITION BY task_id ORDER BY pos NULLS FIRST, block_id) AS place FROM blk QUALIFY place <= {PAGE}),
      n AS (SELECT task_id, count(*) AS n FROM f GROUP BY 1),
      go AS (SELECT task_id, 0::BIGINT AS place, '' AS block_id, 0::BIGINT AS share, {BUDGET}::BIGINT AS rest FROM n
        UNION ALL SELECT f.task_id, f.place, f.block_id, least(f.need, go.rest // (n.n - f.place + 1)), go.rest - least(f.need, go.rest // (n.n - f.place + 1))
        FROM go JOIN f ON f.task_id = go.task_id AND f.place = go.place + 1 JOIN n ON n.task_id = f.task_id)
      SELECT task_id, place::INT AS place, block_id, share FROM go WHERE place > 0""",
    "m02_documents": "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL",
    "m03_blocks_of_failures": B + f", {_ATT} SELECT task_id, block_id, pos, n_bytes FROM blk WHERE task_id IN (SELECT task_id FROM att WHERE status = 'failed')",
    "m04_indexed": B + f", {_ATT}, done AS (SELECT DISTINCT task_id, {_LISTED.format('att')} AND status = 'applied')" + """
      SELECT task_id, count(*) AS blocks, count(*) FILTER (WHERE indexed) AS before,
        count(*) FILTER (WHERE indexed OR EXISTS (SELECT 1 FROM done x WHERE x.task_id = blk.task_id AND x.block_id = blk.block_id)) AS after FROM blk GROUP BY 1""",
    "m05_unreferenced": B + f", done AS (SELECT DISTINCT {_LISTED.format('material_summary_attempts')})" + """
      SELECT task_id, count(*) AS blocks, sum(n_bytes)::BIGINT AS n_bytes FROM blk WHERE NOT EXISTS (SELECT 1 FROM done x WHERE x.block_id = blk.block_id) GROUP BY 1""",
    "m44_remedies": A + """, r AS (SELECT policy_identity, CASE WHEN status = 'failed' THEN CASE error WHEN 'timeout' THEN 'retry' WHEN 'schema' THEN 'repair'
      WHEN 'budget' THEN 'split' ELSE 'look' END WHEN status IN ('prepared', 'invoking') THEN 'unknown outcome' END AS remedy FROM att)
      SELECT policy_identity, remedy, count(*) AS attempts FROM r WHERE remedy IS NOT NULL GROUP BY ALL""",
    "j19_two_policies": A + """, c AS (SELECT coalesce(task_id, '') AS "case", policy_identity AS side, floor((updated - created) * 1000)::BIGINT AS ms FROM att),
      e AS (SELECT min(policy_identity) AS a, max(policy_identity) AS b FROM att),
      p AS (SELECT "case", sum(ms) FILTER (WHERE side = a) / count(ms) FILTER (WHERE side = a) AS o, sum(ms) FILTER (WHERE side = b) / count(ms) FILTER (WHERE side = b) AS n
        FROM c, e WHERE side IN (a, b) AND ms IS NOT NULL GROUP BY 1)
      SELECT "case", CASE WHEN o IS NULL OR isnan(o) THEN 'candidate only' WHEN n IS NULL OR isnan(n) THEN 'reference only' ELSE 'both' END AS state,
        floor(o)::BIGINT AS reference_ms, floor(n)::BIGINT AS candidate_ms, CASE WHEN o > 0 THEN round(n / o, 4) END AS ratio FROM p""",
    "a15_sound_tasks": B + f""", g AS (SELECT task_id, bool_and(coalesce(n_bytes BETWEEN 0 AND {BLOCK}, true) AND coalesce(source_range.range_end - source_range.range_start >= 0
      AND source_range.range_end - source_range.range_start = n_bytes, true)) AS sound FROM blk GROUP BY 1) SELECT sound, count(*) AS tasks FROM g GROUP BY 1""",
    "a19_stacks": V + "SELECT category, evidence_strength, count(*) AS units FROM valid GROUP BY ALL",
    "a22_published": """WITH o AS (SELECT origin, entry_id, max(octet_length(encode(doc))) AS b, count(published_revision) AS p FROM entries GROUP BY ALL)
      SELECT origin, count(*) AS entries, count(*) FILTER (WHERE p > 0) AS published, sum(b)::BIGINT AS n_bytes FROM o GROUP BY 1""",
    "f12_allowed_paths": r"SELECT rule, coalesce(regexp_matches(file, '^unit-[a-z0-9-]+\.md$'), false) AS allowed, count(*) AS findings FROM findings GROUP BY ALL",
    "f15_domain_catalog": V + """, p AS (SELECT domain_path, category, count(*) AS n FROM valid WHERE domain_path IS NOT NULL AND category IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
      c AS (SELECT domain_path, category AS listed FROM p QUALIFY row_number() OVER (PARTITION BY domain_path ORDER BY n DESC, category) = 1)
      SELECT id, coalesce(listed, 'unlisted') AS listed FROM valid LEFT JOIN c USING (domain_path)""",
    "j16_failing_scope": B + f""", {_ATT} SELECT error, count(*) AS attempts,
      count(*) FILTER (WHERE task_id IN (SELECT task_id FROM blk WHERE NOT coalesce(indexed, false))) AS waiting FROM att WHERE status = 'failed' GROUP BY 1""",
    "s18_sections": r"""WITH h AS (SELECT doc_id, regexp_extract_all(text, '(?m)^#{1,6} [^\n]+$') AS l FROM documents),
      e AS (SELECT doc_id, unnest(range(0, len(l))) AS place, unnest(l) AS heading FROM h)
      SELECT doc_id, place::INT AS place, length(regexp_extract(heading, '^(#+)', 1))::INT AS level, regexp_replace(heading, '^#+ *|[ \r]+$', '', 'g') AS heading FROM e""",
    "s13_manifest": V + """, p AS (SELECT domain_path, count(*) AS units, count(*) FILTER (WHERE tier = 'L1') AS a, count(*) FILTER (WHERE tier = 'L2') AS b,
      count(*) FILTER (WHERE tier = 'L3') AS c, count(*) FILTER (WHERE tier = 'L4') AS d FROM valid GROUP BY 1)
      SELECT domain_path, '{"units":' || units || ',"L1":' || a || ',"L2":' || b || ',"L3":' || c || ',"L4":' || d || '}' AS line FROM p""",
    "m47_unit_faults": V + rf""", ids AS (SELECT lower(regexp_replace(id, '{SPACE}', '', 'g')) AS id, revision FROM graded_units WHERE id IS NOT NULL),
      l AS (SELECT id, lower(regexp_replace(p, '{SPACE}', '', 'g')) AS parent FROM (SELECT id, unnest(inherits_from) AS p FROM valid))
      SELECT DISTINCT id, 'repeated row' AS fault FROM ids GROUP BY id, revision HAVING count(*) > 1
      UNION SELECT id, 'parent without a row' FROM l WHERE parent <> '' AND parent NOT IN (SELECT id FROM valid)""",
    "m50_charged": V + rf""", s AS (SELECT id, domain_path, inherits_from, ceil(octet_length(encode(coalesce(body, ''))) / 4)::BIGINT AS tokens FROM valid),
      l AS (SELECT DISTINCT domain_path, lower(regexp_replace(p, '{SPACE}', '', 'g')) AS parent FROM (SELECT domain_path, unnest(inherits_from) AS p FROM s)),
      c AS (SELECT l.domain_path, sum(s.tokens) AS parents FROM l JOIN s ON s.id = l.parent GROUP BY 1),
      o AS (SELECT domain_path, sum(tokens) AS own FROM s GROUP BY 1)
      SELECT o.domain_path, own::BIGINT AS own, coalesce(parents, 0)::BIGINT AS parents FROM o LEFT JOIN c ON c.domain_path IS NOT DISTINCT FROM o.domain_path""",
}
