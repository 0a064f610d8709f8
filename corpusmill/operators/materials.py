"""Material blocks and documents, phrases in queries, and results that depend on one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import lossless_pieces, normal_trigger, terms

# What an attempt's error asks for.
REMEDIES = {"timeout": "retry", "schema": "repair", "budget": "split"}


def block_texts(rows: DataFrame) -> DataFrame:
    """id (task/block), header (title), body (summary), one row a task and block: the greater of repeated rows."""
    best = rows.groupBy("task_id", "block_id").agg(F.max(F.struct("title", "summary")).alias("b"))
    return best.select(F.concat_ws("/", "task_id", "block_id").alias("id"), F.col("b.title").alias("header"), F.col("b.summary").alias("body"))


def best_of_tasks(scored: DataFrame) -> DataFrame:
    """Of each query and task the block with the highest score (ties: the least block): query_id, task_id, block_id, score.

    scored: query_id, id (task/block), score. The best is found by partial aggregation, so a task with very many
    blocks sends one row a task of Spark and query.
    """
    task, block = F.substring_index("id", "/", 1), F.substring_index("id", "/", -1)
    best = scored.groupBy("query_id", task.alias("task_id")).agg(F.min(F.struct((-F.col("score")).alias("s"), block.alias("block_id"))).alias("b"))
    return best.select("query_id", "task_id", "b.block_id", (-F.col("b.s")).alias("score"))


def phrase_hits(queries: DataFrame, phrases: DataFrame) -> DataFrame:
    """query_id, phrase: the phrases whose words stand in a query, one after the other.

    queries: query_id, query; phrases: phrase. Both are taken as runs of a-z and 0-9 in lower case. Runs of
    as many words as some phrase has are looked up by equality, so no query meets every phrase. Null and
    empty texts hold nothing; each phrase counts once for a query.
    """
    known = phrases.select(normal_trigger("phrase").alias("phrase")).where("phrase != ''").distinct()
    lengths = known.agg(F.collect_set(F.size(F.split("phrase", " "))).alias("lengths"))  # one row, as long as phrases differ in length
    words = queries.select("query_id", F.split(normal_trigger("query"), " ").alias("w")).where("w is not null")
    places = F.sequence(F.lit(1), F.size("w"))

    def runs(n: Column) -> Column:
        return F.transform(F.filter(places, lambda i: i <= F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))

    grams = words.join(F.broadcast(lengths)).select("query_id", F.explode(F.array_distinct(F.flatten(F.transform("lengths", runs)))).alias("phrase"))
    return grams.join(known, "phrase").select("query_id", "phrase")


def query_terms(queries: DataFrame, phrases: DataFrame, fillers: DataFrame) -> DataFrame:
    """query_id, terms: index terms of a query, each once, in order.

    Terms in ``fillers`` (column term) are left out unless nothing else stands in the query; every phrase that
    the query holds is added as one term, its words joined by ``_``, in order of spelling. A null query
    has no terms.
    """
    words = queries.select("query_id", F.posexplode(F.array_distinct(terms("query", parts=False))).alias("place", "term"))
    marked = words.join(fillers.select("term", F.lit(1).alias("filler")).distinct(), "term", "left")
    split = marked.groupBy("query_id").agg(  # a group is one query
        F.array_sort(F.collect_list(F.struct("place", "term"))).alias("every"),
        F.array_sort(F.collect_list(F.when(F.col("filler").isNull(), F.struct("place", "term")))).alias("kept"),
    )
    aliases = phrase_hits(queries, phrases).groupBy("query_id").agg(F.array_sort(F.collect_set(F.replace("phrase", F.lit(" "), F.lit("_")))).alias("aliases"))
    own = F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("every"))["term"]
    none = F.array().cast("array<string>")
    joined = queries.select("query_id").distinct().join(split, "query_id", "left").join(aliases, "query_id", "left")
    return joined.select("query_id", F.array_distinct(F.concat(F.coalesce(own, none), F.coalesce("aliases", none))).alias("terms"))


def uncovered(ranked: DataFrame, above: DataFrame) -> DataFrame:
    """The hits (query_id, id, rank) that no better-ranked hit of the same query inherits from; above: id, ancestor_id."""
    covered = (
        ranked.select("query_id", "id", F.col("rank").alias("by"))
        .join(above.select("id", "ancestor_id"), "id")
        .groupBy("query_id", F.col("ancestor_id").alias("id"))
        .agg(F.min("by").alias("by"))
    )
    joined = ranked.join(covered, ["query_id", "id"], "left")
    return joined.where("by is null or by >= rank").drop("by")


def inherited_status(status: DataFrame, above: DataFrame) -> DataFrame:
    """id, status, open_keys of each unit together with its ancestors: a mismatch outweighs an unknown.

    status: id, status, open_keys; above: id, ancestor_id. Ancestors without a row say nothing.
    """
    level = F.when(F.col("status") == "mismatch", 2).when(F.col("status") == "unknown", 1).otherwise(0)
    own = status.select("id", level.alias("level"), F.filter(F.split("open_keys", ","), lambda k: k != "").alias("keys"))
    handed = above.join(own.withColumnRenamed("id", "ancestor_id"), "ancestor_id").select("id", "level", "keys")
    per = own.unionByName(handed).select("id", "level", F.explode_outer("keys").alias("key")).groupBy("id")
    worst = per.agg(F.max("level").alias("level"), F.array_join(F.array_sort(F.collect_set("key")), ",").alias("open_keys"))
    return worst.select("id", F.element_at(F.array(F.lit("matched"), F.lit("unknown"), F.lit("mismatch")), F.col("level") + 1).alias("status"), "open_keys")


def retired(status: DataFrame, above: DataFrame) -> DataFrame:
    """id, reason of units that go: ``withdrawn`` themselves, else ``dangling`` below a unit that is withdrawn or has no row.

    status: id, withdrawn (boolean); above: id, ancestor_id. The closure holds all ancestors, so that one join
    reaches what repeated removal would.
    """
    ancestors = above.join(status.select(F.col("id").alias("ancestor_id"), F.col("withdrawn").alias("lost")), "ancestor_id", "left")
    dangling = ancestors.where("coalesce(lost, true)").select("id").distinct().withColumn("dangling", F.lit(True))
    rows = status.join(dangling, "id", "left").where("withdrawn or dangling")
    return rows.select("id", F.when(F.col("withdrawn"), "withdrawn").otherwise("dangling").alias("reason"))


def rebased(remote: DataFrame, sent: DataFrame, draft: DataFrame) -> DataFrame:
    """id, revision, origin, differs: the remote rows, and of the draft those that are neither sent nor remote.

    All three: id, revision, one row an id. ``differs``: the draft holds a remote id in another revision. One shuffle.
    """
    sides = [x.select("id", "revision", F.lit(s).alias("side")) for s, x in (("remote", remote), ("sent", sent), ("draft", draft))]
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2])
    side = lambda s: F.max(F.when(F.col("side") == s, F.struct("revision")))
    per = rows.groupBy("id").agg(side("remote").alias("remote"), side("sent").alias("sent"), side("draft").alias("draft"))
    kept = per.where("remote is not null or (draft is not null and sent is null)")
    origin = F.when(F.col("remote").isNotNull(), "remote").otherwise("draft")
    differs = F.col("remote").isNotNull() & F.col("draft").isNotNull() & ~F.col("remote.revision").eqNullSafe(F.col("draft.revision"))
    return kept.select("id", F.coalesce(F.col("remote"), F.col("draft"))["revision"].alias("revision"), origin.alias("origin"), differs.alias("differs"))


def even_shares(rows: DataFrame, page: int, budget: int) -> DataFrame:
    """task_id, place, block_id, share: the first ``page`` blocks of a task share ``budget`` bytes.

    Each in turn may take an even part of what is left among those still to come, and takes no more than it needs.
    Blocks come by pos, then id; an unknown size needs nothing.
    """
    w = Window.partitionBy("task_id").orderBy("pos", "block_id")
    first = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= page)
    lists = first.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("place", "block_id", F.coalesce("n_bytes", F.lit(0)).alias("need")))).alias("items"))
    state = "struct<left:bigint,done:array<struct<place:int,block_id:string,share:bigint>>>"
    start = F.struct(F.lit(budget).alias("left"), F.array().alias("done")).cast(state)

    def give(s: Column, x: Column) -> Column:
        share = F.least(x["need"], F.floor(s["left"] / (F.size("items") - x["place"] + 1)).cast("bigint"))
        row = F.struct(x["place"].alias("place"), x["block_id"].alias("block_id"), share.alias("share"))
        return F.struct((s["left"] - share).alias("left"), F.concat(s["done"], F.array(row)).alias("done")).cast(state)

    return lists.select("task_id", F.inline(F.aggregate("items", start, give)["done"]))


def stored_blocks(documents: DataFrame, limit: int) -> DataFrame:
    """doc_id, pos, block of every text that is not null, cut without loss; an empty text has one empty block."""
    pieces = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(lossless_pieces("text", limit, "\n"))
    return documents.where("text is not null").select("doc_id", F.posexplode(pieces).alias("pos", "block"))


def put_together(rows: DataFrame) -> DataFrame:
    """doc_id, text out of doc_id, pos, block in any order; a group is one text."""
    ordered = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("b"))
    return ordered.select("doc_id", F.array_join(F.col("b.block"), "").alias("text"))


def marked_indexed(rows: DataFrame, done: DataFrame) -> DataFrame:
    """rows (task_id, block_id, indexed) with ``now``: indexed before or listed in done (task_id, block_id); unknown ids change nothing."""
    joined = rows.join(done.distinct().withColumn("hit", F.lit(True)), ["task_id", "block_id"], "left")
    return joined.withColumn("now", F.coalesce("indexed", F.lit(False)) | F.col("hit").isNotNull()).drop("hit")


def two_sides(rows: DataFrame, reference: str, candidate: str) -> DataFrame:
    """case, state, reference_ms, candidate_ms, ratio: mean whole milliseconds of each case on both sides.

    rows: case, side, ms. A case that one side lacks is told by ``state`` and has no ratio.
    """
    mean = lambda s: (F.sum(F.when(F.col("side") == s, F.col("ms"))) / F.count(F.when(F.col("side") == s, F.col("ms")))).alias(s)
    per = rows.where(F.col("side").isin(reference, candidate) & F.col("ms").isNotNull()).groupBy("case").agg(mean(reference), mean(candidate))
    old, new = F.col(f"`{reference}`"), F.col(f"`{candidate}`")
    state = F.when(old.isNull(), "candidate only").when(new.isNull(), "reference only").otherwise("both")
    whole = lambda c: F.floor(c).cast("bigint")
    return per.select("case", state.alias("state"), whole(old).alias("reference_ms"), whole(new).alias("candidate_ms"), F.when(old > 0, F.round(new / old, 4)).alias("ratio"))


def remedy(status: Column | str, error: Column | str) -> Column:
    """What is to be done about an attempt that has not come back well: by its error, else ``unknown outcome`` while it is open."""
    status, error = (F.col(c) if isinstance(c, str) else c for c in (status, error))
    known = F.create_map(*[F.lit(x) for kv in REMEDIES.items() for x in kv])
    return F.when(status == "failed", F.coalesce(known[error], F.lit("look"))).when(status.isin("prepared", "invoking"), "unknown outcome")
