"""Ordered and stateful operators over attempts, blocks and events, as windows and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What an attempt's status says of progress.
PROGRESS, NEGATIVE = ("applied", "returned"), ("failed",)
MOVES = (("prepared", "invoking"), ("invoking", "returned"), ("invoking", "failed"), ("returned", "applied"))


def attempts(rows: DataFrame) -> DataFrame:
    """One row an attempt: the latest update (ties: the greater status); null attempt ids are ignored."""
    rest = [c for c in rows.columns if c != "attempt_id"]
    return (
        rows.where("attempt_id is not null")
        .groupBy("attempt_id")
        .agg(F.max_by(F.struct(*rest), F.struct("updated", "status")).alias("row"))
        .select("attempt_id", "row.*")
    )


def stagnation(rows: DataFrame, limit: int = 3) -> DataFrame:
    """task_id, attempts, streak, state: negative attempts since the last progress, by time; others are neutral.

    ``stuck`` from ``limit`` on, else ``slowing`` with a streak, ``moving`` after any progress,
    else ``unproven``. Ordered by created, then attempt_id; null tasks form a task of their own.
    """
    flags = rows.select(
        "task_id", "created", "attempt_id", F.col("status").isin(*PROGRESS).alias("up"), F.col("status").isin(*NEGATIVE).alias("down")
    )
    when = F.struct("created", "attempt_id")
    last = flags.groupBy("task_id").agg(F.max(F.when(F.col("up"), when)).alias("last"), F.count("*").alias("attempts"))
    streak = F.count_if(F.col("down") & (F.col("last").isNull() | (when > F.col("last"))))
    joined = flags.join(last.withColumnRenamed("task_id", "t"), F.col("task_id").eqNullSafe(F.col("t")))
    per = joined.groupBy("task_id").agg(
        F.first("attempts").alias("attempts"), streak.alias("streak"), F.max(F.col("last").isNotNull()).alias("ever")
    )
    state = (
        F.when(F.col("streak") >= limit, "stuck").when(F.col("streak") > 0, "slowing").when(F.col("ever"), "moving").otherwise("unproven")
    )
    return per.select("task_id", "attempts", "streak", state.alias("state"))


def settled(rows: DataFrame) -> DataFrame:
    """batch_id, attempts, state: failed before pending before complete."""
    state = (
        F.when(F.max(F.col("status") == "failed"), "failed")
        .when(F.min(F.col("status") == "applied"), "complete")
        .otherwise("pending")
    )
    return rows.groupBy("batch_id").agg(F.count("*").alias("attempts"), state.alias("state"))


def blocks(rows: DataFrame) -> DataFrame:
    """One row a task and block: the greater of repeated rows."""
    rest = F.struct("pos", "n_bytes", "sha256", "title", "source_range", "indexed")
    return rows.groupBy("task_id", "block_id").agg(F.max(rest).alias("row")).select("task_id", "block_id", "row.*")


def neighbours(rows: DataFrame) -> DataFrame:
    """task_id, pos, block_id, previous, following: of each block the blocks beside it, by pos, then id."""
    w = Window.partitionBy("task_id").orderBy("pos", "block_id")
    return rows.select(
        "task_id", "pos", "block_id", F.lag("block_id").over(w).alias("previous"), F.lead("block_id").over(w).alias("following")
    )


def coverage_gaps(rows: DataFrame) -> DataFrame:
    """task_id, gap_start, gap_end between ranges of a task that are covered by none; null ranges are left out."""
    r = rows.select("task_id", F.col("source_range.range_start").alias("a"), F.col("source_range.range_end").alias("b"))
    w = Window.partitionBy("task_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    return (
        r.where("a is not null and b is not null")
        .withColumn("reached", F.max("b").over(w))
        .where("a > reached")
        .select("task_id", F.col("reached").alias("gap_start"), F.col("a").alias("gap_end"))
    )


def packed(rows: DataFrame, most: int = 8, most_bytes: int = 65_536) -> DataFrame:
    """task_id, batch, blocks, n_bytes: blocks in order, a new batch where one more block would be too many or too large.

    A block that is too large alone has a batch of its own. A task's list is a row of at most its own blocks.
    """
    ordered = rows.groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "block_id", F.coalesce("n_bytes", F.lit(0)).alias("n")))).alias("rows")
    )
    state = "struct<done: array<struct<blocks: int, n_bytes: bigint>>, blocks: int, n_bytes: bigint>"
    start = F.struct(
        F.array().cast("array<struct<blocks: int, n_bytes: bigint>>").alias("done"), F.lit(0).alias("blocks"), F.lit(0).cast("bigint").alias("n_bytes")
    ).cast(state)

    def close(s: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(s["blocks"].alias("blocks"), s["n_bytes"].alias("n_bytes"))))

    def take(s: Column, x: Column) -> Column:
        fits = (s["blocks"] < most) & (s["n_bytes"] + x["n"] <= most_bytes) | (s["blocks"] == 0)
        more = F.struct(s["done"].alias("done"), (s["blocks"] + 1).alias("blocks"), (s["n_bytes"] + x["n"]).alias("n_bytes"))
        new = F.struct(close(s).alias("done"), F.lit(1).alias("blocks"), x["n"].alias("n_bytes"))
        return F.when(fits, more.cast(state)).otherwise(new.cast(state))

    batches = F.aggregate("rows", start, take, close)
    return ordered.select("task_id", F.posexplode(batches).alias("batch", "b")).select("task_id", "batch", "b.blocks", "b.n_bytes")


def reference_check(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """block_id, state of every block that is listed or described: both, missing (no row) or unreferenced."""
    listed = lists.select(F.explode(F.from_json("block_ids", "array<string>")).alias("block_id")).where("block_id is not null").distinct()
    there = rows.select("block_id").distinct()
    both = listed.withColumn("l", F.lit(1)).join(there.withColumn("t", F.lit(1)), "block_id", "full")
    state = F.when(F.col("t").isNull(), "missing").when(F.col("l").isNull(), "unreferenced").otherwise("both")
    return both.select("block_id", state.alias("state"))


def transitions(rows: DataFrame) -> DataFrame:
    """Of deliveries of a unit in order: before, after, moves (units whose status went so), null statuses counting as active."""
    w = Window.partitionBy("id").orderBy("snapshot_id")
    status = F.coalesce("status", F.lit("active"))
    return (
        rows.select("id", "snapshot_id", status.alias("after"))
        .withColumn("before", F.lag("after").over(w))
        .where("before is not null and before != after")
        .groupBy("before", "after")
        .agg(F.count("*").alias("moves"))
    )
