"""Evaluation of candidates: frontier, retention, timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pareto_frontier(candidates: DataFrame, group: str, good: str, cost: str) -> DataFrame:
    """Candidates of each group that no other one beats: none has at least as much of ``good`` at no more ``cost`` and more of one.

    By a running maximum over rising cost instead of pairs: of equal cost only the best stay, and only
    where they are better than all cheaper ones. Equal candidates stay together.
    """
    best = candidates.groupBy(group, cost).agg(F.max(good).alias("_best"))
    w = Window.partitionBy(group).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    steps = best.withColumn("_before", F.max("_best").over(w)).where("_before is null or _best > _before")
    return candidates.join(
        steps.select(group, cost, F.col("_best").alias(good)), [group, cost, good], "left_semi"
    )


def retention(cases: DataFrame, group: str, margin: float = 0.0) -> DataFrame:
    """Of each group: kept_pass, lost, gained, kept_fail, faulty, retention, speedup, guard_ok.

    cases: baseline_pass, candidate_pass, baseline_ms, candidate_ms, guard. Null flags and times that are
    given but not positive are evaluation errors. The speedup is the geometric mean over cases that pass
    twice and have both times; guards must all pass twice, at no less than 1 - ``margin``.
    """
    bad = F.col("baseline_pass").isNull() | F.col("candidate_pass").isNull()
    bad = bad | F.coalesce((F.col("baseline_ms") <= 0) | (F.col("candidate_ms") <= 0), F.lit(False))
    bucket = (
        F.when(bad, "faulty")
        .when(F.col("baseline_pass") & F.col("candidate_pass"), "kept_pass")
        .when(F.col("baseline_pass"), "lost")
        .when(F.col("candidate_pass"), "gained")
        .otherwise("kept_fail")
    )
    ratio = F.when(F.col("bucket") == "kept_pass", F.col("baseline_ms") / F.col("candidate_ms"))
    names = ("kept_pass", "lost", "gained", "kept_fail", "faulty")
    rows = cases.withColumn("bucket", bucket).withColumn("ratio", ratio)
    kept = F.count_if(F.col("bucket") == "kept_pass")
    lost = F.count_if(F.col("bucket") == "lost")
    guards = F.min(F.when(F.col("guard"), F.coalesce((F.col("bucket") == "kept_pass") & (F.col("ratio") >= 1 - margin), F.lit(False))))
    return rows.groupBy(group).agg(
        *[F.count_if(F.col("bucket") == n).alias(n) for n in names],
        F.round(F.try_divide(kept, kept + lost), 6).alias("retention"),
        F.round(F.exp(F.avg(F.log("ratio"))), 6).alias("speedup"),
        guards.alias("guard_ok"),
    )
