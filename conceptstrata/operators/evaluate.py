"""Comparison of result lists and timing tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptstrata.operators.ranking import top_k


def jaccard_by_method(hits: DataFrame, methods: list[str], item: str = "arxiv_id") -> DataFrame:
    """Jaccard overlap of every pair of methods per query, 0 where both lists are empty.

    hits: query_id, method, item. One shuffle on (query, item) serves all pairs.
    """
    held = {m: F.max((F.col("method") == m).cast("int")) for m in methods}
    per_item = hits.groupBy("query_id", item).agg(*[flag.alias(m) for m, flag in held.items()])
    overlaps = []
    for a, b in combinations(methods, 2):
        both, either = F.sum(F.col(a) * F.col(b)), F.sum(F.greatest(a, b))
        overlaps.append(F.when(either > 0, both / either).otherwise(F.lit(0.0)).alias(f"jaccard_{a}_{b}"))
    sizes = [F.sum(m).alias(f"n_results_{m}") for m in methods]
    return per_item.groupBy("query_id").agg(*overlaps, *sizes)


def top_by_method(hits: DataFrame, n: int = 10) -> DataFrame:
    """First n rows of every (query, method) list."""
    return top_k(hits, ["query_id", "method"], [F.desc("score"), F.col("arxiv_id")], n)


def stage_summary(timings: DataFrame) -> DataFrame:
    """Mean time per stage with its share of the sum of means, and a Total row.

    timings: stage, time_sec.
    """
    means = timings.groupBy("stage").agg(F.avg("time_sec").alias("avg_time_sec"))
    total = means.agg(F.sum("avg_time_sec").alias("total"))
    shared = means.withColumn("percent_time_sec", F.col("avg_time_sec") / total.scalar() * 100)
    return shared.rollup("stage").agg(
        F.sum("avg_time_sec").alias("avg_time_sec"), F.sum("percent_time_sec").alias("percent_time_sec")
    ).withColumn("stage", F.coalesce("stage", F.lit("Total")))


def throughput(runs: DataFrame) -> DataFrame:
    """Add papers_per_sec to runs with n_papers and time_sec; 0 for a run without duration."""
    return runs.withColumn(
        "papers_per_sec",
        F.when(F.col("time_sec") > 0, F.col("n_papers") / F.col("time_sec")).otherwise(F.lit(0.0)),
    )
