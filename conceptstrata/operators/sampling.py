"""Statistics over dates and categories, and repeatable samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptstrata.functions.keys import hash60, shuffle_key, uniform
from conceptstrata.operators.ranking import broadcast_checked, top_k

HASH_BITS, ROUND_BITS = 60, 12
FEW_ROWS = 5_000  # put in order by themselves


def categories(papers: DataFrame) -> DataFrame:
    return papers.select("primary_category").distinct().orderBy("primary_category")


def date_range(papers: DataFrame) -> DataFrame:
    return papers.agg(F.min("published_date").alias("min_date"), F.max("published_date").alias("max_date"))


def category_share(papers: DataFrame) -> DataFrame:
    """Share of every category among the dated rows.

    Rows are counted per category first; the window sees one row per category.
    """
    counts = papers.where(F.col("published_date").isNotNull()).groupBy("primary_category").count()
    total = F.sum("count").over(W.partitionBy())
    return counts.select("primary_category", (F.col("count") / total).alias("global_ratio"))


def time_buckets(papers: DataFrame, buckets: int) -> DataFrame:
    """Attach category share and equal-width time bucket 1..buckets (the last date falls in buckets+1).

    Undated rows and rows without category drop out.
    """
    share = broadcast_checked(category_share(papers).where(F.col("primary_category").isNotNull()))
    bounds = date_range(papers).select(F.struct("min_date", "max_date")).scalar()  # one pass for both

    def epoch(date: Column) -> Column:
        return F.unix_date(date) * F.lit(86400)

    return (
        papers.where(F.col("published_date").isNotNull())
        .join(share, "primary_category")
        .withColumn(
            "bucket_id",
            F.width_bucket(epoch(F.col("published_date")), epoch(bounds["min_date"]), epoch(bounds["max_date"]), F.lit(buckets)).cast("int"),
        )
    )


def stratified_sample(
    papers: DataFrame,
    target_size: int = 5000,
    buckets: int = 50,
    pinned: Sequence[str] = (),
    seed: int = 42,
) -> DataFrame:
    """Sample about `target_size` rows, spread evenly over time and by category share within a bucket.

    Each cell has a fractional target; rows are shuffled inside the cell (pinned ids first) and the
    fraction is rounded up at random. No cell can take more than target_size/buckets + 1 rows, so the
    ranking is cut at that literal bound before the shuffle and the exact bound is applied after it.
    """
    cell_target = target_size / buckets
    binned = time_buckets(papers, buckets).withColumns(
        {
            "exact_target": F.lit(cell_target) * F.col("global_ratio"),
            "_pin": F.when(F.col("arxiv_id").isin(*pinned), 0).otherwise(1) if pinned else F.lit(1),
            "_shuffle": shuffle_key(F.col("arxiv_id"), f"order-{seed}"),
        }
    )
    ranked = top_k(
        binned,
        ["bucket_id", "primary_category"],
        [F.col("_pin"), F.col("_shuffle"), F.col("arxiv_id")],
        math.floor(cell_target) + 1,
        rank="rnk",
    )
    whole = F.floor("exact_target")
    round_up = uniform(F.col("arxiv_id"), f"round-{seed}") < F.col("exact_target") - whole
    return ranked.where(F.col("rnk") <= whole + round_up.cast("int")).drop("_pin", "_shuffle")


def sample_listing(sample: DataFrame) -> DataFrame:
    """The sample in date order with the columns the encoder needs."""
    return sample.select(
        "arxiv_id", "title", "abstract", "primary_category", "published_date", "doi"
    ).orderBy("published_date", "arxiv_id")


def exact_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (fewer only if there are fewer), the same ones on every run: those with the n smallest hashes.

    The n-th smallest hash is found by counting: a round counts the rows by the next bits of the hash within the interval
    that holds it, so each round makes the interval some thousand times narrower. All rows below it are taken; only the
    few inside it are put in order. No row is moved to be ranked, whatever n.
    """
    hashed = df.withColumn("_hash", hash60(F.concat(F.lit(f"sample-{seed}:"), F.col(key).cast("string"))))
    below, low, bits = 0, 0, HASH_BITS  # rows before the interval [low, low + 2^bits)
    inside = None
    while bits and (inside is None or inside > FEW_ROWS):
        shift = max(0, bits - ROUND_BITS)
        part = hashed.where(F.col("_hash").between(low, low + (1 << bits) - 1))
        counts = part.groupBy(F.shiftright("_hash", shift).alias("cell")).count().orderBy("cell").collect()  # some thousand
        for r in counts:
            inside = r["count"]
            if below + inside >= n:
                low, bits = r.cell << shift, shift
                break
            below += inside
        else:
            return df  # there are no more than n
    taken = hashed.where(F.col("_hash") < low)
    last = hashed.where(F.col("_hash").between(low, low + (1 << bits) - 1)).orderBy("_hash", key).limit(n - below)
    return taken.unionByName(last).drop("_hash")
