"""Top-k per group, latest row per key and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Above this k, one reducer per group would receive k rows from every map task.
TWO_LEVEL_FROM = 64
# Bounds for broadcast sides: rows of a few scalar columns, and rows that carry a vector.
BROADCAST_ROWS = 200_000
BROADCAST_VECTORS = 5_000


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The k first rows of every group with their rank.

    The literal bound lets Spark drop rows beyond k before the shuffle (WindowGroupLimit), so a hot
    group costs k rows per map task. For large k a round of partial top-k per (group, slice of map
    tasks) comes first, so that no reducer sees k rows from all of them.
    """
    if k > TWO_LEVEL_FROM:
        slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        partial = W.partitionBy(*keys, "_slice").orderBy(*order)
        df = (
            df.withColumn("_slice", F.spark_partition_id() % F.lit(slices))
            .withColumn("_n", F.row_number().over(partial))
            .where(F.col("_n") <= k)
            .drop("_n", "_slice")
        )
    final = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= k)


def latest_by_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in `order`. Copies of a key fall away before the shuffle."""
    return top_k(df, [key], order, 1, rank="_rank").drop("_rank")


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a derived side for broadcast only after counting it; beyond the bound Spark chooses.

    The side is cached, so that the check and the join compute it once.
    """
    df = df.persist()
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
