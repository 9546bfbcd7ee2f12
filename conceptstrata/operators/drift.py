"""Movement of a concept's vectors between time slices."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptstrata.functions.vectors import cosine, squared_distance
from conceptstrata.operators.ranking import BROADCAST_VECTORS, broadcast_checked, top_k


def time_slices(papers: DataFrame, width: int = 10, time: str = "year") -> DataFrame:
    """Add `slice`, the first year of the fixed-width period a paper falls in."""
    return papers.withColumn("slice", (F.floor(F.col(time) / width) * width).cast("int"))


def centroids(points: DataFrame, keys: list[str], vector: str = "dense_vector") -> DataFrame:
    """Mean vector and size per group, summed within the tasks first."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(vector)))
    return points.groupBy(*keys).agg(mean.alias("centroid"), F.count("*").alias("n"))


def adjacent_drift(slice_centroids: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cosine distance from every slice's centroid to the one before it (null for the first)."""
    keys = keys or ["query_id"]
    w = W.partitionBy(*keys).orderBy("slice")
    return slice_centroids.withColumn("_before", F.lag("centroid").over(w)).select(
        *keys,
        "slice",
        "n",
        F.when(F.col("_before").isNotNull(), F.lit(1.0) - cosine(F.col("centroid"), F.col("_before"))).alias("drift"),
    )


def trajectory(slice_centroids: DataFrame) -> DataFrame:
    """Centroids projected on their first two principal components."""
    features = slice_centroids.withColumn("_features", array_to_vector("centroid"))
    projected = PCA(k=2, inputCol="_features", outputCol="_xy").fit(features).transform(features)
    xy = vector_to_array("_xy")
    return projected.select(
        *[c for c in slice_centroids.columns if c != "centroid"], xy[0].alias("x"), xy[1].alias("y")
    )


def top_per_slice(papers: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """Best-scored papers of every slice."""
    return top_k(papers, [*(keys or ["query_id"]), "slice"], [F.desc("score"), F.col("arxiv_id")], k)


def novelty(points: DataFrame, group_centroids: DataFrame, keys: list[str], vector: str = "dense_vector") -> DataFrame:
    """1 - cosine to the centroid of the paper's own group."""
    return points.join(broadcast_checked(group_centroids.drop("n"), BROADCAST_VECTORS), keys).withColumn(
        "novelty", F.lit(1.0) - cosine(F.col(vector), F.col("centroid"))
    ).drop("centroid")


def spread(points: DataFrame, slice_centroids: DataFrame, keys: list[str], vector: str = "dense_vector") -> DataFrame:
    """Mean squared distance to the centroid per group."""
    return (
        points.join(broadcast_checked(slice_centroids.drop("n"), BROADCAST_VECTORS), keys)
        .groupBy(*keys)
        .agg(F.avg(squared_distance(F.col(vector), F.col("centroid"))).alias("spread"), F.count("*").alias("n"))
    )
