"""Silhouette scores and the choice of the cluster count."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptstrata.operators.distances import BLOCK_ROWS, euclidean, membership
from conceptstrata.operators.ranking import broadcast_checked
from conceptstrata.session import task_count

MAX_K = 8
MEASURES = ("exact", "squared")

_SUMS = "query_id bigint, point_id string, k array<int>, own array<int>, other array<int>, distance array<double>"
_NUMBERS = pa.list_(pa.int32())
_NO_SUMS = pa.schema(
    [("query_id", pa.int64()), ("point_id", pa.string()), ("k", _NUMBERS), ("own", _NUMBERS), ("other", _NUMBERS), ("distance", pa.list_(pa.float64()))]
).empty_table()
# Numbers that a task holds of a block, its vectors and the sums per cluster: 32 MB.
BLOCK_VALUES = 4 << 20


def point_silhouettes(points: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact Euclidean silhouette of every point under every k.

    points: query_id, point_id, vector; labels: query_id, k, point_id, cluster. A set is cut into blocks; a task takes two
    of them, measures their distances strip by strip and hands on one row per point with its sums per cluster, so that no
    pair of points ever becomes a row. A block has at least `block_rows` rows; a large set has just the blocks whose pairs
    keep all tasks busy, as its rows are sent once per block: what is shuffled grows with the rows until a block
    has BLOCK_VALUES numbers.
    """
    packed = labels.groupBy("query_id", "point_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "cluster"))).alias("labels")
    )
    members = broadcast_checked(labels.groupBy("query_id", "k", "cluster").agg(F.count("*").alias("n")))
    tasks = task_count(points.sparkSession)
    sizes = block_counts(points, members, tasks, block_rows)
    rows = (
        points.select("query_id", "point_id", "vector")
        .join(packed, ["query_id", "point_id"])
        .join(sizes, "query_id")
        .withColumn("_mine", F.pmod(F.xxhash64("point_id"), F.col("_blocks")).cast("int"))
        .select(
            "query_id",
            "point_id",
            "vector",
            F.col("labels.k").alias("ks"),
            F.col("labels.cluster").alias("clusters"),
            "_mine",
            "_blocks",
        )
    )
    columns = ["query_id", "point_id", "vector", "ks", "clusters"]
    # Each pair of blocks once, the smaller number on the left.
    left = rows.select(*columns, F.col("_mine").alias("_left"), F.explode(F.sequence("_mine", F.col("_blocks") - 1)).alias("_right"))
    right = rows.select(*[F.col(c).alias(c) for c in columns], F.explode(F.sequence(F.lit(0), "_mine")).alias("_left"), F.col("_mine").alias("_right"))
    block = ["query_id", "_left", "_right"]
    left, right = left.repartition(tasks, *block), right.repartition(tasks, *block)
    sums = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(_distance_sums, _SUMS)

    # Sent by point as they are; all that follows lies in the same tasks.
    sent = sums.repartition("query_id", "point_id")
    each = sent.select("query_id", "point_id", F.explode(F.arrays_zip("k", "own", "other", "distance")).alias("s")).select("query_id", "point_id", "s.*")
    per_cluster = each.groupBy("query_id", "k", "point_id", "own", "other").agg(F.sum("distance").alias("distance"))
    own = F.col("own") == F.col("other")
    means = per_cluster.join(members.withColumnRenamed("cluster", "other"), ["query_id", "k", "other"]).groupBy(
        "query_id", "k", "point_id", "own"
    ).agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("distance") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("distance") / F.col("n"))).alias("b"),
    )
    width = F.greatest("a", "b")
    score = F.when(F.col("a").isNotNull() & (width > 0), (F.col("b") - F.col("a")) / width).otherwise(F.lit(0.0))
    return means.select("query_id", "k", "point_id", F.col("own").alias("cluster"), score.alias("silhouette"))


def block_counts(points: DataFrame, members: DataFrame, tasks: int, block_rows: int) -> DataFrame:
    """(query_id, _blocks): the blocks of a set, as few as give each task a pair of them and leave each within its bounds."""
    slots = members.groupBy("query_id").agg(F.count("*").alias("_slots"))
    most = F.lit(BLOCK_VALUES) / (F.col("_dims") + F.col("_slots"))
    rows_of_block = F.greatest(F.lit(block_rows), F.least(F.col("_rows") / F.lit(math.ceil(math.sqrt(2 * tasks))), most))
    return (
        points.groupBy("query_id")
        .agg(F.count("*").alias("_rows"), F.max(F.size("vector")).alias("_dims"))
        .join(slots, "query_id")
        .select("query_id", F.ceil(F.col("_rows") / rows_of_block).cast("int").alias("_blocks"))
    )


def _matrix(lists: pa.Array, rows: int) -> np.ndarray:
    """Lists of one length as the rows of a matrix; a null or another length is refused, as its values would shift."""
    values = lists.flatten().to_numpy()
    if (np.diff(lists.offsets.to_numpy()) * rows != len(values)).any():
        raise ValueError("vectors and labels of a set must be as long as each other")
    return values.reshape(rows, -1)


class _Block:
    """The rows of a block in the order of their ids, with their clusters as the columns of a 0/1 matrix."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks().sort_by("point_id")
        self.query, self.ids, n = table["query_id"].combine_chunks(), table["point_id"].combine_chunks(), table.num_rows
        self.vectors = _matrix(table["vector"].combine_chunks(), n).astype(np.float64)
        self.own = _matrix(table["clusters"].combine_chunks(), n)
        self.ks = np.array(table["ks"][0].as_py(), np.int32)
        coded = [np.unique(own, return_inverse=True) for own in self.own.T]
        self.place = np.repeat(np.arange(len(coded)), [len(present) for present, _ in coded])
        self.present = np.concatenate([present for present, _ in coded])
        self.member = np.hstack([membership(code, len(present)) for present, code in coded])

    def sums(self, other: _Block, distance: np.ndarray) -> pa.Table:
        """One row per point: its summed distances to the members of each cluster of the other block."""
        n, width = distance.shape
        cuts = pa.array(np.arange(0, n * width + 1, width, dtype=np.int32))

        def lists(values: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(cuts, pa.array(values.ravel()))

        k, own = np.tile(other.ks[other.place], n), self.own[:, other.place].astype(np.int32)
        parts = [self.query, self.ids, lists(k), lists(own), lists(np.tile(other.present.astype(np.int32), n)), lists(distance)]
        return pa.table(parts, ["query_id", "point_id", "k", "own", "other", "distance"])


def _distance_sums(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Per point of either block and cluster: sum of the distances to the other block's members."""
    if not left.num_rows or not right.num_rows:
        return _NO_SUMS
    same = key[1] == key[2]  # the same rows on both sides
    left = _Block(left)
    right = left if same else _Block(right)
    ahead = np.empty((len(left.vectors), right.member.shape[1]))
    back = np.zeros((len(right.vectors), left.member.shape[1]))
    step = max(1, BLOCK_ROWS**2 // len(right.vectors))
    for low in range(0, len(left.vectors), step):
        distance = euclidean(left.vectors[low : low + step], right.vectors)
        if same:
            strip = np.arange(len(distance))
            distance[strip, low + strip] = 0.0
        else:
            back += distance.T @ left.member[low : low + step]
        ahead[low : low + step] = distance @ right.member
    forth = left.sums(right, ahead)
    return forth if same else pa.concat_tables([forth, right.sums(left, back)])


def silhouette(points: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean exact silhouette per (query_id, k)."""
    return (
        point_silhouettes(points, labels, block_rows)
        .groupBy("query_id", "k")
        .agg(F.avg("silhouette").alias("silhouette"))
        .withColumn("measure", F.lit("exact"))
    )


def silhouette_large(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Squared-Euclidean silhouette per (query_id, k), linear in the number of points.

    For sets whose pairwise distances are out of reach; the caller chooses it, as it is another measure.
    """
    joined = labels.join(
        points.select("query_id", "point_id", array_to_vector("vector").alias("features")), ["query_id", "point_id"]
    ).persist()
    evaluator = ClusteringEvaluator(predictionCol="cluster", featuresCol="features")
    models = joined.select("query_id", "k").distinct().collect()  # one row per model
    scores = [
        (m.query_id, m.k, float(evaluator.evaluate(joined.where((F.col("query_id") == m.query_id) & (F.col("k") == m.k)))))
        for m in models
    ]
    return points.sparkSession.createDataFrame(scores, "query_id bigint, k int, silhouette double").withColumn(
        "measure", F.lit("squared")
    )


def k_candidates(queries: DataFrame, max_k: int = MAX_K) -> DataFrame:
    """Cluster counts to try per query: n_clusters if it is >= 2, else every k from 2 to max_k.

    Of the automatic ones, a set of n rows uses those up to n - 1, and at least 2; a set smaller than
    k stays unclustered. `automatic` tells the two cases apart.
    """
    given = F.coalesce(F.col("n_clusters") >= 2, F.lit(False))
    ks = F.when(given, F.array(F.col("n_clusters").cast("int"))).otherwise(F.sequence(F.lit(2), F.lit(max_k)))
    return queries.select("query_id", F.explode(ks).alias("k"), (~given).alias("automatic"))


def best_k(scores: DataFrame) -> DataFrame:
    """Per set the k with the largest silhouette, the smallest such k on ties."""
    return scores.groupBy("query_id").agg(
        F.max_by("k", F.struct(F.col("silhouette"), -F.col("k"))).alias("k"),
        F.max("silhouette").alias("silhouette"),
    )
