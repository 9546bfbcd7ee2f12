"""Stages in the shared folder, rows in sorted runs, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptstrata.session import BATCH_ROWS, new_path, ship_package, short_batches  # noqa: F401


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Tables written to the shared folder: they outlive executors and are dropped once not needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(stored)] = path
        return stored

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.paths.pop(id(table), None)
            if path:
                remove_path(self.spark, path)


SMALL_ROWS = 1_000_000


def small_side(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A stored table of a few numbers a row, marked for broadcast if it is counted below the bound.

    A million rows are some 30 MB on every executor. Above the bound Spark shuffles both sides.
    """
    return F.broadcast(table) if table.count() <= rows else table


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by the keys: a group never straddles two tables."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        last = [table[k][table.num_rows - 1].as_py() for k in keys]
        cut = table.num_rows
        same = [table[k].to_numpy(zero_copy_only=False) for k in keys]
        while cut and all(column[cut - 1] == value for column, value in zip(same, last, strict=True)):
            cut -= 1
        if cut:
            yield pa.concat_tables([*held, table.slice(0, cut)])
            held = []
        held.append(table.slice(cut))
    if held:
        yield pa.concat_tables(held)


def components(edges: DataFrame, scratch: Scratch, check: Callable[[int], None] | None = None) -> DataFrame:
    """Connected components of the undirected edges (a, b): one row (node, root) per node, root the smallest node.

    Alternates large-star and small-star: every round links each node to the smallest node that it or a
    neighbour knows. Hubs only ever meet a minimum, which Spark combines before the shuffle, and a join
    that adaptive execution can split. Rounds end when the edges no longer change.
    """
    pair = [F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")]
    current = scratch.keep(edges.where("a <> b").select(*pair).distinct(), "edges")
    seen, rounds = None, 0
    while True:
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        following = scratch.keep(small, "edges")
        scratch.drop(current, large)
        current = following
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        rounds += 1
        if check:
            check(rounds)
        if state == seen:
            break
        seen = state
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
