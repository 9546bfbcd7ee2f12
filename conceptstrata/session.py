"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # One Arrow batch of 768-d float vectors stays near 12 MB; `short_batches` sets fewer for whole texts.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def build_session(app_name: str = "conceptstrata", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are written for; `conf` wins over the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by `spark.checkpoint.dir`.

    Only where the session names none (tests, a laptop) is a folder of our own chosen.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="conceptstrata-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    It outlives lost executors, is computed once however often it is used, and gives the planner its
    true size.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    """Tasks for CPU-heavy groups, whose small size would otherwise get them merged into few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(table: DataFrame) -> DataFrame:
    """Deal the rows of a table read in fewer splits than there are cores; larger tables stay as they lie.

    For a plain table scan: looking at its splits runs no job.
    """
    spark = table.sparkSession
    few = table.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    return table.repartition(task_count(spark)) if few else table


BATCH_ROWS = 1_000


def short_batches(spark: SparkSession) -> None:
    """Send whole texts to Python in batches of at most BATCH_ROWS rows, some megabytes, unless fewer are set."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, for sessions that were started without it."""
    name = "conceptstrata.zip"
    if any(added.endswith(name) for added in spark.sparkContext.listFiles):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="conceptstrata-"), name)
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)  # Spark copies it to every executor
