"""JSON-lines metadata: scan, line numbers, systematic sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptstrata.operators.ranking import broadcast_checked
from conceptstrata.schemas import SOURCE_RECORD

# Bound for broadcasting the table of file splits (a path and three numbers per row)
SPLITS = 500_000


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records with the declared schema and an id.

    A field of another type is null and the rest of its record stays; lines that are no record have no id
    and are left to `malformed_lines`.
    """
    return spark.read.schema(SOURCE_RECORD).option("mode", "PERMISSIVE").json(path).where(F.col("id").isNotNull())


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that `read_records` leaves out, as text: no JSON, or without an id. Blank lines are none of either."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.where(F.from_json("value", SOURCE_RECORD, {"mode": "PERMISSIVE"})["id"].isNull())


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their 0-based position over all files in path order, without a global sort.

    Rows of one file split are consecutive within a task, so a position is the offset inside the
    split plus the number of lines in earlier splits. Only the split table (one row per file split)
    goes through the running sum; the lines are read twice and not shuffled.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    splits = lines.groupBy("_file", "_block").agg(F.min("_mid").alias("_first"), F.count("*").alias("_lines"))
    before = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_lines").over(before), F.lit(0))).drop("_lines")
    return lines.join(broadcast_checked(offsets, SPLITS), ["_file", "_block"]).select(
        (F.col("_mid") - F.col("_first") + F.col("_offset")).alias("line_no"), "value"
    )


def parse_lines(numbered: DataFrame) -> DataFrame:
    """Records of numbered lines, with `line_no`; the later line wins where an id occurs twice."""
    parsed = F.from_json("value", SOURCE_RECORD)
    return numbered.select("line_no", parsed.alias("r")).where(F.col("r.id").isNotNull()).select("r.*", "line_no")


def numbered_records(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(numbered_lines(spark, path))


def sampled_records(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """Every n-th line up to `limit`; only the lines kept are parsed."""
    return parse_lines(systematic(numbered_lines(spark, path), limit))


def systematic(numbered: DataFrame, limit: int, estimated_lines: int | None = None) -> DataFrame:
    """Every n-th line up to `limit` lines, spread over all lines.

    The step follows from the number of lines, which is counted unless an estimate is given, and is rounded up, so that
    the last lines are reached. The kept lines are 0, step, 2*step, ..., those below step*limit: a filter, with no sort.
    """
    lines = numbered.count() if estimated_lines is None else estimated_lines
    step = max(1, -(-lines // limit))
    return numbered.where((F.col("line_no") % step == 0) & (F.col("line_no") < step * limit))


def numbered_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Parquet files with their 0-based position over all files in path order."""
    rows = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    before = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_file")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    return rows.join(broadcast_checked(offsets, SPLITS), "_file").withColumn("line_no", F.col("_row") + F.col("_offset")).drop(
        "_file", "_row", "_offset"
    )
