"""Papers from an existing PostgreSQL table over JDBC (needs the driver jar on the class path)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from conceptstrata.schemas import PAPERS


def shard_predicates(key: str, shards: int) -> list[str]:
    """Disjoint and complete row filters, one per parallel connection."""
    return [f"ABS(CAST(hashtext({key}) AS bigint)) % {shards} = {shard}" for shard in range(shards)]


def read_papers(
    spark: SparkSession, url: str, properties: dict[str, str], table: str = "papers", shards: int = 32
) -> DataFrame:
    """The papers table, read by `shards` tasks side by side; filters and columns reach the database."""
    rows = spark.read.jdbc(url, table, predicates=shard_predicates("arxiv_id", shards), properties=properties)
    return rows.select(*PAPERS.fieldNames())
