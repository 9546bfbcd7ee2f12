"""Stored tables: creation, keyed upsert, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptstrata import schemas
from conceptstrata.functions.keys import hash60
from conceptstrata.operators.lookup import in_partitions, rows_with_keys
from conceptstrata.operators.ranking import latest_by_key
from conceptstrata.session import new_path
from conceptstrata.sources.versioned import VersionedTable, create_table, ordered_columns

OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"
BUCKETS_PROPERTY = "conceptstrata.buckets"


def _create(spark: SparkSession, name: str, columns: str, partition: str, location: str | None, buckets: int) -> None:
    where = f"LOCATION '{location}'" if location else ""
    part = f"PARTITIONED BY ({partition})" if partition else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {part} {where} "
        f"TBLPROPERTIES ('{BUCKETS_PROPERTY}'='{buckets}')"
    )


def create_papers(spark: SparkSession, name: str, location: str | None = None, buckets: int = 64) -> None:
    """Papers, partitioned by a hash bucket of the id.

    The bucket follows from the key, so an upsert rewrites only the buckets its rows fall in and a
    row never moves. Use enough buckets that one is a few GB.
    """
    _create(spark, name, schemas.PAPERS.toDDL() + ", id_bucket INT", "id_bucket", location, buckets)


def create_vectors(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Vectors, partitioned by publication year so that a year range prunes whole partitions."""
    fields = [f for f in schemas.VECTORS.fields if f.name != "publication_year"]
    columns = type(schemas.VECTORS)(fields).toDDL() + ", publication_year INT"
    _create(spark, name, columns, "publication_year", location, 0)


def create_plain(spark: SparkSession, name: str, schema, location: str | None = None) -> None:
    """Authors, paper_authors and citations."""
    _create(spark, name, schema.toDDL(), "", location, 0)


def attach(spark: SparkSession, name: str) -> None:
    """Find the partitions already lying at the table's location (a fresh catalog knows none)."""
    spark.catalog.recoverPartitions(name)


def read(spark: SparkSession, table: str) -> DataFrame:
    """The table as it is now, whichever session (a stream's, another job's) wrote it last."""
    spark.catalog.refreshTable(table)
    return spark.table(table)


def with_bucket(rows: DataFrame, table: str) -> DataFrame:
    spark = rows.sparkSession
    found = spark.sql(f"SHOW TBLPROPERTIES {table} ('{BUCKETS_PROPERTY}')").first()
    return rows.withColumn("id_bucket", (hash60(F.col("arxiv_id")) % int(found["value"])).cast("int"))


def upsert(table: str, rows: DataFrame, key: str, latest: str | None = None, rows_move: bool = False) -> None:
    """Insert or replace rows by key; only the partitions concerned are rewritten.

    `latest` names the column whose largest value wins where `rows` holds a key twice; among equal ones, and
    without it, the row with the largest values does, so that a repeated run picks the same. `rows_move`
    says that a key may change partition (another publication year): the partitions that now hold
    the keys are then found by a scan of the key column and rewritten as well. Running the same
    upsert again leaves the same table, so a failed run is simply repeated. One writer at a time, and a reader may
    see rows that moved in both partitions until the old one is dropped: `versioned` tables do not have this.
    """
    spark = rows.sparkSession
    target = read(spark, table)
    columns = target.columns
    partition = next(c.name for c in spark.catalog.listColumns(table) if c.isPartition)

    order = [latest] if latest else []
    rows = latest_by_key(rows, key, [F.desc_nulls_last(c) for c in [*order, *ordered_columns(target.schema)]]).select(*columns)
    # Read several times below; the written copy also pins down what is being merged.
    stage = new_path(spark, "upsert")
    rows.write.parquet(stage)
    staged = spark.read.schema(rows.schema).parquet(stage)
    ids = staged.select(key)

    def partitions(df: DataFrame) -> set:
        # One value per year or bucket.
        return {r[0] for r in df.select(partition).distinct().collect()}

    incoming = partitions(staged)
    if not incoming:
        return
    touched = set(incoming)
    if rows_move:
        touched |= partitions(target.select(key, partition).join(ids, key, "left_semi"))
    kept = target.where(F.col(partition).isin(*touched)).join(ids, key, "left_anti")
    emptied = touched - incoming
    if emptied:
        emptied -= partitions(kept.where(F.col(partition).isin(*emptied)))
    merged = (
        kept.select(*columns)
        .unionByName(staged)
        .hint("rebalance", partition)  # splits a partition that holds much of the rows over several tasks
        .sortWithinPartitions(partition, key)
    )
    # Dynamic overwrite writes beside the table first, so the table can be read meanwhile.
    mode = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, "dynamic")
    try:
        merged.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(OVERWRITE_MODE, mode)
    for value in sorted(emptied):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({partition}={int(value)})")


def materialise_once(df: DataFrame, table: str, path: str | None = None) -> DataFrame:
    """Write the table on first use, read it afterwards."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        writer = df.write.mode("ignore")
        (writer.option("path", path) if path else writer).saveAsTable(table)
    return spark.table(table)


def fetch_vectors(vectors: DataFrame, ids: DataFrame, *fields: str) -> DataFrame:
    """Chosen vector fields of the listed arxiv ids, found by their hashed key.

    Where the list also names publication years, only these partitions are read.
    """
    if "publication_year" in ids.columns:
        vectors = in_partitions(vectors, ids, "publication_year")
    wanted = ids.select(hash60(F.col("arxiv_id")).alias("paper_id"))
    return rows_with_keys(vectors.select("paper_id", "arxiv_id", *fields), wanted, "paper_id").select("arxiv_id", *fields)


def versioned_papers(spark: SparkSession, path: str, buckets: int = 64) -> VersionedTable:
    """Papers whose upserts write about the bytes of their rows."""
    return create_table(spark, path, schemas.PAPERS, "arxiv_id", buckets)


def versioned_vectors(spark: SparkSession, path: str, buckets: int = 64) -> VersionedTable:
    """Vectors in the order of their year within a bucket: a year range skips row groups, and a paper may change its year."""
    return create_table(spark, path, schemas.VECTORS, "paper_id", buckets, order=["publication_year", "paper_id"])
