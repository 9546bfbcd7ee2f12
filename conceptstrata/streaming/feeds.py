"""Incremental ingest and encoding with Structured Streaming.

Each feed handles what is new and stops (availableNow). The checkpoint remembers which files are
done, and the sinks are keyed, so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from conceptstrata.operators.encode import hash_encode_papers
from conceptstrata.operators.lookup import rows_with_keys
from conceptstrata.operators.ranking import latest_by_key
from conceptstrata.operators.records import clean_records, missing_ids, pending, storable, with_vector_keys
from conceptstrata.schemas import SOURCE_RECORD
from conceptstrata.sources.tables import read, upsert, with_bucket
from conceptstrata.sources.versioned import VersionedTable, ordered_columns

Sink = str | VersionedTable  # a table of the catalog, or a versioned one, which an upsert does not rewrite


def ingest_feed(
    spark: SparkSession,
    source: str,
    table: Sink,
    checkpoint: str,
    files_per_batch: int = 1000,
    strict: bool = False,
) -> StreamingQuery:
    """New JSON-lines files in `source` to the papers table: clean, then insert or replace by id.

    Within a batch the record from the last file wins, and within a file the last one written.
    """
    lines = (
        spark.readStream.schema(SOURCE_RECORD)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(source)
        .withColumn("_file", F.col("_metadata.file_path"))
        .withColumn("_block", F.col("_metadata.file_block_start"))
    )

    def merge(batch: DataFrame, _batch_id: int) -> None:
        # Rows of one file split keep their order within a task.
        order = F.struct("_file", "_block", F.monotonically_increasing_id())
        papers = clean_records(batch.withColumn("line_no", order).where(F.col("id").isNotNull()), strict)
        if isinstance(table, VersionedTable):
            table.upsert(papers, latest="line_no")
        else:
            upsert(table, with_bucket(papers, table), "arxiv_id", latest="line_no")

    return _start(lines, merge, checkpoint)


def encode_feed(
    spark: SparkSession,
    source: str,
    table: Sink,
    checkpoint: str,
    encode: Callable[[DataFrame], DataFrame] = hash_encode_papers,
    files_per_batch: int = 100,
) -> StreamingQuery:
    """New Parquet files of papers in `source` to the vectors table: encode those pending and not stored yet.

    An id that comes again, in the same batch or in a later one, is not encoded again; of several new rows with one id
    the one with the largest values is taken.
    """
    papers = (
        spark.readStream.schema(spark.read.parquet(source).schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
    )

    def merge(batch: DataFrame, _batch_id: int) -> None:
        new = with_vector_keys(storable(pending(batch)))
        if isinstance(table, VersionedTable):
            new = table.missing(new)
        else:
            new = missing_ids(new, read(spark, table), "paper_id")
        values = [F.desc_nulls_last(c) for c in ordered_columns(new.schema)]
        vectors = encode(latest_by_key(new, "paper_id", values))
        if isinstance(table, VersionedTable):
            table.upsert(vectors, latest="publication_year")
        else:
            upsert(table, vectors, "paper_id", rows_move=True)

    return _start(papers, merge, checkpoint)


def _start(rows: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def mark_embedded(spark: SparkSession, papers_table: Sink, vectors_table: Sink) -> None:
    """Set the pending papers whose vectors are stored to `embedded`."""
    papers, vectors = (t.read() if isinstance(t, VersionedTable) else read(spark, t) for t in (papers_table, vectors_table))
    done = rows_with_keys(pending(papers), vectors, "arxiv_id").withColumn("processed_status", F.lit("embedded"))
    if isinstance(papers_table, VersionedTable):
        papers_table.upsert(done, latest="last_updated_date")
    else:
        upsert(papers_table, done, "arxiv_id")
