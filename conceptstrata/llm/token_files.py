"""Token-ID files: whole texts as Parquet list columns, in key order, readable by row and by column.

Every text is encoded, closed with an end id and written with version-2 pages: the ids are delta-encoded
lists, the small columns stand apart, so counts and keys are read without touching a token. Files hold
disjoint, ascending key ranges, so a filter on the key prunes files, row groups and, by the page indexes
that the writer adds, pages. Row group and page sizes are parameters.

A null text is an empty one. Repeated keys keep their rows, next to each other. A null key sorts first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptstrata.llm.common import short_batches
from conceptstrata.llm.tokens import encoder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10


def encode(docs: DataFrame, tokenizer: str, key: str, text: str, end_id: int, *others: str) -> DataFrame:
    """(key, other columns, n_tokens, ids) per row, in the order of the input's partitions."""
    schema = docs.select(key, *others).schema.add("n_tokens", T.LongType()).add("ids", T.ArrayType(T.IntegerType()))
    last = 1 + len(others)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer, spaced=True).encode_all
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # short batches out: a row can hold many ids
                rows = batch.slice(at, 256)
                packed = [ids + end for ids in encode_all(rows.column(last).to_pylist())]
                sizes = np.array([len(p) // 4 for p in packed], np.int64)
                cuts = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                ids = pa.ListArray.from_arrays(cuts, pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([*rows.columns[:last], pa.array(sizes), ids], schema.names)

    return docs.select(key, *others, text).mapInArrow(run, schema)


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 2,
    files: int | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Write the token files of a table below `path`, one folder per ascending key range."""
    spark = docs.sparkSession
    short_batches(spark)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds that are values, not partition numbers: a task that runs again deals rows alike.
    probs = [i / files for i in range(1, files)]
    bounds = sorted(set(docs.agg(F.percentile_approx(key, probs, 10_000)).first()[0] or [])) if probs else []

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:  # a binary search, as there may be many bounds
        return pd.Series(np.searchsorted(np.array(bounds), keys.to_numpy(), side="right").astype(np.int32))

    part = F.when(F.col(key).isNull(), 0).otherwise(place(F.coalesce(key, F.lit(bounds[0])))) if bounds else F.lit(0)
    ranged = docs.select(key, text).withColumn("part", part)
    sorted_rows = ranged.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", key, text)
    (
        encode(sorted_rows, tokenizer, key, text, end_id, "part")
        .write.option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("compression", "snappy")  # delta packing leaves little to compress
        .partitionBy("part")
        .parquet(path)
    )


def read(spark: SparkSession, path: str, key: str = "doc_id", key_type: str = "bigint") -> DataFrame:
    """(key, n_tokens, ids, part); the schema is named, as an empty table has no files."""
    return spark.read.schema(f"`{key}` {key_type}, n_tokens bigint, ids array<int>, part int").parquet(path)


def index(spark: SparkSession, path: str, key: str = "doc_id", key_type: str = "bigint") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) from the files: start counts the ids of all documents before.

    The totals of the key ranges, one row per file, are summed first; within a range rows are summed by key.
    """
    stored = read(spark, path, key, key_type)
    schema = stored.select(key, "part", "n_tokens").schema.add("ids_crc32", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            cuts = lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], schema.names)

    sums = stored.select(key, "part", "n_tokens", "ids").mapInArrow(run, schema)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("part").orderBy(key, "n_tokens", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    return sums.join(offsets, "part").select(
        key, (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", "ids_crc32"
    )
