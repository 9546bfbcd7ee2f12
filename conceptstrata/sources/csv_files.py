"""CSV in and out, with vectors and weight maps as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptstrata.functions.text import parse_vector, parse_weights


# A file whose values may hold line ends is read by one task: rows that one may have, some 40 MB of embedded papers
FILE_ROWS = 5_000


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("maxRecordsPerFile", FILE_ROWS).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_embedded_csv(df: DataFrame, path: str) -> None:
    """Embedded papers with `[x y ...]` vectors and `{token: weight, ...}` maps."""
    entries = F.transform(
        F.map_entries("sparse_vector"),
        lambda e: F.concat_ws(": ", e["key"].cast("string"), e["value"].cast("string")),
    )
    write_csv(
        df.withColumns(
            {
                "dense_vector": F.concat(
                    F.lit("["), F.concat_ws(" ", F.col("dense_vector").cast("array<string>")), F.lit("]")
                ),
                "sparse_vector": F.concat(F.lit("{"), F.concat_ws(", ", entries), F.lit("}")),
            }
        ),
        path,
    )


def read_embedded_csv(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """Embedded papers back from CSV; `columns` describes the file with vectors and maps as strings."""
    raw = (
        spark.read.schema(columns)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    return raw.withColumns(
        {
            "dense_vector": parse_vector(F.col("dense_vector")),
            "sparse_vector": parse_weights(F.col("sparse_vector")),
        }
    )
