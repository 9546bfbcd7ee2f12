"""Declared schemas of the source record and of the stored tables."""

from pyspark.sql import types as T

# processed_status life cycle (fixed values)
STATUSES = ("pending", "downloaded", "parsed", "embedded", "failed")

SOURCE_RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("categories", T.StringType()),
        T.StructField("doi", T.StringType()),
        T.StructField("license", T.StringType()),
        T.StructField("update_date", T.StringType()),
        T.StructField(
            "versions",
            T.ArrayType(
                T.StructType(
                    [T.StructField("version", T.StringType()), T.StructField("created", T.StringType())]
                )
            ),
        ),
        T.StructField("authors_parsed", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)

PAPERS = T.StructType(
    [
        T.StructField("arxiv_id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("primary_category", T.StringType()),
        T.StructField("published_date", T.DateType()),
        T.StructField("last_updated_date", T.DateType()),
        T.StructField("doi", T.StringType()),
        T.StructField("license", T.StringType()),
        T.StructField("processed_status", T.StringType()),
    ]
)

AUTHORS = T.StructType(
    [
        T.StructField("author_id", T.LongType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("original_string", T.StringType()),
    ]
)

PAPER_AUTHORS = T.StructType(
    [T.StructField("paper_id", T.StringType(), False), T.StructField("author_id", T.LongType(), False)]
)

CITATIONS = T.StructType(
    [
        T.StructField("source_arxiv_id", T.StringType(), False),
        T.StructField("target_arxiv_id", T.StringType(), False),
        T.StructField("context", T.StringType()),
    ]
)

# Token ids are 60-bit hashes, so the map key is a long.
VECTORS = T.StructType(
    [
        T.StructField("paper_id", T.LongType(), False),
        T.StructField("arxiv_id", T.StringType(), False),
        T.StructField("dense_vector", T.ArrayType(T.FloatType())),
        T.StructField("sparse_vector", T.MapType(T.LongType(), T.FloatType())),
        T.StructField("publication_year", T.IntegerType()),
        T.StructField("partition_key", T.LongType()),
    ]
)

QUERIES = T.StructType(
    [
        T.StructField("query_id", T.LongType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("alpha", T.DoubleType()),
        T.StructField("start_year", T.IntegerType()),
        T.StructField("end_year", T.IntegerType()),
        T.StructField("n_clusters", T.IntegerType()),
    ]
)
