"""The given tables seen as papers, source records and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptstrata.operators.encode import hash_encode, hash_encode_papers
from conceptstrata.session import new_path, spread

DIMS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paper_date(key: Column) -> Column:
    """A date between 1990 and 2025 from a numeric key."""
    return F.date_add(F.lit("1990-01-01").cast("date"), (key * 37 % 13000).cast("int"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as papers: the first line is the title, the whole text the abstract."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("string").alias("arxiv_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
        F.col("source").alias("primary_category"),
        paper_date(F.col("doc_id")).alias("published_date"),
        paper_date(F.col("doc_id")).alias("last_updated_date"),
        F.lit(None).cast("string").alias("doi"),
        F.col("lang").alias("license"),
        F.lit("pending").alias("processed_status"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source records, with every kind of damage the cleaner has to handle."""
    documents = spread(table(spark, sf_dir, "documents"))
    key, date = F.col("doc_id"), paper_date(F.col("doc_id"))
    stamp = F.concat(F.date_format(date, "EEE, d MMM yyyy"), F.lit(" 19:18:42 GMT"))
    v1 = F.struct(F.lit("v1").alias("version"), F.when(key % 7 == 3, "not a date").otherwise(stamp).alias("created"))
    v2 = F.struct(F.lit("v2").alias("version"), F.lit("Mon, 2 Apr 2007 19:18:42 GMT").alias("created"))
    return documents.select(
        key.cast("string").alias("id"),
        F.when(key % 11 != 5, F.concat(F.lit("\t "), F.substring_index("text", "\n", 1), F.lit(" \n"))).alias("title"),
        F.when(key % 13 != 6, F.concat(F.lit("\n  "), F.col("text"), F.lit("\r\n"))).alias("abstract"),
        F.when(key % 17 != 8, F.concat_ws(" ", "source", "lang")).alias("categories"),
        F.lit(None).cast("string").alias("doi"),
        F.col("lang").alias("license"),
        F.when(key % 5 == 2, F.concat(date.cast("string"), F.lit(" 10:00")))
        .when(key % 5 == 3, F.lit("2007-02-30"))
        .otherwise(F.date_format(date, "yyyy-M-d"))
        .alias("update_date"),
        F.when(key % 19 == 4, F.array(v2)).when(key % 2 == 0, F.array(v2, v1)).otherwise(F.array(v1, v2)).alias("versions"),
        F.array(
            F.array(F.col("source"), F.col("lang"), F.lit("")),
            F.array(F.lit(""), F.col("source"), F.lit("")),
            F.array(F.lit(""), F.lit("")),
        ).alias("authors_parsed"),
    )


_STORED: dict[tuple, str] = {}


def stored_vectors(spark: SparkSession, sf_dir: str, dims: int = DIMS) -> DataFrame:
    """The vectors table of the documents: encoded once per application, read by column afterwards."""
    key = (spark.sparkContext.applicationId, sf_dir, dims)
    if key not in _STORED:
        path = new_path(spark, "vectors")
        encoded_papers(spark, sf_dir, dims).select(
            "arxiv_id", "dense_vector", "sparse_vector", "publication_year"
        ).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def encoded_papers(spark: SparkSession, sf_dir: str, dims: int = DIMS) -> DataFrame:
    """documents as papers with built-in dense and sparse vectors."""
    return hash_encode_papers(papers(spark, sf_dir), dims).withColumn("publication_year", F.year("published_date"))


def text_queries(spark: SparkSession, sf_dir: str, dims: int = DIMS, alpha: float | None = 0.5) -> DataFrame:
    """Every benchmark text as a query."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return hash_encode(asked, F.col("text"), dims).withColumn("alpha", F.lit(alpha).cast("double"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as paper vectors with a publication year and the given label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("arxiv_id"),
        F.year(paper_date(F.col("vec_id"))).alias("publication_year"),
        F.col("embedding").alias("dense_vector"),
        F.col("label").alias("cluster"),
    )
