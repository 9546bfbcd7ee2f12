"""Cleaning of source records and the keys, shards and lookups derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptstrata.functions import keys, text
from conceptstrata.operators.lookup import rows_with_keys
from conceptstrata.schemas import STATUSES


def clean_records(records: DataFrame, strict: bool = False) -> DataFrame:
    """Source records to papers. Bad or missing dates become null, missing texts ''.

    `strict` also normalises whitespace and drops rows without abstract or publication date.
    """
    tidy = text.squeeze if strict else text.strip
    extra = [c for c in records.columns if c == "line_no"]
    papers = records.select(
        F.col("id").alias("arxiv_id"),
        tidy(F.col("title")).alias("title"),
        tidy(F.col("abstract")).alias("abstract"),
        text.first_token(F.col("categories")).alias("primary_category"),
        text.first_version_date(F.col("versions")).alias("published_date"),
        text.iso_date(F.col("update_date")).alias("last_updated_date"),
        "doi",
        "license",
        F.lit(STATUSES[0]).alias("processed_status"),
        *extra,
    )
    if strict:
        papers = papers.where((F.length("abstract") > 0) & F.col("published_date").isNotNull())
    return papers


def author_links(records: DataFrame) -> DataFrame:
    """One row per (paper, author) with display name and the parts as written."""
    return (
        records.select(F.col("id").alias("paper_id"), F.explode("authors_parsed").alias("parts"))
        .withColumn("name", text.author_name(F.col("parts")))
        .where(F.col("name").isNotNull())
        .select(
            "paper_id",
            keys.hash60(F.col("name")).alias("author_id"),
            "name",
            F.concat_ws(", ", F.filter("parts", lambda p: p.isNotNull() & (p != ""))).alias("original_string"),
        )
    )


def authors(records: DataFrame) -> DataFrame:
    """Distinct authors; the smallest written form stands for a name."""
    return author_links(records).groupBy("author_id").agg(
        F.min("name").alias("name"), F.min("original_string").alias("original_string")
    )


def paper_authors(records: DataFrame) -> DataFrame:
    return author_links(records).select("paper_id", "author_id").distinct()


def with_vector_keys(papers: DataFrame) -> DataFrame:
    """Add paper_id, publication_year and partition_key."""
    year = F.year("published_date")
    return papers.withColumns(
        {
            "paper_id": keys.hash60(F.col("arxiv_id")),
            "publication_year": year,
            "partition_key": keys.partition_key(year, F.col("primary_category")),
        }
    )


def storable(papers: DataFrame) -> DataFrame:
    """Rows that can enter the vector table; the others are in `rejected`."""
    return papers.where(F.col("published_date").isNotNull() & F.col("arxiv_id").isNotNull())


def rejected(papers: DataFrame) -> DataFrame:
    """Rows the vector table cannot hold, with the reason."""
    return papers.where(F.col("published_date").isNull() | F.col("arxiv_id").isNull()).withColumn(
        "reason", F.when(F.col("arxiv_id").isNull(), "no id").otherwise("no publication date")
    )


def missing_ids(candidates: DataFrame, stored: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Candidates whose key is not stored yet."""
    return candidates.join(stored.select(key), key, "left_anti")


def with_ids(papers: DataFrame, ids: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Rows whose key is in the given list; the papers stay where they lie."""
    return rows_with_keys(papers, ids, key)


def pending(papers: DataFrame, num_shards: int = 1, shard_id: int = 0) -> DataFrame:
    """Papers still to encode, optionally one shard of them."""
    waiting = papers.where(F.col("processed_status") == STATUSES[0])
    if num_shards == 1:
        return waiting
    return waiting.where(keys.in_shard(F.col("arxiv_id"), num_shards, shard_id))


def invalid_status(papers: DataFrame) -> DataFrame:
    """Rows whose status is outside the life cycle."""
    return papers.where(F.col("processed_status").isNull() | ~F.col("processed_status").isin(*STATUSES))
