"""Registered queries, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from conceptstrata.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return build(spark, sf_dir)

        QUERIES[name] = shipped
        if sql is not None:
            SQL[name] = sql.strip()
        return build

    return register


# Fragments of the reference SQL -------------------------------------------------------------

DATE = "(DATE '1990-01-01' + CAST(({key} * 37) % 13000 AS INTEGER))"
HASH = "('0x' || substr(md5({text}), 1, 15))::BIGINT"

PAPERS = f"""papers AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS arxiv_id, split_part(text, chr(10), 1) AS title, text AS abstract,
         source AS primary_category, lang, {DATE.format(key='doc_id')} AS published_date
  FROM documents)"""

VECTORS = f"""vectors AS (
  SELECT vec_id, CAST(vec_id AS VARCHAR) AS arxiv_id, year({DATE.format(key='vec_id')}) AS year,
         embedding::DOUBLE[] AS v, label AS cluster
  FROM embeddings)"""

WORDS = r"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"

# Term weights of papers and of benchmark texts, and their signed feature hashes.
ENCODED = f"""{PAPERS},
tf AS (
  SELECT arxiv_id, published_date, token, {HASH.format(text='token')} AS token_id, ln(1 + count(*)) AS w
  FROM (SELECT arxiv_id, published_date, unnest({WORDS.format(text="title || ' ' || abstract")}) AS token FROM papers)
  GROUP BY ALL),
qtf AS (
  SELECT query_id, token, {HASH.format(text='token')} AS token_id, ln(1 + count(*)) AS w
  FROM (SELECT item_id AS query_id, unnest({WORDS.format(text='text')}) AS token FROM benchmark)
  GROUP BY ALL)"""


def hashed(source: str, key: str, dims: int) -> str:
    """Unit feature-hash vectors of a term table, one row per non-zero dimension."""
    return f"""
  SELECT {key}, dim, (s / sqrt(sum(s * s) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS x
  FROM (SELECT {key}, token_id % {dims} AS dim,
               sum(CASE WHEN (token_id // {dims}) % 2 = 0 THEN w ELSE -w END) AS s
        FROM {source} GROUP BY ALL)"""
