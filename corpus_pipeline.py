"""A training corpus from `documents`: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptstrata.llm import decontaminate, language, line_runs, packing, simhash
from conceptstrata.llm.common import load
from conceptstrata.plans.registry import query
from conceptstrata.session import new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
LEAST_SHARE = 0.5  # of a document's words, in its main language


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mostly in one language that was learned; texts without letters and even mixtures go."""
    model = language.fit(docs)
    named = language.predict(docs.select("doc_id", "text", "lang", "source", "n_chars"), model)
    return named.where((F.col("lang_pred") != language.UND) & (F.col("score") >= LEAST_SHARE)).select(docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are deleted from the texts."""
    cleaned = line_runs.deduplicate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def with_row(docs: DataFrame) -> DataFrame:
    """Adds `row`, the identity of a row: id (nulls last), hashes of the text, other columns. Equal rows share it."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    hashes = [F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2")]
    return docs.withColumn("row", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *hashes, *others))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays: the one with the smallest id, and of these with the smallest hash.

    Ids decide nothing else: rows with a null id, or with an id that several share, stay if their texts differ.
    """
    rows = with_row(docs)
    found = simhash.near_duplicates(rows, key="row", shingle=3, radius=3)
    kept = found.select(F.col("component_id").alias("kept")).distinct()
    one_each = rows.join(kept, F.col("row").eqNullSafe(F.col("kept")), "left_semi")
    return one_each.dropDuplicates(["row"]).select(docs.columns)


def without_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, whatever their id."""
    rows = with_row(docs)
    found = decontaminate.contamination(rows, load(spark, sf_dir, "benchmark"), key="row")
    return decontaminate.clean(rows, found, key="row").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of the training corpus, a row per piece of a document."""
    return packing.pack(docs, "word_bpe_49k.json")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark_items),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None  # mixture inference, SimHash and packing have no SQL; tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


query("pipeline", ORACLE_SQL)(run)
