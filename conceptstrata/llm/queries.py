"""Registered queries of the operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptstrata.llm import (
    conversation_repair,
    decontaminate,
    divergence,
    html_text,
    imatch,
    language,
    line_runs,
    oracles,
    packing,
    passages,
    pseudonyms,
    sharding,
    simhash,
    token_files,
)
from conceptstrata.llm.common import load
from conceptstrata.plans.registry import query
from conceptstrata.session import new_path

PSEUDONYM_KEY = "key of the registered query"  # a caller keeps a key of their own


@query("op1_main_text")
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = passages.removals(load(spark, sf_dir, "documents"))
    return named.withColumnRenamed("class_key", "class_doc_id")


@query("op3_benchmark_decontamination")
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op4_pseudonyms")
def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymize(docs, key=PSEUDONYM_KEY)


@query("op5_simhash_near_duplicates")
def op5_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=3, radius=3)


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), "word_bpe_49k.json")


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.deduplicate(load(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write(load(spark, sf_dir, "documents"), path, "byte_bpe_50k.json")
    return token_files.index(spark, path)


@query("op9_document_fingerprints")
def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(load(spark, sf_dir, "documents"))


@query("op10_language_mixture")
def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = language.fit(docs.where(~held_out))
    named = language.predict(docs.select("doc_id", "text"), model)
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "mixture")


@query("op11_histogram_sort_shards", oracles.SHARDS)
def op11_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(load(spark, sf_dir, "documents"), shards=16)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return placed.select("doc_id", "size", crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def damaged(rows: DataFrame) -> DataFrame:
    """The conversations of the contract: some rows dropped, emptied, cut, repeated or given to the user."""
    blank = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    kind = F.col("kind")
    return rows.withColumn("kind", F.crc32(name.cast("binary")) % 20).where("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )


@query("op12_conversation_repair", oracles.REPAIR)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.report(conversation_repair.repair(damaged(rows)))
    every = rows.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    sha = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), sha)


@query("op13_source_divergence", oracles.DIVERGENCE)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents"))
