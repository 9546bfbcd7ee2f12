"""Texts to dense and sparse vectors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptstrata.functions.keys import hash60
from conceptstrata.functions.text import words
from conceptstrata.operators.ranking import top_k
from conceptstrata.session import short_batches

SEPARATOR = "[SEP]"
DENSE_DIMS = 768
# Texts encoded at once by a Python worker: some 20 MB with everything in between, however many rows a batch has
SLICE_ROWS, SLICE_TOKENS = 256, 100_000
DENSE = T.StructField("dense_vector", T.ArrayType(T.FloatType()))
SPARSE = T.StructField("sparse_vector", T.MapType(T.LongType(), T.FloatType()))


def encoder_input(papers: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """Add `encoder_input`: title, separator, abstract; nulls count as ''."""
    title, abstract = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("title", "abstract"))
    return papers.withColumn("encoder_input", F.concat(title, F.lit(separator), abstract))


class TextModel(Protocol):
    """A model to plug into `encode_with`."""

    def load(self) -> None:
        """Called once per task, on the executor."""

    def encode(self, texts: pd.Series) -> tuple[np.ndarray, list[dict[int, float]]]:
        """Dense rows and sparse weights, in the order of the texts. Blank texts get an empty map."""


def encode_with(papers: DataFrame, model: TextModel) -> DataFrame:
    """Append the vectors of `encoder_input` computed by a plugged-in model, batch by batch."""
    schema = T.StructType([*papers.schema.fields, DENSE, SPARSE])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model.load()
        for batch in batches:
            dense, sparse = model.encode(batch["encoder_input"])
            lengths = np.linalg.norm(dense, axis=1, keepdims=True)
            unit = (dense / np.where(lengths > 0, lengths, 1.0)).astype("float32")
            yield batch.assign(dense_vector=list(unit), sparse_vector=sparse)

    return papers.mapInPandas(run, schema)


def hash_encode(df: DataFrame, text: Column, dims: int = DENSE_DIMS) -> DataFrame:
    """Built-in encoder without model weights, over the whole text.

    Sparse weights are log(1 + term frequency) by token id; the dense vector is their signed feature
    hash, L2-normalised. Term counts of a text only need that text, so nothing is shuffled: token ids go
    through Arrow once and both vectors come back.
    """
    schema = T.StructType([*df.schema.fields, DENSE, SPARSE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield _encoded(part, dims, schema.names)

    short_batches(df.sparkSession)
    return df.withColumn("_tokens", F.transform(words(text), hash60)).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, at most SLICE_ROWS at once and, as far as whole texts allow, SLICE_TOKENS tokens (the last column)."""
    offsets = batch.column(batch.num_columns - 1).offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        full = int(np.searchsorted(offsets, offsets[at] + SLICE_TOKENS, side="right")) - 1
        end = min(max(full, at + 1), at + SLICE_ROWS, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def _encoded(batch: pa.RecordBatch, dims: int, names: list[str]) -> pa.RecordBatch:
    """The columns of a batch with both vectors in place of the last one, the token ids."""
    tokens = batch.column(batch.num_columns - 1)
    texts = batch.num_rows
    token = tokens.flatten().to_numpy()
    doc = np.repeat(np.arange(texts), np.diff(tokens.offsets.to_numpy()))

    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])][: len(doc)])
    doc, token = doc[first], token[first]
    weight = np.log1p(np.diff(np.r_[first, len(order)]))

    sign = np.where(token // dims % 2 == 0, 1.0, -1.0)
    dense = np.bincount(doc * dims + token % dims, sign * weight, texts * dims).reshape(texts, dims)
    length = np.linalg.norm(dense, axis=1, keepdims=True)
    dense = (dense / np.where(length > 0, length, 1.0)).astype("float32")

    dense_offsets = pa.array(np.arange(0, texts * dims + 1, dims, dtype=np.int32))
    sparse_offsets = pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=texts))].astype(np.int32))
    columns = [batch.column(i) for i in range(batch.num_columns - 1)]
    columns.append(pa.ListArray.from_arrays(dense_offsets, pa.array(dense.ravel())))
    columns.append(pa.MapArray.from_arrays(sparse_offsets, pa.array(token), pa.array(weight.astype("float32"))))
    return pa.RecordBatch.from_arrays(columns, names=names)


def hash_encode_papers(papers: DataFrame, dims: int = DENSE_DIMS) -> DataFrame:
    """Built-in encoding of title and abstract."""
    return hash_encode(papers, F.concat_ws(" ", "title", "abstract"), dims)


def vocabulary(df: DataFrame, text: Column) -> DataFrame:
    """Token ids and their tokens."""
    tokens = df.select(F.explode(words(text)).alias("token")).distinct()
    return tokens.select(hash60(F.col("token")).alias("token_id"), "token")


def text_windows(df: DataFrame, key: str, text: Column, size: int = 512) -> DataFrame:
    """Texts cut into consecutive windows of `size` words, for models with a bounded input.

    Every word is in exactly one window; nothing is cut off. A text without words keeps one window.
    """
    last = F.greatest(F.ceil(F.size("_words") / F.lit(size)).cast("int") - 1, F.lit(0))
    cut = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("_words", i * size + 1, F.lit(size)), " ")
    )
    return df.select(key, words(text).alias("_words")).select(
        key, F.posexplode_outer(cut).alias("window_no", "window_text")
    )


def pool_windows(encoded: DataFrame, key: str) -> DataFrame:
    """One sparse vector per text from its windows: the largest weight of every token.

    A window without tokens keeps its text, as a row without a token, so the windows are read (and encoded) once.
    """
    best = (
        encoded.select(key, F.explode_outer("sparse_vector").alias("token_id", "weight"))
        .groupBy(key, "token_id")
        .agg(F.max("weight").alias("weight"))
    )
    entry = F.when(F.col("token_id").isNotNull(), F.struct("token_id", "weight"))
    return best.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("sparse_vector"))


def max_pool_logits(logits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token weights from model logits: max over positions of log(1 + relu(logit)) * mask, if not 0."""
    activation = F.log1p(F.greatest(F.col("logit"), F.lit(0.0))) * F.col("mask")
    return logits.groupBy(key, "token_id").agg(F.max(activation).alias("weight")).where(F.col("weight") > 0)


def drop_smallest(weights: Column, ratio: float) -> Column:
    """Map without its floor(n * ratio) smallest weights; ties go by token id."""
    if ratio <= 0:
        return weights
    entries = F.array_sort(
        F.transform(F.map_entries(weights), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key")))
    )
    dropped = F.floor(F.size(entries) * F.lit(ratio)).cast("int")
    kept = F.slice(entries, dropped + 1, F.greatest(F.size(entries) - dropped, F.lit(0)))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))


def postings(vectors: DataFrame, drop_ratio: float = 0.0, *carry: str) -> DataFrame:
    """One row per (token, paper): token_id, weight, arxiv_id and the columns in `carry`."""
    return vectors.select(
        "arxiv_id", *carry, F.explode(drop_smallest(F.col("sparse_vector"), drop_ratio)).alias("token_id", "weight")
    )


def token_totals(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Summed weight per group and token, at 9 places, so that the order of addition cannot change a ranking."""
    return weights.groupBy(*keys, "token_id").agg(F.round(F.sum(F.col("weight").cast("double")), 9).alias("weight"))


def top_tokens(totals: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The k heaviest tokens of every group; equal weights go by token id."""
    return top_k(totals, keys, [F.desc("weight"), F.col("token_id")], k)
