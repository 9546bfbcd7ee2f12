"""Names for clusters from the token weights of their members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptstrata.operators.encode import token_totals, top_tokens
from conceptstrata.operators.ranking import broadcast_checked
from conceptstrata.session import cut_lineage

LABEL_TOKENS = 5
# A token is a form of a query word if they share this many leading letters.
SHARED_PREFIX = 4


def cluster_labels(
    weights: DataFrame,
    vocabulary: DataFrame,
    keys: list[str] | None = None,
    stop: DataFrame | None = None,
) -> DataFrame:
    """Label per cluster: its five heaviest tokens, word pieces (with '#') left out after the cut.

    weights: keys + token_id, weight; vocabulary: token_id, token; stop: (query_id, token) pairs that
    may not name a cluster of that query, left out before the cut.
    """
    keys = keys or ["query_id", "cluster"]
    totals = token_totals(weights, keys)
    if stop is not None:
        vocabulary = cut_lineage(vocabulary, "vocabulary")  # read twice, made from all texts once
        totals = _without_forms(totals, vocabulary, stop)
    top = top_tokens(totals, keys, LABEL_TOKENS)
    named = vocabulary.join(broadcast_checked(top), "token_id").where(~F.col("token").contains("#"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "token")))
    label = named.groupBy(*keys).agg(F.array_join(ordered["token"], ", ").alias("label"))
    # A cluster left without tokens is called ''.
    return top.select(*keys).distinct().join(label, keys, "left").withColumn(
        "label", F.coalesce("label", F.lit(""))
    )


def _without_forms(totals: DataFrame, vocabulary: DataFrame, stop: DataFrame) -> DataFrame:
    """Drop summed tokens equal to a query word or sharing its first letters."""
    def stem(token):
        return F.substring(token, 1, SHARED_PREFIX)

    words = stop.select("query_id", F.col("token").alias("_word"), stem(F.col("token")).alias("_stem")).distinct()
    same = F.col("token") == F.col("_word")
    related = (F.length("token") >= SHARED_PREFIX) & (F.length("_word") >= SHARED_PREFIX)
    banned = (
        vocabulary.join(broadcast_checked(words), stem(F.col("token")) == F.col("_stem"))
        .where(same | related)
        .select("query_id", "token_id")
        .distinct()
    )
    return totals.join(broadcast_checked(banned), ["query_id", "token_id"], "left_anti")


def cluster_sizes(clusters: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return clusters.groupBy(*(keys or ["query_id", "cluster"])).agg(F.count("*").alias("n"))
