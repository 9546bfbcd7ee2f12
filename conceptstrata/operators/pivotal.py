"""Leading papers per era and the evolution tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptstrata.operators.eras import KEYS
from conceptstrata.operators.ranking import broadcast_checked, top_k

TOP_PAPERS = 3


def pivotal_papers(
    clusters: DataFrame, eras: DataFrame, k: int = TOP_PAPERS, keys: Sequence[str] = KEYS, time: str = "year"
) -> DataFrame:
    """The k best-scored papers of every (label, era).

    The eras are unrolled to (label, year), so a paper finds its era by an equality and the papers of
    a frequent label are spread by year; the small era side is broadcast once its size is known.
    """
    by_year = eras.select(
        *keys, "era_no", "start", "end", F.explode(F.sequence("start", "end")).alias(time)
    ).withColumn("period", F.concat_ws("-", "start", "end"))
    members = clusters.join(broadcast_checked(by_year), [*keys, time])
    ranked = top_k(members, [*keys, "era_no"], [F.desc("score"), F.col("arxiv_id")], k, rank="rank_in_era")
    carried = [c for c in ("title",) if c in clusters.columns]
    return ranked.select(*keys, "era_no", "period", "rank_in_era", *carried, time, "score", "arxiv_id")


def nested_pivotal(eras: DataFrame, papers: DataFrame, keys: Sequence[str] = KEYS, time: str = "year") -> DataFrame:
    """One row per label: its eras in order, each with period, mean activity and ranked papers.

    An era without papers keeps its place with an empty list.
    """
    lists = papers.groupBy(*keys, "era_no").agg(
        F.array_sort(F.collect_list(F.struct("rank_in_era", "title", time, "score", "arxiv_id"))).alias("papers")
    )
    nothing = F.array().cast(lists.schema["papers"].dataType)
    full = eras.join(lists, [*keys, "era_no"], "left").withColumn("papers", F.coalesce("papers", nothing))
    era = F.struct(
        "era_no", "start", "end", "avg_count", F.concat_ws("-", "start", "end").alias("period"), "papers"
    )
    return full.groupBy(*keys).agg(F.array_sort(F.collect_list(era)).alias("eras"))


def evolution(clusters: DataFrame, keys: Sequence[str] = ("cluster_label",), time: str = "year") -> DataFrame:
    """Papers per year and label, long form."""
    return clusters.groupBy(time, *keys).agg(F.count("*").alias("n"))


MATRIX_LABELS = 2_000


def evolution_matrix(clusters: DataFrame, label: str = "cluster_label", time: str = "year") -> DataFrame:
    """Papers per year, one column per label found, 0 where there are none.

    A matrix has a column per label; with more than MATRIX_LABELS of them use `evolution`, the long form.
    """
    found = clusters.select(label).where(F.col(label).isNotNull()).distinct().limit(MATRIX_LABELS + 1).collect()
    if len(found) > MATRIX_LABELS:
        raise ValueError(f"more than {MATRIX_LABELS} labels: no matrix")
    return clusters.groupBy(time).pivot(label, sorted(r[0] for r in found)).count().na.fill(0)


def concept_names(clusters: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return clusters.select(*keys).distinct()


def merged_labels(clusters: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Labels shared by several clusters count as one concept; the smallest cluster number stands for it."""
    return clusters.groupBy(*keys).agg(
        F.min("cluster").alias("cluster"), F.countDistinct("cluster").alias("clusters_merged")
    )
