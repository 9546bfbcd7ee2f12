"""Concept analysis from query to pivotal papers, for a batch of queries at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptstrata.functions.keys import hash60
from conceptstrata.operators import eras as era_ops
from conceptstrata.operators import kmeans, pivotal, silhouette
from conceptstrata.operators.distances import INLINE_ROWS
from conceptstrata.operators.encode import hash_encode
from conceptstrata.operators.labels import cluster_labels
from conceptstrata.operators.lookup import in_partitions, joined_by_key
from conceptstrata.operators.ranking import broadcast_checked
from conceptstrata.operators.retrieve import FIRST_YEAR, LAST_YEAR, attach_metadata, dense_topk, hybrid_search
from conceptstrata.schemas import QUERIES
from conceptstrata.session import cut_lineage


@dataclass
class ConceptAnalysis:
    """What was asked and the result tables of one run; every table is keyed by query_id.

    `queries` are the rows given (text, years, alpha, cluster count asked for), `chosen_k` the cluster counts used.
    """

    queries: DataFrame
    limit: int
    max_eras: int
    pivotal_k: int
    measure: str
    chosen_k: DataFrame
    search_results: DataFrame
    concept_clusters: DataFrame
    concept_labels: DataFrame
    concept_eras: DataFrame
    pivotal_papers: DataFrame

    def nested(self) -> DataFrame:
        return pivotal.nested_pivotal(self.concept_eras, self.pivotal_papers)

    def evolution(self) -> DataFrame:
        return pivotal.evolution(self.concept_clusters, pivotal.KEYS)


def text_queries(
    spark: SparkSession,
    texts: list[str],
    alpha: float = 0.5,
    start_year: int = FIRST_YEAR,
    end_year: int = LAST_YEAR,
    n_clusters: int | None = None,
    encode: Callable[[DataFrame], DataFrame] = lambda asked: hash_encode(asked, F.col("text")),
) -> DataFrame:
    """Queries from typed concept texts, numbered from 1, encoded like the papers."""
    rows = [(i, text, alpha, start_year, end_year, n_clusters) for i, text in enumerate(texts, 1)]
    return encode(spark.createDataFrame(rows, QUERIES))


def analyze(
    queries: DataFrame,
    vectors: DataFrame,
    papers: DataFrame,
    vocabulary: DataFrame,
    postings: DataFrame | None = None,
    limit: int = 1000,
    max_eras: int = era_ops.MAX_ERAS,
    pivotal_k: int = pivotal.TOP_PAPERS,
    max_k: int = silhouette.MAX_K,
    norm: str = "bounded",
    measure: str = "exact",
) -> ConceptAnalysis:
    """Search, cluster, name, date and illustrate the sub-concepts of every query.

    queries: query_id, dense_vector, sparse_vector, alpha and optionally start_year, end_year,
    n_clusters (null or < 2 chooses by silhouette, by the `measure` of `cluster_concepts`). vectors: arxiv_id,
    publication_year, dense_vector, sparse_vector. Queries without hits simply have no rows.
    """
    # Intermediate results have at most `limit` rows per query and are used several times.
    hits = cut_lineage(hybrid_search(vectors, queries, limit, norm, postings=postings), "hits")
    results = attach_metadata(hits, papers)

    # The vectors of the hits are read once and serve clustering, silhouette and labels.
    members = cut_lineage(member_vectors(hits, vectors), "members")
    clusters = cut_lineage(cluster_concepts(members, queries, limit, max_k, measure), "clusters")
    labels = cut_lineage(name_concepts(members, clusters, vocabulary), "labels")
    placed = clusters.join(labels.withColumnRenamed("label", "cluster_label"), ["query_id", "cluster"], "left")
    concept_clusters = cut_lineage(
        results.join(placed.withColumnRenamed("point_id", "arxiv_id"), ["query_id", "arxiv_id"], "left"), "concepts"
    )

    named = concept_clusters.where(F.col("cluster_label").isNotNull())
    eras = cut_lineage(era_ops.find_eras(era_ops.yearly_counts(named), max_eras), "eras")
    return ConceptAnalysis(
        queries=queries,
        limit=limit,
        max_eras=max_eras,
        pivotal_k=pivotal_k,
        measure=measure,
        chosen_k=clusters.select("query_id", "k").distinct(),
        search_results=results,
        concept_clusters=concept_clusters,
        concept_labels=labels,
        concept_eras=eras,
        pivotal_papers=pivotal.pivotal_papers(named, eras, pivotal_k),
    )


def member_vectors(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """Hits with their vectors: only the years hit are read, and of these only rows that may be hits are joined."""
    wanted = hits.withColumnRenamed("year", "publication_year")
    years = in_partitions(vectors, wanted, "publication_year")
    listed = wanted.withColumnRenamed("publication_year", "_year")
    rows = joined_by_key(years.select("arxiv_id", "publication_year", "dense_vector", "sparse_vector"), listed, "arxiv_id")
    return rows.where(F.col("publication_year") == F.col("_year")).drop("_year")


def search_in_eras(vectors: DataFrame, queries: DataFrame, eras: DataFrame, limit: int) -> DataFrame:
    """A search of its own inside every era of a query: its best papers of the corpus at that time.

    eras: query_id, start, end and further columns, which are kept.
    """
    windows = eras.withColumn("_window", hash60(F.concat_ws(":", *eras.columns)))
    asked = windows.join(queries.drop("start_year", "end_year"), "query_id").select(
        F.col("_window").alias("query_id"),
        *[c for c in ("dense_vector", "sparse_vector", "alpha") if c in queries.columns],
        F.col("start").alias("start_year"),
        F.col("end").alias("end_year"),
    )
    found = (
        hybrid_search(vectors, asked, limit) if "sparse_vector" in asked.columns else dense_topk(vectors, asked, limit)
    )
    return found.withColumnRenamed("query_id", "_window").join(broadcast_checked(windows), "_window").drop("_window")


def cluster_concepts(
    members: DataFrame, queries: DataFrame, row_limit: int | None = None, max_k: int = silhouette.MAX_K, measure: str = "exact"
) -> DataFrame:
    """Cluster number per (query_id, point_id) under the given or the best-scoring k.

    members: query_id, arxiv_id, dense_vector. `row_limit` bounds the rows per query, if known;
    `measure` names the silhouette that chooses k ("exact", or the linear "squared").
    A query with fewer rows than clusters asked for has no rows here.
    """
    points = members.select("query_id", F.col("arxiv_id").alias("point_id"), F.col("dense_vector").alias("vector"))
    asked = (
        queries.select("query_id", F.col("n_clusters").cast("int").alias("n_clusters"))
        if "n_clusters" in queries.columns
        else queries.select("query_id", F.lit(None).cast("int").alias("n_clusters"))
    )
    candidates = silhouette.k_candidates(asked, max_k)
    fitted = cut_lineage(kmeans.fit(points, candidates, row_limit), "fits")
    chosen = choose_k(points, fitted, row_limit, measure)
    return fitted.join(broadcast_checked(chosen.select("query_id", "k")), ["query_id", "k"]).select(
        "query_id", "k", "point_id", "cluster"
    )


def choose_k(points: DataFrame, fitted: DataFrame, row_limit: int | None = None, measure: str = "exact") -> DataFrame:
    """One k per query: the one with the best silhouette by the measure, or the only one fitted."""
    if measure not in silhouette.MEASURES:
        raise ValueError(f"measure is one of {silhouette.MEASURES}")
    per_k = fitted.groupBy("query_id", "k").agg(F.first("silhouette").alias("silhouette"))
    several = per_k.groupBy("query_id").agg(F.count("*").alias("ks")).where(F.col("ks") > 1)
    if measure == "squared":
        asked = fitted.join(several, "query_id", "left_semi")
        alone = per_k.join(several, "query_id", "left_anti")
        per_k = alone.unionByName(silhouette.silhouette_large(points, asked).select("query_id", "k", "silhouette"))
    elif row_limit is None or row_limit > INLINE_ROWS:
        unscored = fitted.where(F.col("silhouette").isNull()).join(several, "query_id", "left_semi")
        per_k = per_k.unionByName(silhouette.silhouette(points, unscored).select("query_id", "k", "silhouette"))
    return silhouette.best_k(per_k).withColumn("measure", F.lit(measure))


def name_concepts(members: DataFrame, clusters: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Label per (query_id, cluster) from the sparse weights of its members."""
    weights = (
        members.select("query_id", "arxiv_id", "sparse_vector")
        .join(clusters.withColumnRenamed("point_id", "arxiv_id"), ["query_id", "arxiv_id"])
        .select("query_id", "cluster", F.explode("sparse_vector").alias("token_id", "weight"))
    )
    return cluster_labels(weights, vocabulary)
