"""Queries over clusters, eras, leading papers, drift and timings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptstrata.functions.text import words
from conceptstrata.operators import drift, encode, eras, evaluate, kmeans, labels, pivotal, retrieve, silhouette
from conceptstrata.plans import adapters, analysis
from conceptstrata.plans.registry import ENCODED, VECTORS, query
from conceptstrata.session import cut_lineage, spread

# Clusters ------------------------------------------------------------------------------------

_VDIMS = f"""{VECTORS},
dims AS (SELECT arxiv_id, year, cluster, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM vectors)"""


def _points(spark: SparkSession, sf_dir: str, per_label: bool = False) -> DataFrame:
    """All embeddings as one set to cluster, or one set per label."""
    rows = adapters.vectors(spark, sf_dir)
    return rows.select(
        (F.col("cluster").cast("bigint") if per_label else F.lit(0).cast("bigint")).alias("query_id"),
        F.col("arxiv_id").alias("point_id"),
        F.col("dense_vector").alias("vector"),
        "cluster",
    )


@query("lloyd_step", f"""
WITH {_VDIMS},
start AS (SELECT cluster, dim, avg(x) AS x FROM dims GROUP BY ALL),
distances AS (SELECT d.arxiv_id, s.cluster, sum((d.x - s.x) * (d.x - s.x)) AS dist
  FROM dims d JOIN start s USING (dim) GROUP BY ALL),
nearest AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY dist, cluster) AS r FROM distances) WHERE r = 1),
inertia AS (SELECT sum(dist) AS inertia FROM nearest)
SELECT n.cluster, d.dim - 1 AS dim, count(*) AS n, round(avg(d.x), 6) AS centre,
  round((SELECT inertia FROM inertia), 6) AS inertia
FROM nearest n JOIN dims d ON d.arxiv_id = n.arxiv_id GROUP BY n.cluster, d.dim
""")
def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assignment and update pass, starting from the means of the given labels."""
    points = _points(spark, sf_dir)
    start = drift.centroids(points, ["cluster"], "vector").select(
        F.lit(0).alias("query_id"), F.lit(10).alias("k"), F.lit(0).alias("restart"), "cluster", F.col("centroid").alias("centre")
    )
    totals = kmeans.lloyd_totals(points, kmeans.models_of(start.toPandas()))  # ten centres
    inertia = totals.agg(F.sum("inertia").alias("inertia"))
    return totals.where(F.col("n") > 0).select(
        "cluster", "n", F.posexplode("vector_sum").alias("dim", "total"), F.round(inertia.scalar(), 6).alias("inertia")
    ).select(
        "cluster", F.col("dim").cast("bigint").alias("dim"), "n", F.round(F.col("total") / F.col("n"), 6).alias("centre"), "inertia"
    )


def _pass_sql(number: int) -> str:
    """Assignment to the centres of a pass, and the centres of the next: the means, or the old centre of an empty cluster."""
    return f"""
near{number} AS (
  SELECT arxiv_id, arg_min(cluster, (dist, cluster)) AS cluster, min(dist) AS dist FROM (
    SELECT d.arxiv_id, s.cluster, sum((d.x - s.x) * (d.x - s.x)) AS dist FROM dims d JOIN centre{number} s USING (dim) GROUP BY ALL)
  GROUP BY arxiv_id),
centre{number + 1} AS (
  SELECT c.cluster, c.dim, coalesce(m.x, c.x) AS x FROM centre{number} c LEFT JOIN (
    SELECT n.cluster, d.dim, avg(d.x) AS x FROM near{number} n JOIN dims d ON d.arxiv_id = n.arxiv_id GROUP BY ALL) m USING (cluster, dim))"""


_STARTS = """centre0 AS (
  SELECT first.cluster, d.dim, d.x FROM dims d JOIN (
    SELECT arxiv_id, row_number() OVER (ORDER BY arxiv_id) - 1 AS cluster FROM vectors ORDER BY arxiv_id LIMIT 4) first USING (arxiv_id))"""


@query("kmeans_from_starts", f"""
WITH {_VDIMS}, {_STARTS}, {",".join(_pass_sql(n) for n in range(4))}
SELECT arxiv_id, cluster::INTEGER AS cluster, round((SELECT sum(dist) FROM near3), 4) AS inertia FROM near3
""")
def kmeans_from_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes over all embeddings from four of them, then the labels."""
    points = _points(spark, sf_dir)
    first = points.select("point_id", "vector").orderBy("point_id").limit(4).collect()  # the four starts
    starts = {(0, 4): np.array([[r.vector for r in first]], dtype=np.float64)}
    fitted = kmeans.fit_distributed(points, {0: [4]}, max_iterations=3, starts=starts)
    return fitted.select(F.col("point_id").alias("arxiv_id"), "cluster", F.round("inertia", 4).alias("inertia"))


_KS = (2, 3, 5, 10)


@query("best_k_of_labels", f"""
WITH {VECTORS},
ks AS (SELECT unnest({list(_KS)}) AS k),
sums AS (SELECT k, a.arxiv_id, a.cluster % k AS own, b.cluster % k AS other, sum(list_distance(a.v, b.v)) AS dist, count(*) AS n
  FROM ks, vectors a JOIN vectors b ON a.arxiv_id <> b.arxiv_id GROUP BY ALL),
parts AS (SELECT k, arxiv_id, max(CASE WHEN own = other THEN dist / n END) AS a,
  min(CASE WHEN own <> other THEN dist / n END) AS b FROM sums GROUP BY ALL),
scores AS (SELECT k, round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
  FROM parts GROUP BY k)
SELECT 0::BIGINT AS query_id, k::INTEGER AS k, silhouette, silhouette = max(silhouette) OVER () AS best FROM scores
""")
def best_k_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouettes of four labellings of the embeddings, made from the given labels, and which of them is chosen."""
    points = _points(spark, sf_dir)
    given = points.select("query_id", "point_id", "cluster", F.explode(F.array(*map(F.lit, _KS))).alias("k"))
    given = given.withColumn("cluster", (F.col("cluster") % F.col("k")).cast("int"))
    scores = cut_lineage(silhouette.silhouette(points, given).withColumn("silhouette", F.round("silhouette", 6)), "scores")
    chosen = silhouette.best_k(scores).select("query_id", F.col("k").alias("_k"))
    return scores.join(chosen, "query_id").select("query_id", "k", "silhouette", (F.col("k") == F.col("_k")).alias("best"))


@query("silhouette_exact", f"""
WITH {VECTORS},
sums AS (SELECT a.arxiv_id, a.cluster AS own, b.cluster AS other, sum(list_distance(a.v, b.v)) AS dist, count(*) AS n
  FROM vectors a JOIN vectors b ON a.arxiv_id <> b.arxiv_id GROUP BY ALL),
parts AS (SELECT arxiv_id, own, max(CASE WHEN own = other THEN dist / n END) AS a,
  min(CASE WHEN own <> other THEN dist / n END) AS b FROM sums GROUP BY ALL)
SELECT arxiv_id, own AS cluster,
  round(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 4) AS silhouette FROM parts
""")
def silhouette_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    given = points.select("query_id", F.lit(10).alias("k"), "point_id", "cluster")
    return silhouette.point_silhouettes(points, given).select(
        F.col("point_id").alias("arxiv_id"), "cluster", F.round("silhouette", 4).alias("silhouette")
    )


@query("kmeans_fit")
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as one set, every k from 2 to 8, fitted over the whole cluster."""
    points = _points(spark, sf_dir)
    return kmeans.fit_distributed(points, {0: list(range(2, 9))}).groupBy("k", "cluster").agg(
        F.count("*").alias("n"), F.round(F.first("inertia"), 6).alias("inertia")
    )


@query("auto_k")
def auto_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best cluster count for the embeddings of every label."""
    points = _points(spark, sf_dir, per_label=True)
    sets = points.select("query_id").distinct().withColumn("n_clusters", F.lit(None).cast("int"))
    fitted = cut_lineage(kmeans.fit(points, silhouette.k_candidates(sets)), "fits")
    return analysis.choose_k(points, fitted).select("query_id", "k", F.round("silhouette", 4).alias("silhouette"))


@query("coarse_to_fine")
def coarse_to_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.coarse_to_fine(_points(spark, sf_dir).select("point_id", "vector"), 4, 3, dims=16)


_TOKEN_CLUSTERS = f"""{ENCODED},
vocab AS (SELECT DISTINCT token_id, CASE WHEN token_id % 5 = 0 THEN '##' || token ELSE token END AS token FROM tf),
placed AS (SELECT arxiv_id, CAST(substr(primary_category, 4) AS INTEGER) AS cluster FROM papers),
weights AS (SELECT cluster, token_id, w::FLOAT::DOUBLE AS w FROM tf JOIN placed USING (arxiv_id))"""


def _label_sql(weights: str) -> str:
    return f"""
top AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY w DESC, token_id) AS r
  FROM (SELECT cluster, token_id, round(sum(w), 9) AS w FROM {weights} GROUP BY ALL)) WHERE r <= 5)
SELECT cluster, coalesce(string_agg(token, ', ' ORDER BY r) FILTER (WHERE NOT contains(token, '#')), '') AS label
FROM top JOIN vocab USING (token_id) GROUP BY cluster"""


def _token_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Token weights of the documents clustered by source, and a vocabulary with some word pieces."""
    encoded = adapters.encoded_papers(spark, sf_dir, 16)
    weights = encode.postings(encoded, 0.0, "primary_category").select(
        F.lit(0).cast("bigint").alias("query_id"),
        F.substring("primary_category", 4, 9).cast("int").alias("cluster"),
        "token_id",
        "weight",
    )
    vocabulary = encode.vocabulary(adapters.papers(spark, sf_dir), F.concat_ws(" ", "title", "abstract"))
    pieces = F.when(F.col("token_id") % 5 == 0, F.concat(F.lit("##"), F.col("token"))).otherwise(F.col("token"))
    return weights, vocabulary.withColumn("token", pieces)


@query("cluster_labels", f"WITH {_TOKEN_CLUSTERS}, {_label_sql('weights')}")
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, vocabulary = _token_clusters(spark, sf_dir)
    return labels.cluster_labels(weights, vocabulary).select("cluster", "label")


@query("cluster_labels_without_query_words", f"""
WITH {_TOKEN_CLUSTERS},
stop AS (SELECT DISTINCT token AS word FROM qtf),
banned AS (SELECT DISTINCT token_id FROM vocab JOIN stop ON substr(vocab.token, 1, 4) = substr(word, 1, 4)
  WHERE vocab.token = word OR (length(vocab.token) >= 4 AND length(word) >= 4)),
free AS (SELECT * FROM weights WHERE token_id NOT IN (SELECT token_id FROM banned)),
{_label_sql('free')}
""")
def cluster_labels_without_query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may not repeat the words of the benchmark texts nor forms of them."""
    weights, vocabulary = _token_clusters(spark, sf_dir)
    stop = adapters.table(spark, sf_dir, "benchmark").select(
        F.lit(0).cast("bigint").alias("query_id"), F.explode(words(F.col("text"))).alias("token")
    )
    return labels.cluster_labels(weights, vocabulary, stop=stop).select("cluster", "label")


@query("cluster_sizes", "SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.cluster_sizes(adapters.vectors(spark, sf_dir), ["cluster"])


# Eras: sales of a brand per month stand for papers of a concept per year -----------------------------

_SALES = """sales AS (
  SELECT p_brand AS k, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS t,
         CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS arxiv_id,
         p_name AS title, l_extendedprice AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey),
counts AS (SELECT k, t, count(*) AS n FROM sales GROUP BY ALL)"""


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = (adapters.table(spark, sf_dir, name) for name in ("lineitem", "part"))
    return spread(lines).join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("cluster_label"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("month"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("arxiv_id"),
        F.col("p_name").alias("title"),
        F.col("l_extendedprice").alias("score"),
    )


_BRAND = ["cluster_label"]


def era_sql(max_eras: int) -> str:
    """Best-first cutting of `counts (k, t, n)` into table `eras (k, era_no, a, b, avg_count)`."""
    return f"""
span AS (SELECT k, min(t) AS lo, max(t) AS hi FROM counts GROUP BY k HAVING count(*) >= 2),
filled AS (
  SELECT s.k, s.t, coalesce(c.n, 0) AS n
  FROM (SELECT k, unnest(generate_series(lo, hi)) AS t FROM span) s
  LEFT JOIN counts c ON c.k = s.k AND c.t = s.t),
pre AS (
  SELECT k, t, (sum(n) OVER (PARTITION BY k ORDER BY t))::DOUBLE AS c FROM filled
  UNION ALL SELECT k, lo - 1, 0::DOUBLE FROM span),
rounds(step, k, cuts) AS (
  SELECT 1, k, []::BIGINT[] FROM span
  UNION ALL
  SELECT step + 1, k, list_append(cuts, t) FROM (
    SELECT g.*, row_number() OVER (PARTITION BY k ORDER BY
        (left_sum * len - total * left_len) * (left_sum * len - total * left_len)
          / (len * left_len * (len - left_len)) DESC, t) AS r
    FROM (
      SELECT x.step, x.k, x.cuts, x.t, (m.c - a.c) AS left_sum, (b.c - a.c) AS total,
        (x.b - x.a)::DOUBLE AS len, (x.t - x.a)::DOUBLE AS left_len
      FROM (
        SELECT r.step, r.k, r.cuts, f.t,
          coalesce(list_max(list_filter(r.cuts, lambda y: y < f.t)), s.lo - 1) AS a,
          coalesce(list_min(list_filter(r.cuts, lambda y: y > f.t)), s.hi) AS b
        FROM rounds r JOIN span s ON s.k = r.k JOIN filled f ON f.k = r.k
        WHERE f.t < s.hi AND NOT list_contains(r.cuts, f.t) AND r.step < {max_eras}) x
      JOIN pre a ON a.k = x.k AND a.t = x.a
      JOIN pre b ON b.k = x.k AND b.t = x.b
      JOIN pre m ON m.k = x.k AND m.t = x.t) g
    WHERE left_sum * len - total * left_len <> 0)
  WHERE r = 1),
final AS (SELECT k, max_by(cuts, step) AS cuts FROM rounds GROUP BY k),
edges AS (
  SELECT f.k, row_number() OVER (PARTITION BY f.k ORDER BY e.b) AS era_no, e.b, s.lo
  FROM final f JOIN span s ON s.k = f.k, LATERAL (SELECT unnest(list_append(f.cuts, s.hi)) AS b) e),
eras AS (
  SELECT e.k, CAST(e.era_no AS INTEGER) AS era_no, e.a, e.b, avg(f.n) AS avg_count
  FROM (SELECT k, era_no, coalesce(lag(b) OVER (PARTITION BY k ORDER BY b) + 1, lo) AS a, b FROM edges) e
  JOIN filled f ON f.k = e.k AND f.t BETWEEN e.a AND e.b GROUP BY e.k, e.era_no, e.a, e.b)"""


@query("yearly_counts", """
SELECT o_orderpriority AS cluster_label, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY ALL
""")
def yearly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eras.yearly_counts(_dated_orders(spark, sf_dir), ["cluster_label"])


def _dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("cluster_label"), F.year("o_orderdate").alias("year")
    )


@query("dense_counts", """
WITH counts AS (SELECT c_custkey % 997 AS k, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS t, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
span AS (SELECT k, min(t) AS lo, max(t) AS hi FROM counts GROUP BY k HAVING count(*) >= 2)
SELECT s.k AS cluster_label, CAST(s.t AS INTEGER) AS month, coalesce(c.n, 0) AS n
FROM (SELECT k, unnest(generate_series(lo, hi)) AS t FROM span) s LEFT JOIN counts c ON c.k = s.k AND c.t = s.t
""")
def dense_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = (adapters.table(spark, sf_dir, name) for name in ("orders", "customer"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        (F.col("c_custkey") % 997).alias("cluster_label"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month")
    )
    return eras.dense_counts(eras.yearly_counts(rows, _BRAND, "month"), _BRAND, "month")


def _eras(spark: SparkSession, sf_dir: str, max_eras: int) -> DataFrame:
    return eras.find_eras(eras.yearly_counts(_sales(spark, sf_dir), _BRAND, "month"), max_eras, _BRAND, "month")


def _era_query(max_eras: int) -> str:
    return f"""
WITH RECURSIVE {_SALES}, {era_sql(max_eras)}
SELECT k AS cluster_label, era_no, CAST(a AS INTEGER) AS "start", CAST(b AS INTEGER) AS "end",
  round(avg_count, 6) AS avg_count FROM eras
"""


@query("era_segments", _era_query(5))
def era_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eras(spark, sf_dir, 5).withColumn("avg_count", F.round("avg_count", 6))


@query("era_segments_10", _era_query(10))
def era_segments_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eras(spark, sf_dir, 10).withColumn("avg_count", F.round("avg_count", 6))


@query("era_listing", f"""
WITH RECURSIVE {_SALES}, {era_sql(5)}
SELECT k AS cluster_label, era_no, CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) AS period,
  format('{{:,.1f}}', avg_count) AS activity
FROM eras
""")
def era_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eras.era_listing(_eras(spark, sf_dir, 5)).select("cluster_label", "era_no", "period", "activity")


@query("pivotal_papers", f"""
WITH RECURSIVE {_SALES}, {era_sql(5)}
SELECT cluster_label, era_no, period, rank_in_era, title, month, round(score, 6) AS score, arxiv_id FROM (
  SELECT e.k AS cluster_label, era_no, CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) AS period, title, t AS month,
    score, arxiv_id, row_number() OVER (PARTITION BY e.k, era_no ORDER BY score DESC, arxiv_id) AS rank_in_era
  FROM eras e JOIN sales s ON s.k = e.k AND s.t BETWEEN e.a AND e.b)
WHERE rank_in_era <= 3
""")
def pivotal_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivotal.pivotal_papers(_sales(spark, sf_dir), _eras(spark, sf_dir, 5), 3, _BRAND, "month")
    return found.withColumns({"score": F.round("score", 6), "rank_in_era": F.col("rank_in_era").cast("bigint")})


@query("nested_pivotal", f"""
WITH RECURSIVE {_SALES}, {era_sql(5)},
ranked AS (SELECT e.k, era_no, arxiv_id, row_number() OVER (PARTITION BY e.k, era_no ORDER BY score DESC, arxiv_id) AS r
  FROM eras e JOIN sales s ON s.k = e.k AND s.t BETWEEN e.a AND e.b)
SELECT e.k AS cluster_label, count(DISTINCT e.era_no) AS n_eras, count(arxiv_id) AS n_papers,
  string_agg(arxiv_id, ',' ORDER BY e.era_no, r) AS papers
FROM eras e LEFT JOIN ranked ON ranked.k = e.k AND ranked.era_no = e.era_no AND r <= 3 GROUP BY e.k
""")
def nested_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested table, read back: number of eras and papers, and the papers in their order."""
    found = _eras(spark, sf_dir, 5)
    papers = pivotal.pivotal_papers(_sales(spark, sf_dir), found, 3, _BRAND, "month")
    nested = pivotal.nested_pivotal(found, papers, _BRAND, "month")
    ids = F.flatten(F.transform("eras", lambda e: e["papers"]["arxiv_id"]))
    return nested.select(
        "cluster_label",
        F.size("eras").cast("bigint").alias("n_eras"),
        F.size(ids).cast("bigint").alias("n_papers"),
        F.array_join(ids, ",").alias("papers"),
    )


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("evolution_pivot", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, " + ", ".join(
    f"""count(*) FILTER (WHERE o_orderpriority = '{p}') AS "{p}\"""" for p in _PRIORITIES
) + " FROM orders GROUP BY 1")
def evolution_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal.evolution_matrix(_dated_orders(spark, sf_dir))


@query("concept_names", "SELECT DISTINCT o_orderpriority AS cluster_label FROM orders")
def concept_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal.concept_names(_dated_orders(spark, sf_dir), _BRAND)


@query("merged_labels", """
SELECT p_type AS cluster_label, min(p_size) AS cluster, count(DISTINCT p_size) AS clusters_merged FROM part GROUP BY 1
""")
def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = adapters.table(spark, sf_dir, "part")
    return pivotal.merged_labels(
        parts.select(F.col("p_type").alias("cluster_label"), F.col("p_size").alias("cluster")), _BRAND
    )


_QUERY_COSINES = f"""{_VDIMS},
centre AS (SELECT cluster AS query_id, dim, avg(x) AS x FROM dims GROUP BY ALL),
cosines AS (
  SELECT c.query_id, d.arxiv_id, d.year, d.cluster,
    round(sum(c.x * d.x) / (sqrt(sum(d.x * d.x)) * sqrt(sum(c.x * c.x))), 12) AS score
  FROM centre c JOIN dims d USING (dim) GROUP BY ALL)"""


@query("concept_eras_from_vectors", f"""
WITH RECURSIVE {_QUERY_COSINES},
hits AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, arxiv_id) AS rank FROM cosines
  WHERE year BETWEEN 1980 AND 2025) WHERE rank <= 200),
sales AS (SELECT query_id || '/' || cluster AS k, year AS t, * FROM hits),
counts AS (SELECT k, t, count(*) AS n FROM sales GROUP BY ALL),
{era_sql(5)}
SELECT query_id::BIGINT AS query_id, cluster_label, era_no, period, rank_in_era, year, round(score, 6) AS score, arxiv_id FROM (
  SELECT query_id, CAST(cluster AS VARCHAR) AS cluster_label, era_no, CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) AS period,
    CAST(year AS INTEGER) AS year, score, arxiv_id,
    row_number() OVER (PARTITION BY e.k, era_no ORDER BY score DESC, arxiv_id) AS rank_in_era
  FROM eras e JOIN sales s ON s.k = e.k AND s.t BETWEEN e.a AND e.b)
WHERE rank_in_era <= 3
""")
def concept_eras_from_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by the mean vector of every label, then eras and leading papers per (query, label)."""
    vectors = adapters.vectors(spark, sf_dir)
    asked = drift.centroids(vectors, ["cluster"]).select(
        F.col("cluster").cast("bigint").alias("query_id"), F.col("centroid").alias("dense_vector")
    )
    hits = retrieve.dense_topk(vectors, asked, 200)
    clusters = hits.drop("rank").join(
        vectors.select("arxiv_id", F.col("cluster").cast("string").alias("cluster_label")), "arxiv_id"
    ).persist()
    found = eras.find_eras(eras.yearly_counts(clusters), 5)
    papers = pivotal.pivotal_papers(clusters, found, 3)
    return papers.withColumns({"score": F.round("score", 6), "rank_in_era": F.col("rank_in_era").cast("bigint")})


def _analysis(spark: SparkSession, sf_dir: str, limit: int = 200) -> analysis.ConceptAnalysis:
    vectors = adapters.stored_vectors(spark, sf_dir)
    papers = adapters.papers(spark, sf_dir)
    vocabulary = encode.vocabulary(papers, F.concat_ws(" ", "title", "abstract"))
    return analysis.analyze(adapters.text_queries(spark, sf_dir), vectors, papers, vocabulary, limit=limit)


@query("concept_clusters")
def concept_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text analysed as a concept: its hits with cluster and label."""
    return _analysis(spark, sf_dir).concept_clusters.select(
        "query_id", "arxiv_id", "year", F.round("score", 6).alias("score"), "cluster", "cluster_label"
    )


@query("concept_analysis")
def concept_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text analysed as a concept: its leading papers per sub-concept and era."""
    return _analysis(spark, sf_dir).pivotal_papers.withColumn("score", F.round("score", 6))


# Drift ---------------------------------------------------------------------------------------

_SLICED = f"""{_VDIMS},
sliced AS (SELECT *, CAST(floor(year / 10.0) * 10 AS INTEGER) AS slice FROM dims),
centre AS (SELECT cluster AS query_id, slice, dim, avg(x) AS x, count(*) AS n FROM sliced GROUP BY ALL)"""


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.vectors(spark, sf_dir).withColumnRenamed("publication_year", "year")
    return drift.time_slices(rows.withColumnRenamed("cluster", "query_id"), 10)


@query("centroid_drift", f"""
WITH {_SLICED},
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY slice) AS i FROM centre)
SELECT c.query_id, c.slice, any_value(c.n) AS n,
  round(1 - sum(c.x * b.x) / (sqrt(sum(c.x * c.x)) * sqrt(sum(b.x * b.x))), 6) AS drift
FROM numbered c LEFT JOIN numbered b ON b.query_id = c.query_id AND b.i = c.i - 1 AND b.dim = c.dim GROUP BY c.query_id, c.slice
""")
def centroid_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = drift.centroids(_slices(spark, sf_dir), ["query_id", "slice"])
    return drift.adjacent_drift(centres).withColumn("drift", F.round("drift", 6))


@query("novelty", f"""
WITH {_VDIMS}, centre AS (SELECT cluster, dim, avg(x) AS x FROM dims GROUP BY ALL)
SELECT arxiv_id, d.cluster, round(1 - sum(c.x * d.x) / (sqrt(sum(d.x * d.x)) * sqrt(sum(c.x * c.x))), 6) AS novelty
FROM dims d JOIN centre c ON c.cluster = d.cluster AND c.dim = d.dim GROUP BY ALL
""")
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = adapters.vectors(spark, sf_dir)
    scored = drift.novelty(vectors, drift.centroids(vectors, ["cluster"]), ["cluster"])
    return scored.select("arxiv_id", "cluster", F.round("novelty", 6).alias("novelty"))


@query("slice_spread", f"""
WITH {_SLICED}
SELECT query_id, slice, round(avg(d2), 6) AS spread, count(*) AS n FROM (
  SELECT c.query_id, c.slice, s.arxiv_id, sum((s.x - c.x) * (s.x - c.x)) AS d2
  FROM sliced s JOIN centre c ON c.query_id = s.cluster AND c.slice = s.slice AND c.dim = s.dim GROUP BY ALL)
GROUP BY query_id, slice
""")
def slice_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _slices(spark, sf_dir)
    keys = ["query_id", "slice"]
    return drift.spread(points, drift.centroids(points, keys), keys).withColumn("spread", F.round("spread", 6))


@query("top_per_slice", f"""
WITH {_VDIMS}, centre AS (SELECT cluster, dim, avg(x) AS x FROM dims GROUP BY ALL),
scored AS (SELECT arxiv_id, d.cluster AS query_id, CAST(floor(year / 10.0) * 10 AS INTEGER) AS slice,
    round(sum(c.x * d.x) / (sqrt(sum(d.x * d.x)) * sqrt(sum(c.x * c.x))), 6) AS score
  FROM dims d JOIN centre c ON c.cluster = d.cluster AND c.dim = d.dim GROUP BY ALL)
SELECT query_id, slice, arxiv_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, slice ORDER BY score DESC, arxiv_id) AS rank FROM scored)
WHERE rank <= 5
""")
def top_per_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _slices(spark, sf_dir)
    scored = drift.novelty(points, drift.centroids(points, ["query_id"]), ["query_id"])
    ranked = drift.top_per_slice(scored.withColumn("score", F.round(F.lit(1.0) - F.col("novelty"), 6)), 5)
    return ranked.select("query_id", "slice", "arxiv_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("search_in_eras", f"""
WITH {_QUERY_COSINES},
decades AS (SELECT query_id, unnest([1990, 2000, 2010, 2020]) AS "start" FROM (SELECT DISTINCT query_id FROM centre))
SELECT query_id::BIGINT AS query_id, CAST("start" AS INTEGER) AS "start", rank, arxiv_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, "start" ORDER BY score DESC, arxiv_id) AS rank
  FROM cosines JOIN decades USING (query_id) WHERE year BETWEEN "start" AND "start" + 9)
WHERE rank <= 5
""")
def search_in_eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of every label searched within every decade."""
    vectors = adapters.vectors(spark, sf_dir)
    asked = drift.centroids(vectors, ["cluster"]).select(
        F.col("cluster").cast("bigint").alias("query_id"), F.col("centroid").alias("dense_vector")
    )
    decades = asked.select(
        "query_id", F.explode(F.array(*[F.lit(y) for y in (1990, 2000, 2010, 2020)])).alias("start")
    ).withColumn("end", F.col("start") + 9)
    hits = analysis.search_in_eras(vectors, asked, decades, 5)
    return hits.select(
        "query_id", "start", F.col("rank").cast("bigint").alias("rank"), "arxiv_id", F.round("score", 6).alias("score")
    )


@query("centroid_trajectory")
def centroid_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.trajectory(drift.centroids(_slices(spark, sf_dir), ["query_id", "slice"]))


# Timings: events stand for timed stages ----------------------------------------------------------


@query("stage_summary", """
WITH means AS (SELECT event_type AS stage, avg(value) AS a FROM events GROUP BY 1)
SELECT coalesce(stage, 'Total') AS stage, round(sum(a), 6) AS avg_time_sec,
  round(sum(a / (SELECT sum(a) FROM means) * 100), 6) AS percent_time_sec
FROM means GROUP BY ROLLUP (stage)
""")
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    timings = adapters.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"), F.col("value").alias("time_sec")
    )
    return evaluate.stage_summary(timings).select(
        "stage", F.round("avg_time_sec", 6).alias("avg_time_sec"), F.round("percent_time_sec", 6).alias("percent_time_sec")
    )


@query("throughput", """
SELECT user_id, count(*) AS n_papers, round(sum(value), 6) AS time_sec, round(count(*) / sum(value), 6) AS papers_per_sec
FROM events GROUP BY 1
""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = adapters.table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("n_papers"), F.sum("value").alias("time_sec")
    )
    return evaluate.throughput(runs).withColumns(
        {"time_sec": F.round("time_sec", 6), "papers_per_sec": F.round("papers_per_sec", 6)}
    )
