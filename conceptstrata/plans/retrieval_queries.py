"""Queries over encoders and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptstrata.functions.keys import hash60
from conceptstrata.functions.text import words
from conceptstrata.functions.vectors import jaccard
from conceptstrata.operators import drift, encode, evaluate, retrieve
from conceptstrata.operators.pruned_search import PostingBlocks, VectorCells
from conceptstrata.plans import adapters
from conceptstrata.plans.adapters import DIMS
from conceptstrata.plans.registry import ENCODED, HASH, PAPERS, VECTORS, WORDS, hashed, query
from conceptstrata.session import cut_lineage

# Encoding ------------------------------------------------------------------------------------


@query("encoder_input", f"WITH {PAPERS} SELECT arxiv_id, md5(title || '[SEP]' || abstract) AS input_md5 FROM papers")
def encoder_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encoder_input(adapters.papers(spark, sf_dir)).select("arxiv_id", F.md5("encoder_input").alias("input_md5"))


@query("log_tf_vectors", f"WITH {ENCODED} SELECT arxiv_id, token_id, round(w::FLOAT::DOUBLE, 6) AS weight FROM tf")
def log_tf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.postings(adapters.encoded_papers(spark, sf_dir)).select(
        "arxiv_id", "token_id", F.round(F.col("weight").cast("double"), 6).alias("weight")
    )


@query("dense_hash_vectors", f"""
WITH {ENCODED}, dense AS ({hashed('tf', 'arxiv_id', DIMS)})
SELECT arxiv_id, dim, round(x, 6) AS x FROM dense WHERE round(x, 6) <> 0
""")
def dense_hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.encoded_papers(spark, sf_dir).select("arxiv_id", F.posexplode("dense_vector").alias("dim", "x"))
    return rows.select(
        "arxiv_id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("x").cast("double"), 6).alias("x")
    ).where(F.col("x") != 0)


@query("vocabulary", f"WITH {ENCODED} SELECT DISTINCT token_id, token FROM tf")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir)


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.vocabulary(adapters.papers(spark, sf_dir), F.concat_ws(" ", "title", "abstract"))


@query("splade_pool", f"""
WITH seen AS (
  SELECT doc_id, unnest({WORDS.format(text='text')}) AS token,
         generate_subscripts({WORDS.format(text='text')}, 1) - 1 AS pos FROM documents),
logits AS (
  SELECT doc_id, {HASH.format(text='token')} AS token_id, pos % 8 <> 7 AS kept,
         ({HASH.format(text="token || ':' || CAST(pos AS VARCHAR)")} % 2000 - 1000) / 250.0::DOUBLE AS logit FROM seen)
SELECT doc_id, token_id, round(max(CASE WHEN kept THEN ln(1 + greatest(logit, 0)) ELSE 0 END), 6) AS weight
FROM logits GROUP BY ALL HAVING max(CASE WHEN kept THEN ln(1 + greatest(logit, 0)) ELSE 0 END) > 0
""")
def splade_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooling over made-up logits of every word position of the documents; each 8th is masked."""
    seen = adapters.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "token"))
    logits = seen.select(
        "doc_id",
        hash60(F.col("token")).alias("token_id"),
        (F.col("pos") % 8 != 7).cast("int").alias("mask"),
        ((hash60(F.concat_ws(":", "token", "pos")) % 2000 - 1000) / 250.0).alias("logit"),
    )
    return encode.max_pool_logits(logits).withColumn("weight", F.round("weight", 6))


@query("text_windows", f"""
WITH counted AS (SELECT CAST(doc_id AS VARCHAR) AS arxiv_id, {WORDS.format(text='text')} AS ws FROM documents),
cut AS (SELECT arxiv_id, ws, unnest(generate_series(0, greatest((len(ws) + 511) // 512, 1) - 1)) AS window_no FROM counted)
SELECT arxiv_id, CAST(window_no AS INTEGER) AS window_no,
  md5(coalesce(array_to_string(ws[window_no * 512 + 1 : window_no * 512 + 512], ' '), '')) AS text_md5
FROM cut
""")
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = encode.text_windows(adapters.papers(spark, sf_dir), "arxiv_id", F.col("abstract"), 512)
    return cut.select("arxiv_id", "window_no", F.md5("window_text").alias("text_md5"))


@query("window_pooling", f"""
WITH seen AS (
  SELECT CAST(doc_id AS VARCHAR) AS arxiv_id, unnest({WORDS.format(text='text')}) AS token,
         (generate_subscripts({WORDS.format(text='text')}, 1) - 1) // 512 AS window_no FROM documents),
tf AS (SELECT arxiv_id, window_no, token, ln(1 + count(*))::FLOAT::DOUBLE AS w FROM seen GROUP BY ALL)
SELECT arxiv_id, {HASH.format(text='token')} AS token_id, round(max(w), 6) AS weight FROM tf GROUP BY ALL
""")
def window_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window by window encoding of whole texts, pooled per text."""
    cut = encode.text_windows(adapters.papers(spark, sf_dir), "arxiv_id", F.col("abstract"), 512)
    encoded = encode.hash_encode(cut, F.col("window_text"), 16)
    pooled = encode.pool_windows(encoded, "arxiv_id")
    return encode.postings(pooled).withColumn("weight", F.round(F.col("weight").cast("double"), 6))


@query("drop_smallest_weights", f"""
WITH {ENCODED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY w::FLOAT, token_id) AS r,
         floor(count(*) OVER (PARTITION BY arxiv_id) * 0.2::DOUBLE) AS dropped FROM tf)
SELECT arxiv_id, token_id, round(w::FLOAT::DOUBLE, 6) AS weight FROM ranked WHERE r > dropped
""")
def drop_smallest_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.postings(adapters.encoded_papers(spark, sf_dir), 0.2).withColumn(
        "weight", F.round(F.col("weight").cast("double"), 6)
    )


# Dense retrieval over the given embeddings: the mean vector of every label is a query ------------


def _label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids = drift.centroids(adapters.vectors(spark, sf_dir), ["cluster"])
    return centroids.select(
        F.col("cluster").cast("bigint").alias("query_id"),
        F.col("centroid").alias("dense_vector"),
        (F.lit(1990) + F.col("cluster")).cast("int").alias("start_year"),
        (F.lit(2015) + F.col("cluster")).cast("int").alias("end_year"),
    )


_LABEL_QUERIES = f"""{VECTORS},
dims AS (SELECT arxiv_id, year, cluster, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM vectors),
centre AS (SELECT cluster AS query_id, dim, avg(x) AS x FROM dims GROUP BY ALL),
cosines AS (
  SELECT query_id, arxiv_id, year,
         round(dot / (sqrt(dl) * sqrt(ql)), 12) AS score
  FROM (SELECT c.query_id, d.arxiv_id, d.year, sum(c.x * d.x) AS dot FROM centre c JOIN dims d USING (dim) GROUP BY ALL)
  JOIN (SELECT arxiv_id, sum(x * x) AS dl FROM dims GROUP BY 1) USING (arxiv_id)
  JOIN (SELECT query_id, sum(x * x) AS ql FROM centre GROUP BY 1) USING (query_id))"""


@query("dense_topk", f"""
WITH {_LABEL_QUERIES}
SELECT query_id::BIGINT AS query_id, arxiv_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, arxiv_id) AS rank FROM cosines)
WHERE rank <= 20
""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _label_queries(spark, sf_dir).drop("start_year", "end_year")
    return _rounded(retrieve.dense_topk(adapters.vectors(spark, sf_dir), asked, 20))


@query("dense_topk_years", f"""
WITH {_LABEL_QUERIES}
SELECT query_id::BIGINT AS query_id, arxiv_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, arxiv_id) AS rank FROM cosines
  WHERE year BETWEEN 1990 + query_id AND 2015 + query_id)
WHERE rank <= 20
""")
def dense_topk_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(retrieve.dense_topk(adapters.vectors(spark, sf_dir), _label_queries(spark, sf_dir), 20))


@query("dense_topk_cells", f"""
WITH {_LABEL_QUERIES}
SELECT query_id::BIGINT AS query_id, arxiv_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, arxiv_id) AS rank FROM cosines
  WHERE year BETWEEN 1990 + query_id AND 2015 + query_id)
WHERE rank <= 20
""")
def dense_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search in vectors written by their nearest centre; cells out of reach are not read."""
    cells = VectorCells(adapters.vectors(spark, sf_dir), cells=32)
    return _rounded(cells.search(_label_queries(spark, sf_dir), 20))


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "arxiv_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


@query("year_category_filter", f"""
WITH {PAPERS}
SELECT arxiv_id, title, published_date FROM papers WHERE year(published_date) = 2001 AND primary_category = 'src7'
""")
def year_category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.restrict(adapters.papers(spark, sf_dir), 2001, "src7")
    return found.select("arxiv_id", "title", "published_date")


# Text retrieval: every benchmark text against every document --------------------------------------

_LIMIT = 50


def _lists(pool: int) -> str:
    """Dense and sparse candidate lists of every benchmark text."""
    return f"""{ENCODED},
d AS ({hashed('tf', 'arxiv_id', DIMS)}),
q AS ({hashed('qtf', 'query_id', DIMS)}),
dots AS (SELECT query_id, arxiv_id, sum(q.x * d.x) AS dot FROM q JOIN d USING (dim) GROUP BY ALL),
lengths AS (SELECT arxiv_id, sqrt(sum(x * x)) AS dl FROM d GROUP BY 1),
qlengths AS (SELECT query_id, sqrt(sum(x * x)) AS ql FROM q GROUP BY 1),
dense_all AS (
  SELECT a.query_id, p.arxiv_id, round(coalesce(dot / (dl * ql), 0), 12) AS score
  FROM (SELECT item_id AS query_id FROM benchmark) a CROSS JOIN papers p
  LEFT JOIN dots ON dots.query_id = a.query_id AND dots.arxiv_id = p.arxiv_id
  LEFT JOIN lengths ON lengths.arxiv_id = p.arxiv_id
  LEFT JOIN qlengths ON qlengths.query_id = a.query_id
  WHERE year(p.published_date) BETWEEN 1980 AND 2025),
dense AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, arxiv_id) AS rank FROM dense_all)
  WHERE rank <= {pool}),
sparse_all AS (
  SELECT query_id, arxiv_id, round(sum(qtf.w::FLOAT::DOUBLE * tf.w::FLOAT::DOUBLE), 12) AS score
  FROM qtf JOIN tf USING (token_id) WHERE year(published_date) BETWEEN 1980 AND 2025 GROUP BY ALL),
sparse AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, arxiv_id) AS rank FROM sparse_all)
  WHERE rank <= {pool})"""


def _fused(alpha: str, dense_scale: str, sparse_scale: str) -> str:
    return f"""
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, arxiv_id) AS rank FROM (
    SELECT query_id, arxiv_id,
      round({alpha} * coalesce({dense_scale}, 0) + (1 - {alpha}) * coalesce({sparse_scale}, 0), 12) AS score
    FROM dense_s d FULL JOIN sparse_s s USING (query_id, arxiv_id))"""


_BOUNDED = """
dense_s AS (SELECT query_id, arxiv_id, (1 + score) / 2 AS ds FROM dense),
sparse_s AS (SELECT query_id, arxiv_id, 0.5 + atan(score) / pi() AS ss FROM sparse)"""


def _search(spark: SparkSession, sf_dir: str, alpha: float, norm: str = "bounded", limit: int = _LIMIT) -> DataFrame:
    vectors, _, asked = _text_inputs(spark, sf_dir)
    return retrieve.hybrid_search(vectors, asked.withColumn("alpha", F.lit(alpha)), limit, norm)


def _text_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    vectors = adapters.stored_vectors(spark, sf_dir)
    return vectors, encode.postings(vectors, 0.0, "publication_year"), adapters.text_queries(spark, sf_dir)


@query("sparse_topk", f"WITH {_lists(_LIMIT)} SELECT query_id, arxiv_id, round(score, 6) AS score, rank FROM sparse")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, postings, asked = _text_inputs(spark, sf_dir)
    return _rounded(retrieve.sparse_topk(postings, retrieve.query_tokens(asked), _LIMIT))


@query("sparse_topk_blocks", f"WITH {_lists(_LIMIT)} SELECT query_id, arxiv_id, round(score, 6) AS score, rank FROM sparse")
def sparse_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search in blocks of postings by falling weight; blocks out of reach are not read."""
    vectors, postings, asked = _text_inputs(spark, sf_dir)
    return _rounded(PostingBlocks(postings).search(retrieve.query_tokens(asked), vectors, _LIMIT))


_TRIMMED = f"""{ENCODED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w::FLOAT, token_id) AS r,
                  floor(count(*) OVER (PARTITION BY query_id) * 0.2::DOUBLE) AS dropped FROM qtf),
scored AS (
  SELECT query_id, arxiv_id, round(sum(q.w::FLOAT::DOUBLE * tf.w::FLOAT::DOUBLE), 12) AS score
  FROM ranked q JOIN tf USING (token_id) WHERE r > dropped AND year(published_date) BETWEEN 1980 AND 2025 GROUP BY ALL)"""


@query("sparse_topk_trimmed_queries", f"""
WITH {_TRIMMED}
SELECT query_id, arxiv_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, arxiv_id) AS rank FROM scored) WHERE rank <= {_LIMIT}
""")
def sparse_topk_trimmed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lightest fifth of each query's tokens is left out."""
    _, postings, asked = _text_inputs(spark, sf_dir)
    return _rounded(retrieve.sparse_topk(postings, retrieve.query_tokens(asked, 0.2), _LIMIT))


@query("sparse_scan_topk", f"WITH {_lists(_LIMIT)} SELECT query_id, arxiv_id, round(score, 6) AS score, rank FROM sparse")
def sparse_scan_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, _, asked = _text_inputs(spark, sf_dir)
    return _rounded(retrieve.sparse_scan_topk(vectors, asked, _LIMIT))


@query("dense_text_topk", f"WITH {_lists(_LIMIT)} SELECT query_id, arxiv_id, round(score, 6) AS score, rank FROM dense")
def dense_text_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, _, asked = _text_inputs(spark, sf_dir)
    return _rounded(retrieve.dense_topk(vectors, asked, _LIMIT))


@query("hybrid_fusion", f"""
WITH {_lists(500)}, {_BOUNDED}, fused AS ({_fused('0.5', 'ds', 'ss')})
SELECT query_id, arxiv_id, round(score, 6) AS score, rank FROM fused WHERE rank <= {_LIMIT}
""")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_search(spark, sf_dir, 0.5))


@query("hybrid_fusion_minmax", f"""
WITH {_lists(500)},
dense_s AS (SELECT query_id, arxiv_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END AS ds FROM dense
  JOIN (SELECT query_id, min(score) AS lo, max(score) AS hi FROM dense GROUP BY 1) USING (query_id)),
sparse_s AS (SELECT query_id, arxiv_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END AS ss FROM sparse
  JOIN (SELECT query_id, min(score) AS lo, max(score) AS hi FROM sparse GROUP BY 1) USING (query_id)),
fused AS ({_fused('0.75', 'ds', 'ss')})
SELECT query_id, arxiv_id, round(score, 6) AS score, rank FROM fused WHERE rank <= {_LIMIT}
""")
def hybrid_fusion_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_search(spark, sf_dir, 0.75, "minmax"))


@query("search_without_hits", """
SELECT item_id AS query_id, '' AS arxiv_id, 0.0::DOUBLE AS score, 0 AS year, '' AS title FROM benchmark WHERE false
""")
def search_without_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of years without papers: no rows, and the columns of every result."""
    vectors, _, asked = _text_inputs(spark, sf_dir)
    late = asked.withColumns({"start_year": F.lit(2050), "end_year": F.lit(2060)})
    hits = retrieve.hybrid_search(vectors, late, _LIMIT)
    return retrieve.attach_metadata(hits, adapters.papers(spark, sf_dir)).select("query_id", "arxiv_id", "score", "year", "title")


@query("jaccard_of_word_sets", f"""
WITH sets AS (
  SELECT doc_id, list_distinct({WORDS.format(text="split_part(text, chr(10), 1)")}) AS a, list_distinct({WORDS.format(text='text')}) AS b
  FROM documents),
counted AS (SELECT doc_id, len(list_intersect(a, b)) AS shared, len(list_distinct(a || b)) AS either FROM sets)
SELECT doc_id, round(CASE WHEN either = 0 THEN 0 ELSE shared / either END, 6) AS jaccard FROM counted
""")
def jaccard_of_word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a document's vocabulary its first line holds."""
    docs = adapters.table(spark, sf_dir, "documents")
    first, whole = words(F.substring_index("text", "\n", 1)), words(F.col("text"))
    return docs.select("doc_id", F.round(jaccard(F.array_distinct(first), F.array_distinct(whole)), 6).alias("jaccard"))


@query("search_with_metadata", f"""
WITH {_lists(500)}, {_BOUNDED}, fused AS ({_fused('0.5', 'ds', 'ss')})
SELECT query_id, arxiv_id, round(score, 6) AS score, CAST(year(published_date) AS INTEGER) AS year, title, primary_category,
  published_date
FROM fused JOIN papers USING (arxiv_id) WHERE rank <= {_LIMIT}
""")
def search_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _search(spark, sf_dir, 0.5)
    return retrieve.attach_metadata(hits, adapters.papers(spark, sf_dir)).select(
        "query_id", "arxiv_id", F.round("score", 6).alias("score"), "year", "title", "primary_category", "published_date"
    )


@query("reciprocal_rank_fusion", f"""
WITH {_lists(500)}
SELECT query_id, arxiv_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, arxiv_id) AS rank FROM (
    SELECT query_id, arxiv_id,
      round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 12) AS score
    FROM dense d FULL JOIN sparse s USING (query_id, arxiv_id)))
WHERE rank <= {_LIMIT}
""")
def reciprocal_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, _, asked = _text_inputs(spark, sf_dir)
    dense = retrieve.dense_topk(vectors, asked, 500)
    sparse = retrieve.sparse_scan_topk(vectors, asked, 500)
    return _rounded(retrieve.reciprocal_rank_fusion(dense, sparse, _LIMIT))


@query("known_item_rank", f"""
WITH {_lists(500)}, {_BOUNDED}, fused AS ({_fused('0.5', 'ds', 'ss')}),
targets AS (SELECT query_id, arxiv_id FROM sparse WHERE rank = 1)
SELECT t.query_id, t.arxiv_id, rank, CASE WHEN rank IS NULL THEN 0 ELSE 1 END AS hit,
  round(coalesce(1.0::DOUBLE / rank, 0), 6) AS reciprocal_rank
FROM targets t LEFT JOIN (SELECT * FROM fused WHERE rank <= {_LIMIT}) f USING (query_id, arxiv_id)
""")
def known_item_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank in the hybrid list of the paper that shares most words with the query."""
    vectors, _, asked = _text_inputs(spark, sf_dir)
    targets = retrieve.sparse_scan_topk(vectors, asked, 1).select("query_id", "arxiv_id")
    ranked = retrieve.known_item_rank(_search(spark, sf_dir, 0.5), targets)
    return ranked.select(
        "query_id",
        "arxiv_id",
        F.col("rank").cast("bigint").alias("rank"),
        "hit",
        F.round("reciprocal_rank", 6).alias("reciprocal_rank"),
    )


# Comparison of dense, sparse and hybrid lists ----------------------------------------------------


def _methods(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    """The three result lists of every query; both searches run once."""
    vectors, _, asked = _text_inputs(spark, sf_dir)
    pool = retrieve.candidate_limit(limit)
    dense = cut_lineage(retrieve.dense_topk(vectors, asked, pool), "dense")
    sparse = cut_lineage(retrieve.sparse_scan_topk(vectors, asked, pool), "sparse")
    lists = None
    for method, alpha in (("dense", 1.0), ("sparse", 0.0), ("hybrid", 0.5)):
        hits = retrieve.fuse(dense, sparse, asked.select("query_id").withColumn("alpha", F.lit(alpha)), limit)
        hits = hits.withColumn("method", F.lit(method))
        lists = hits if lists is None else lists.unionByName(hits)
    return lists


_METHODS = f"""WITH {_lists(500)}, {_BOUNDED},
f1 AS ({_fused('1', 'ds', 'ss')}), f0 AS ({_fused('0', 'ds', 'ss')}), fh AS ({_fused('0.5', 'ds', 'ss')}),
lists AS (
  SELECT 'dense' AS method, * FROM f1 WHERE rank <= {_LIMIT} UNION ALL
  SELECT 'sparse', * FROM f0 WHERE rank <= {_LIMIT} UNION ALL
  SELECT 'hybrid', * FROM fh WHERE rank <= {_LIMIT})"""


@query("jaccard_methods", f"""
{_METHODS},
held AS (SELECT query_id, arxiv_id, max(CASE method WHEN 'dense' THEN 1 ELSE 0 END) AS d,
  max(CASE method WHEN 'sparse' THEN 1 ELSE 0 END) AS s, max(CASE method WHEN 'hybrid' THEN 1 ELSE 0 END) AS h
  FROM lists GROUP BY ALL)
SELECT query_id, round(sum(d * s) / sum(greatest(d, s)), 6) AS jaccard_dense_sparse,
  round(sum(d * h) / sum(greatest(d, h)), 6) AS jaccard_dense_hybrid,
  round(sum(s * h) / sum(greatest(s, h)), 6) AS jaccard_sparse_hybrid,
  sum(d)::BIGINT AS n_results_dense, sum(s)::BIGINT AS n_results_sparse, sum(h)::BIGINT AS n_results_hybrid
FROM held GROUP BY query_id
""")
def jaccard_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    overlaps = evaluate.jaccard_by_method(_methods(spark, sf_dir, _LIMIT), ["dense", "sparse", "hybrid"])
    for column in overlaps.columns:
        if column.startswith("jaccard"):
            overlaps = overlaps.withColumn(column, F.round(column, 6))
    return overlaps


@query("topn_by_method", f"""
{_METHODS}
SELECT query_id, method, rank, arxiv_id, title, CAST(year(published_date) AS INTEGER) AS year, round(score, 6) AS score
FROM lists JOIN papers USING (arxiv_id) WHERE rank <= 10
""")
def topn_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _methods(spark, sf_dir, _LIMIT).drop("rank")
    named = retrieve.attach_metadata(evaluate.top_by_method(hits, 10), adapters.papers(spark, sf_dir))
    return named.select(
        "query_id", "method", F.col("rank").cast("bigint").alias("rank"), "arxiv_id", "title", "year", F.round("score", 6).alias("score")
    )
