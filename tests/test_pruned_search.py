"""Pruned search gives the hits of a scan and reads less."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptstrata.operators import encode, retrieve
from conceptstrata.operators.pruned_search import PostingBlocks, VectorCells
from conceptstrata.session import cut_lineage


def key(r):
    return (r.query_id, r["rank"], r.arxiv_id, r.year, round(r.score, 9))


def clustered(spark, n=3000, groups=12, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    data = centres[rng.integers(groups, size=n)] + 0.05 * rng.normal(size=(n, dims))
    data[:40] = data[0]  # copies
    data[40] = 0.0
    rows = [(f"d{i:04d}", 1990 + i % 30, [float(x) for x in v]) for i, v in enumerate(data)] + [("none", None, [1.0] * dims), ("empty", 2000, [])]
    papers = spark.createDataFrame(rows, "arxiv_id string, publication_year int, dense_vector array<float>").repartition(4)
    asked = [(q, [float(x) for x in data[q * 50 % n]], 1980, 2025) for q in range(12)]
    asked += [(50, [float(x) for x in rng.normal(size=dims)], 1995, 1996), (51, rows[0][2], 2040, 2050), (52, [0.0] * dims, 1990, 1992)]
    return papers, spark.createDataFrame(asked, "query_id bigint, dense_vector array<float>, start_year int, end_year int")


@pytest.mark.parametrize("k", [1, 15, 400])
def test_cells_equal_the_scan(spark, k):
    papers, asked = clustered(spark)
    cells = VectorCells(papers, cells=24)
    counts = []
    got = cells.search(asked, k, counts)
    want = retrieve.dense_topk(papers, asked, k)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    compared, whole = counts[0]
    assert whole == 3001 * 15 - 15 and compared < (0.35 if k < 400 else 0.8) * whole


def test_cells_with_blocks_of_queries(spark, monkeypatch):
    papers, asked = clustered(spark, n=400)
    want = sorted(map(key, retrieve.dense_topk(papers, asked, 5).collect()))
    monkeypatch.setattr("conceptstrata.operators.pruned_search.QUERY_ROWS", 4)
    cells = VectorCells(papers, cells=6)
    assert sorted(map(key, cells.search(asked, 5).collect())) == want
    assert cells.search(asked.where("query_id < 0"), 5).count() == 0
    assert VectorCells(papers.limit(0)).search(asked, 5).count() == 0


def weighted(spark, n=2500, tokens=300, seed=4):
    """Papers with few frequent and many rare tokens; a third of them are copies of one."""
    rng = np.random.default_rng(seed)
    odds = 1 / np.arange(1, tokens + 1)
    odds /= odds.sum()

    def weights(size):
        chosen = rng.choice(tokens, size=size, replace=False, p=odds)
        return {int(t): float(np.float32(rng.exponential())) + 0.01 for t in chosen}

    rows = [(f"d{i:04d}", 1990 + i % 30, weights(int(rng.integers(1, 25)))) for i in range(n)]
    rows = [(i, y, rows[0][2] if j % 3 == 0 else w) for j, (i, y, w) in enumerate(rows)]
    vectors = spark.createDataFrame(rows, "arxiv_id string, publication_year int, sparse_vector map<bigint,float>").repartition(3)
    asked = [(q, weights(6), 1990, 2000 + 2 * q) for q in range(8)] + [(20, {}, 1990, 2000), (21, {9999: 1.0}, 1990, 2000), (22, {3: 2.0}, 2050, 2060)]
    queries = spark.createDataFrame(asked, "query_id bigint, sparse_vector map<bigint,float>, start_year int, end_year int")
    return vectors, queries


@pytest.mark.parametrize("k", [1, 10, 900])
def test_posting_blocks_equal_the_scan(spark, k):
    vectors, queries = weighted(spark)
    blocks = PostingBlocks(encode.postings(vectors, 0.0, "publication_year"), block_rows=16)
    counts = []
    got = blocks.search(retrieve.query_tokens(queries), vectors, k, counts)
    want = retrieve.sparse_scan_topk(vectors, queries, k)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    read, whole = counts[0]
    assert read <= whole and (k == 900 or read < 0.6 * whole), (read, whole)


def test_posting_blocks_of_nothing(spark):
    vectors, queries = weighted(spark, n=30)
    blocks = PostingBlocks(encode.postings(vectors.limit(0), 0.0, "publication_year"))
    assert blocks.search(retrieve.query_tokens(queries), vectors.limit(0), 5).count() == 0
    blocks = PostingBlocks(encode.postings(vectors, 0.0, "publication_year"))
    assert blocks.search(retrieve.query_tokens(queries.limit(0)), vectors, 5).count() == 0


def test_posting_blocks_move_only_what_may_be_a_hit(spark, monkeypatch):
    """The index is written without a shuffle, and of (query, paper) pairs only the k best of a task leave it."""
    rows = [(f"d{i:04d}", 2000, {t: float(1 + (i + t) % 3) for t in range(12)}) for i in range(1500)]
    vectors = cut_lineage(spark.createDataFrame(rows, "arxiv_id string, publication_year int, sparse_vector map<bigint,float>").repartition(3), "papers")
    asked = [(q, {t: 1.0 for t in range(q, q + 4)}, 1990, 2010) for q in range(8)]
    queries = spark.createDataFrame(asked, "query_id bigint, sparse_vector map<bigint,float>, start_year int, end_year int")
    written = {}

    def noted(df, name="stage"):
        out = cut_lineage(df, name)
        written[name] = (df._jdf.queryExecution().executedPlan().toString(), out.count())
        return out

    monkeypatch.setattr("conceptstrata.operators.pruned_search.cut_lineage", noted)
    blocks = PostingBlocks(encode.postings(vectors, 0.0, "publication_year"), segment_rows=4000)
    got = blocks.search(retrieve.query_tokens(queries), vectors, 10)
    want = retrieve.sparse_scan_topk(vectors, queries, 10)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert "Exchange" not in written["posting-blocks"][0]
    assert blocks.blocks.select("segment").distinct().count() >= 5 and not blocks.loose
    assert written["sums"][1] <= 8 * 10 * 8 and written["partly-read"][1] <= 8 * 10 * 8, written


@pytest.mark.parametrize("k", [3, 60])
def test_posting_blocks_of_papers_that_lie_apart(spark, k):
    """Postings dealt by token, ids that come twice, with two years or not at all: sums per id and year, as in the postings table."""
    vectors, queries = weighted(spark, n=400)
    years = vectors.where("publication_year < 1994").withColumn("publication_year", F.col("publication_year") + 4)
    nameless = vectors.where("publication_year = 1999").withColumn("arxiv_id", F.lit(None).cast("string"))
    all_rows = cut_lineage(vectors.unionByName(vectors.where("publication_year < 1998")).unionByName(years).unionByName(nameless), "papers")
    postings = encode.postings(all_rows, 0.0, "publication_year")
    tokens = retrieve.query_tokens(queries)
    want = sorted(map(str, map(key, retrieve.sparse_topk(postings, tokens, k).collect())))
    for lying in (postings, postings.repartition(5, "token_id"), postings.orderBy("weight").coalesce(1)):
        blocks = PostingBlocks(lying, block_rows=16, segment_rows=300)
        assert blocks.loose
        assert sorted(map(str, map(key, blocks.search(tokens, all_rows, k).collect()))) == want


def test_posting_blocks_with_odd_queries(spark, monkeypatch):
    """Tokens that come twice, years by token, queries without an id, and more queries than a block holds."""
    vectors, queries = weighted(spark, n=500)
    postings = encode.postings(vectors, 0.0, "publication_year")
    tokens = retrieve.query_tokens(queries)
    more = tokens.where("query_id = 1").withColumns({"start_year": F.lit(2003), "end_year": F.lit(2019), "query_weight": F.lit(0.25)})
    odd = tokens.unionByName(tokens.where("query_id < 3")).unionByName(more)
    want = sorted(map(key, retrieve.sparse_topk(postings, odd, 9).collect()))
    odd = odd.unionByName(tokens.where("query_id = 2").withColumn("query_id", F.lit(None).cast("bigint")))
    blocks = PostingBlocks(postings, block_rows=16, segment_rows=700)
    assert sorted(map(key, blocks.search(odd, vectors, 9).collect())) == want
    monkeypatch.setattr("conceptstrata.operators.pruned_search.QUERY_ROWS", 6)
    named = odd.withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    got = blocks.search(named, vectors, 9).withColumn("query_id", F.substring("query_id", 2, 9).cast("bigint"))
    assert sorted(map(key, got.collect())) == want


def test_query_sets_around_a_block(spark, monkeypatch):
    """One query more than a block holds: the same hits, and papers are never shuffled."""
    monkeypatch.setattr(retrieve, "QUERY_ROWS", 12)
    papers, asked = clustered(spark, n=500)
    few = asked.where("query_id < 12")
    more = asked.where("query_id < 12 OR query_id = 50")
    inside = retrieve.dense_topk(papers, few, 7)
    beyond = retrieve.dense_topk(papers, more, 7)
    assert sorted(map(key, inside.collect())) == sorted(k for k in map(key, beyond.collect()) if k[0] < 12)
    assert {r.query_id for r in beyond.collect()} == {*range(12), 50}
    stored = cut_lineage(papers, "papers")
    hits = retrieve.dense_topk(stored, few, 7)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in plan[plan.index("MapInArrow") :]
