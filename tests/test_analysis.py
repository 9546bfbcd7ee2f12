"""The whole analysis on a corpus with two known sub-concepts."""

import pytest
from pyspark.sql import functions as F

from conceptstrata.operators import encode
from conceptstrata.plans.analysis import analyze, text_queries
from conceptstrata.sources.database import shard_predicates

SEA, LIGHT = "wave ocean tide sea shore", "wave photon quantum laser beam"


@pytest.fixture(scope="module")
def result(spark):
    rows = [(f"s{y}-{i}", f"{SEA} s{y}x{i}", y) for y in range(1990, 2000) for i in range(2)]
    rows += [(f"l{y}-{i}", f"{LIGHT} l{y}x{i}", y) for y in range(2005, 2011) for i in range(1 if y < 2008 else 6)]
    rows += [("other", "cell protein gene", 2001)]
    papers = spark.createDataFrame(rows, "arxiv_id string, title string, year int").select(
        "arxiv_id",
        "title",
        F.lit("").alias("abstract"),
        F.lit("cs").alias("primary_category"),
        F.make_date("year", F.lit(6), F.lit(1)).alias("published_date"),
    )
    vectors = encode.hash_encode_papers(papers, 256).withColumn("publication_year", F.year("published_date"))
    asked = spark.createDataFrame(
        [
            (1, "wave", 0.5, 1980, 2025, None),
            (2, "wave", 0.0, 2030, 2040, None),
            (3, "wave", 0.5, 1990, 1999, 3),
            (4, "protein", 0.0, 1980, 2025, None),
        ],
        "query_id bigint, text string, alpha double, start_year int, end_year int, n_clusters int",
    )
    queries = encode.hash_encode(asked, F.col("text"), 256)
    vocabulary = encode.vocabulary(papers, F.col("title"))
    return analyze(queries, vectors, papers, vocabulary, limit=41, max_eras=5, pivotal_k=2)


def test_search_results(result):
    hits = result.search_results.collect()
    counts = {q: sum(r.query_id == q for r in hits) for q in (1, 2, 3)}
    assert counts == {1: 41, 2: 0, 3: 20}
    assert all(1990 <= r.year <= 1999 for r in hits if r.query_id == 3)
    assert all(r.title for r in hits)


def test_sub_concepts(result):
    one = result.concept_clusters.where("query_id = 1").collect()
    by_label = {}
    for r in one:
        by_label.setdefault(r.cluster_label, set()).add(r.arxiv_id[0])
    assert len(by_label) == 2 and sorted(map(sorted, by_label.values())) == [["l"], ["s"]]
    for label, kinds in by_label.items():
        assert set(label.split(", ")) == set((SEA if kinds == {"s"} else LIGHT).split())
    three = result.concept_clusters.where("query_id = 3")
    assert three.select("cluster").distinct().count() == 3


def test_eras_and_leading_papers(result):
    light = "photon"
    eras = result.concept_eras.where(F.col("cluster_label").contains(light) & (F.col("query_id") == 1))
    got = [(r.start, r.end, r.avg_count) for r in eras.orderBy("era_no").collect()]
    assert got == [(2005, 2007, 1.0), (2008, 2010, 6.0)]
    papers = result.pivotal_papers.where(F.col("cluster_label").contains(light) & (F.col("query_id") == 1)).collect()
    assert {(r.period, r.rank_in_era) for r in papers} == {
        (p, n) for p in ("2005-2007", "2008-2010") for n in (1, 2)
    }
    scores = {r.arxiv_id: r.score for r in result.search_results.where("query_id = 1").collect()}
    for r in papers:
        first, last = map(int, r.period.split("-"))
        better = [
            i for i, s in scores.items()
            if i[0] == "l" and first <= int(i[1:5]) <= last and (s, r.arxiv_id) > (r.score, i)
        ]
        assert len(better) == r.rank_in_era - 1


def test_nested_and_evolution(result):
    nested = {(r.query_id, r.cluster_label): r.eras for r in result.nested().collect()}
    assert all(e.papers for eras in nested.values() for e in eras)
    evolution = result.evolution().where("query_id = 1").agg(F.sum("n")).first()[0]
    assert evolution == 41


def test_sparse_only_query_scores_only_papers_with_its_words(result):
    hits = result.search_results.where("query_id = 4").collect()
    assert [r.arxiv_id for r in hits if r.score > 0] == ["other"]


def test_queries_from_texts(spark):
    rows = text_queries(spark, ["Token", "Entropy"], alpha=0.75, n_clusters=3).orderBy("query_id").collect()
    assert [(r.query_id, r.text, r.alpha, r.start_year, r.end_year, r.n_clusters) for r in rows] == [
        (1, "Token", 0.75, 1980, 2025, 3),
        (2, "Entropy", 0.75, 1980, 2025, 3),
    ]
    assert [len(r.dense_vector) for r in rows] == [768, 768] and [len(r.sparse_vector) for r in rows] == [1, 1]


def test_database_shards():
    assert shard_predicates("id", 2) == ["ABS(CAST(hashtext(id) AS bigint)) % 2 = 0", "ABS(CAST(hashtext(id) AS bigint)) % 2 = 1"]


def test_result_says_what_was_asked(result):
    asked = {r.query_id: r.n_clusters for r in result.queries.collect()}
    assert {1, 2, 3} <= set(asked) and result.measure == "exact" and result.limit > 0
    chosen = {r.query_id: r.k for r in result.chosen_k.collect()}
    assert 2 not in chosen and all(asked[q] in (None, k) for q, k in chosen.items())
