"""Retrieval against brute force; fusion and evaluation by hand."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conceptstrata.functions import vectors as vec
from conceptstrata.operators import encode, evaluate, ranking, retrieve


def corpus(spark, n=200, dims=8, copies=60, seed=1):
    """Vectors of which a third are copies of one."""
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dims))
    data[:copies] = data[0]
    rows = [(f"d{i:03d}", 1990 + i % 30, [float(x) for x in v]) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "arxiv_id string, publication_year int, dense_vector array<float>")
    return np.array(data, dtype=np.float32).astype(float), rows, df.repartition(5)


def expected(data, rows, query, k, years=(1980, 2025)):
    q = np.array(query, dtype=np.float32).astype(float)
    score = np.round(data @ q / (np.linalg.norm(data, axis=1) * np.linalg.norm(q)), 9)
    order = sorted((-s, r[0]) for s, r in zip(score, rows) if years[0] <= r[1] <= years[1])
    return [i for _, i in order[:k]]


def test_long_batches_are_encoded_in_slices(spark, monkeypatch):
    texts = ["a b a", "", "b c d e", "a", "c c c c c", "f"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)

    def vectors():
        rows = encode.hash_encode(frame, F.col("text"), 8).collect()
        return {r.doc_id: (r.text, r.dense_vector, r.sparse_vector) for r in rows}

    want = vectors()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000
    batch = pa.record_batch({"doc_id": list(range(6)), "_tokens": [[1, 2, 1], [], [2, 3, 4, 5], [1], [3] * 5, [6]]})
    for limits, sizes in (((2, 100), [2, 2, 2]), ((9, 4), [2, 1, 1, 1, 1]), ((9, 7), [3, 3])):
        for name, limit in zip(("SLICE_ROWS", "SLICE_TOKENS"), limits, strict=True):
            monkeypatch.setattr(encode, name, limit)
        parts = list(encode._slices(batch))
        assert [p.num_rows for p in parts] == sizes
        assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
        encoded = [r for p in parts for r in encode._encoded(p, 8, ["doc_id", "dense", "sparse"]).to_pylist()]
        assert encoded == encode._encoded(batch, 8, ["doc_id", "dense", "sparse"]).to_pylist()
    assert want[1][2] == {} and sum(x * x for x in want[2][1]) == pytest.approx(1.0)


@pytest.mark.parametrize("k", [10, 80, 300])
@pytest.mark.parametrize("block", [False, True])
def test_dense_topk_equals_brute_force(spark, monkeypatch, k, block):
    data, rows, papers = corpus(spark)
    rng = np.random.default_rng(7)
    asked = [(q, [float(x) for x in rng.normal(size=8)], 1980 + q, 2010 + q) for q in range(6)]
    asked.append((6, rows[0][2], 1980, 2025))
    queries = spark.createDataFrame(asked, "query_id bigint, dense_vector array<float>, start_year int, end_year int")
    if block:
        monkeypatch.setattr(retrieve, "QUERY_ROWS", 2)
        monkeypatch.setattr(retrieve, "HELD_ROWS", 2 * k)
    got = retrieve.dense_topk(papers, queries, k).collect()
    for query_id, vector, first, last in asked:
        mine = [r.arxiv_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == query_id]
        assert mine == expected(data, rows, vector, k, (first, last))


def test_no_query_gives_a_typed_empty_result(spark):
    _, _, papers = corpus(spark)
    none = spark.createDataFrame([], "query_id bigint, dense_vector array<float>")
    hits = retrieve.dense_topk(papers, none, 5)
    assert hits.columns == ["query_id", "arxiv_id", "year", "score", "rank"] and hits.count() == 0


def test_two_level_ranking_equals_one_level(spark, monkeypatch):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"),
        "id",
    ).repartition(9)
    order = [F.desc("v"), F.col("id")]
    one = ranking.top_k(rows, ["g"], order, 200).collect()
    monkeypatch.setattr(ranking, "TWO_LEVEL_FROM", 0)
    two = ranking.top_k(rows, ["g"], order, 200).collect()
    assert sorted(one) == sorted(two)


def test_broadcast_only_below_the_bound(spark):
    small = spark.range(10).withColumnRenamed("id", "x")
    plan = ranking.broadcast_checked(small, 10)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan.lower()
    plan = ranking.broadcast_checked(small.where("x >= 0"), 9)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in plan.lower()


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, arxiv_id string, year int, score double")


def test_fusion_counts_missing_sides_as_zero(spark):
    dense = lists(spark, [(1, "a", 2000, 0.9), (1, "b", 2001, 0.5)])
    sparse = lists(spark, [(1, "b", 2001, 0.4), (1, "c", 2002, 0.8)])
    queries = spark.createDataFrame([(1, None)], "query_id bigint, alpha double")
    got = [(r.arxiv_id, r.score, r.year) for r in retrieve.fuse(dense, sparse, queries, 5, "none").orderBy("rank").collect()]
    assert got == [("a", 0.45, 2000), ("b", 0.45, 2001), ("c", 0.4, 2002)]
    with pytest.raises(ValueError):
        retrieve.fuse(dense, sparse, queries, 5, "other")


def test_alpha_one_is_the_dense_order(spark):
    dense = lists(spark, [(1, f"d{i}", 2000, 1.0 - i / 10) for i in range(8)])
    sparse = lists(spark, [(1, f"d{i}", 2000, float(i)) for i in range(4, 8)])
    for alpha, want in ((1.0, [f"d{i}" for i in range(8)]), (0.0, ["d7", "d6", "d5", "d4"])):
        queries = spark.createDataFrame([(1, alpha)], "query_id bigint, alpha double")
        hits = retrieve.fuse(dense, sparse, queries, len(want)).orderBy("rank").collect()
        assert [r.arxiv_id for r in hits] == want


def test_reciprocal_rank_fusion(spark):
    dense = lists(spark, [(1, "a", 2000, 0.9), (1, "b", 2001, 0.5)]).withColumn("rank", F.expr("if(arxiv_id='a',1,2)"))
    sparse = lists(spark, [(1, "b", 2001, 9.0)]).withColumn("rank", F.lit(1))
    got = retrieve.reciprocal_rank_fusion(dense, sparse, 5).orderBy("rank").collect()
    assert [(r.arxiv_id, r.score) for r in got] == [
        ("b", pytest.approx(1 / 62 + 1 / 61)),
        ("a", pytest.approx(1 / 61)),
    ]


def test_known_item(spark):
    hits = lists(spark, [(1, "a", 2000, 0.9)]).withColumn("rank", F.lit(4))
    targets = spark.createDataFrame([(1, "a"), (2, "z")], "query_id bigint, arxiv_id string")
    got = {r.query_id: (r["rank"], r.hit, r.reciprocal_rank) for r in retrieve.known_item_rank(hits, targets).collect()}
    assert got == {1: (4, 1, 0.25), 2: (None, 0, 0.0)}


def test_candidate_limit():
    assert [retrieve.candidate_limit(n) for n in (10, 1000, 5000)] == [100, 10000, 50000]


def test_sparse_topk_by_hand(spark):
    postings = spark.createDataFrame(
        [(1, "a", 1.0, 2000), (2, "a", 0.5, 2000), (1, "b", 2.0, 1970), (2, "c", 3.0, 2001)],
        "token_id bigint, arxiv_id string, weight float, publication_year int",
    )
    queries = spark.createDataFrame([(7, {1: 1.0, 2: 0.5})], "query_id bigint, sparse_vector map<bigint,float>")
    hits = retrieve.sparse_topk(postings, retrieve.query_tokens(queries), 5).orderBy("rank").collect()
    assert [(r.arxiv_id, r.score) for r in hits] == [("c", 1.5), ("a", 1.25)]


@pytest.mark.parametrize("block", [False, True])
@pytest.mark.parametrize("cells", [8 << 20, 40])
def test_sparse_scan_equals_postings(spark, monkeypatch, block, cells):
    rng = np.random.default_rng(2)

    def weights():
        tokens = rng.choice(40, size=rng.integers(0, 12), replace=False)
        return {int(t): float(w) for t, w in zip(tokens, rng.random(len(tokens)) + 0.1)}

    papers = [(f"d{i:03d}", 1990 + i % 30, weights() if i > 70 else {1: 0.5, 2: 1.0}) for i in range(210)]
    vectors = spark.createDataFrame(
        papers, "arxiv_id string, publication_year int, sparse_vector map<bigint,float>"
    ).repartition(4)
    asked = spark.createDataFrame(
        [(q, weights(), 1990, 2000 + q) for q in range(6)] + [(9, {}, 1990, 2000), (8, {77: 1.0}, 1990, 2000)],
        "query_id bigint, sparse_vector map<bigint,float>, start_year int, end_year int",
    )
    monkeypatch.setattr(retrieve, "MATRIX_CELLS", cells)
    if block:
        monkeypatch.setattr(retrieve, "QUERY_ROWS", 2)
    scan = retrieve.sparse_scan_topk(vectors, asked, 100).collect()
    postings = encode.postings(vectors, 0.0, "publication_year")
    lookup = retrieve.sparse_topk(postings, retrieve.query_tokens(asked), 100).collect()
    key = lambda r: (r.query_id, r["rank"], r.arxiv_id, r.year, round(r.score, 9))
    assert sorted(map(key, scan)) == sorted(map(key, lookup)) and len(scan) > 50


def test_jaccard_edges(spark):
    rows = [(1, "x", "a"), (1, "y", "b"), (2, "x", "a"), (2, "y", "a")]
    hits = spark.createDataFrame(rows, "query_id bigint, method string, arxiv_id string")
    got = {r.query_id: r.jaccard_x_y for r in evaluate.jaccard_by_method(hits, ["x", "y"]).collect()}
    assert got == {1: 0.0, 2: 1.0}
    arrays = spark.createDataFrame(
        [([], []), (["a"], ["a", "b"])], "a array<string>, b array<string>"
    ).select(vec.jaccard(F.col("a"), F.col("b")).alias("j"))
    assert [r.j for r in arrays.collect()] == [0.0, 0.5]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("xy"), st.integers(0, 12)), min_size=1, max_size=30, unique=True))
def test_jaccard_is_symmetric_and_bounded(spark, pairs):
    hits = spark.createDataFrame([(1, m, str(i)) for m, i in pairs], "query_id bigint, method string, arxiv_id string")
    ab = evaluate.jaccard_by_method(hits, ["x", "y"]).first().jaccard_x_y
    ba = evaluate.jaccard_by_method(hits, ["y", "x"]).first().jaccard_y_x
    x, y = ({i for m, i in pairs if m == side} for side in "xy")
    assert ab == ba == pytest.approx(len(x & y) / len(x | y))


def test_pooling_of_logits(spark):
    logits = spark.createDataFrame(
        [(1, 0, 9, 1.0, 1), (1, 1, 9, 2.0, 1), (1, 2, 9, 5.0, 0), (1, 0, 8, -3.0, 1)],
        "doc_id bigint, pos int, token_id bigint, logit double, mask int",
    )
    rows = encode.max_pool_logits(logits).collect()
    assert [(r.token_id, r.weight) for r in rows] == [(9, pytest.approx(np.log(3.0)))]


def test_plugged_in_model(spark):
    class Counting:
        """A stand-in model: text length and letter counts."""

        def load(self):
            self.ready = True

        def encode(self, texts):
            assert self.ready
            dense = np.array([[len(t), 1.0] for t in texts])
            return dense, [{ord(c): float(t.count(c)) for c in set(t.strip())} for t in texts]

    papers = spark.createDataFrame([("1", "ab", None), ("2", " ", "")], "arxiv_id string, title string, abstract string")
    encoded = encode.encode_with(encode.encoder_input(papers, ""), Counting()).orderBy("arxiv_id").collect()
    assert [e.sparse_vector for e in encoded] == [{97: 1.0, 98: 1.0}, {}]
    assert encoded[0].dense_vector == pytest.approx([2 / np.sqrt(5), 1 / np.sqrt(5)])


def test_blank_text_encodes_to_nothing(spark):
    papers = spark.createDataFrame([("1", "", None), ("2", "Ünïted, ünïted!", "x")], "arxiv_id string, title string, abstract string")
    rows = {r.arxiv_id: r for r in encode.hash_encode_papers(papers, 8).collect()}
    assert rows["1"].sparse_vector == {} and set(rows["1"].dense_vector) == {0.0}
    assert sorted(rows["2"].sparse_vector.values()) == pytest.approx([np.log(2), np.log(3)])
    assert np.linalg.norm(rows["2"].dense_vector) == pytest.approx(1.0)


def test_window_pooling_covers_the_whole_text(spark):
    text = " ".join(f"w{i}" for i in range(1300))
    cut = encode.text_windows(spark.createDataFrame([("a", text), ("b", "")], "id string, t string"), "id", F.col("t"))
    assert {(r.id, r.window_no, len(r.window_text.split())) for r in cut.collect()} == {
        ("a", 0, 512), ("a", 1, 512), ("a", 2, 276), ("b", 0, 0),
    }
    pooling = encode.pool_windows(encode.hash_encode(cut, F.col("window_text"), 4), "id")
    assert pooling._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # encoded once
    pooled = pooling.collect()
    assert {r.id: len(r.sparse_vector) for r in pooled} == {"a": 1300, "b": 0}


def test_vector_expressions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(
        vec.dot(F.col("a"), F.col("b")).alias("dot"),
        vec.cosine(F.col("a"), F.col("b")).alias("cosine"),
        vec.cosine(F.col("a"), F.col("z")).alias("zero"),
        vec.euclidean(F.col("a"), F.col("b")).alias("distance"),
        vec.l2_normalise(F.col("a")).alias("unit"),
        vec.l2_normalise(F.col("z")).alias("same"),
        vec.scaled_cosine(F.lit(0.0)).alias("half"),
        vec.scaled_inner_product(F.lit(0.0)).alias("middle"),
    ).first()
    assert (row.dot, row.zero, row.half, row.middle) == (24.0, 0.0, 0.5, 0.5)
    assert row.cosine == pytest.approx(0.96) and row.distance == pytest.approx(2**0.5)
    assert row.unit == pytest.approx([0.6, 0.8]) and row.same == [0.0, 0.0]


def test_more_hits_than_any_cap(spark):
    papers = spark.range(17_000).select(
        F.col("id").cast("string").alias("arxiv_id"),
        F.lit(2000).alias("publication_year"),
        F.array(F.lit(1.0), F.col("id") / 17_000).cast("array<float>").alias("dense_vector"),
        F.create_map(F.lit(1).cast("bigint"), (F.col("id") + 1).cast("float")).alias("sparse_vector"),
    )
    asked = spark.createDataFrame(
        [(1, [0.0, 1.0], {1: 1.0}, 0.5)], "query_id bigint, dense_vector array<float>, sparse_vector map<bigint,float>, alpha double"
    )
    assert retrieve.hybrid_search(papers, asked, 16_900).count() == 16_900
    assert retrieve.hybrid_search(papers, asked, 100, candidates=50).count() == 50
