"""k-means, silhouette and cluster labels against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conceptstrata.operators import drift, kmeans, labels, silhouette
from conceptstrata.operators.distances import mean_silhouette, mean_silhouettes
from conceptstrata.plans import analysis

POINTS = "query_id bigint, point_id string, vector array<float>"


def blobs(centres, per_centre, seed=0, query_id=1):
    rng = np.random.default_rng(seed)
    data = np.concatenate([rng.normal(c, 0.3, (per_centre, len(c))) for c in np.array(centres, float)])
    return data, [(query_id, f"p{i:04d}", [float(x) for x in v]) for i, v in enumerate(data)]


def brute_silhouette(points, codes):
    scores = []
    for i, x in enumerate(points):
        mean = {}
        for c in set(codes):
            members = [j for j, d in enumerate(codes) if d == c and j != i]
            if members:
                mean[c] = np.mean([np.linalg.norm(x - points[j]) for j in members])
        if codes[i] not in mean:
            scores.append(0.0)
            continue
        a, b = mean[codes[i]], min(v for c, v in mean.items() if c != codes[i])
        scores.append((b - a) / max(a, b))
    return scores


def label_rows(spark, rows, codes, k):
    data = [(r[0], k, r[1], int(c)) for r, c in zip(rows, codes)]
    return spark.createDataFrame(data, "query_id bigint, k int, point_id string, cluster int")


def test_three_points_by_hand(spark):
    rows = [(1, "a", [0.0]), (1, "b", [1.0]), (1, "c", [4.0])]
    points = spark.createDataFrame(rows, POINTS)
    got = silhouette.point_silhouettes(points, label_rows(spark, rows, [0, 0, 1], 2)).collect()
    assert {r.point_id: r.silhouette for r in got} == pytest.approx({"a": 0.75, "b": 2 / 3, "c": 0.0})


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_blocks_equal_brute_force(spark, block_rows):
    data, rows = blobs([[0, 0, 0], [2, 0, 1], [0, 2, 2]], 15)
    rng = np.random.default_rng(5)
    codes = {3: rng.integers(0, 3, len(rows)), 2: rng.integers(0, 2, len(rows))}
    points = spark.createDataFrame(rows, POINTS)
    given = label_rows(spark, rows, codes[3], 3).unionByName(label_rows(spark, rows, codes[2], 2))
    got = silhouette.point_silhouettes(points, given, block_rows).collect()
    stored = np.array([r[2] for r in rows], dtype=np.float32).astype(float)
    for k in codes:
        want = brute_silhouette(stored, codes[k])
        mine = {r.point_id: r.silhouette for r in got if r.k == k}
        assert [mine[r[1]] for r in rows] == pytest.approx(want, abs=1e-6)
        assert mean_silhouette(stored, codes[k]) == pytest.approx(np.mean(want), abs=1e-6)


def test_rows_are_sent_to_few_blocks_and_come_back_as_one(spark):
    points = spark.range(4_000).selectExpr("1L AS query_id", "cast(id AS string) AS point_id", "array(0f, cast(id AS float)) AS vector")
    members = spark.createDataFrame([(1, 2, 0, 2_000), (1, 2, 1, 2_000)], "query_id bigint, k int, cluster int, n bigint")
    assert silhouette.block_counts(points, members, 50, 10).first()["_blocks"] == 10  # 55 pairs for 50 tasks, not 400 blocks
    assert silhouette.block_counts(points, members, 50, 1_000).first()["_blocks"] == 4

    def block(ids, clusters):
        return pa.table({"query_id": [1] * len(ids), "point_id": ids, "vector": [[float(c)] for c in clusters], "ks": [[2, 3]] * len(ids), "clusters": [[c % 2, c] for c in clusters]})

    sums = silhouette._distance_sums((1, 0, 1), block(["b", "a"], [2, 0]), block(["c", "d"], [1, 1])).to_pylist()
    assert [r["point_id"] for r in sums] == ["a", "b", "c", "d"]
    assert sums[0] == {"query_id": 1, "point_id": "a", "k": [2, 3], "own": [0, 0], "other": [1, 1], "distance": [2.0, 2.0]}
    assert sums[2] == {"query_id": 1, "point_id": "c", "k": [2, 3, 3], "own": [1, 1, 1], "other": [0, 0, 2], "distance": [2.0, 1.0, 1.0]}
    for lists in ([[1.0, 2.0], None], [[1.0], [1.0, 2.0, 3.0]]):  # four values, but not two a row
        with pytest.raises(ValueError):
            silhouette._matrix(pa.array(lists), 2)
    empty = block(["a"], [0]).slice(1)
    assert silhouette._distance_sums((1, 0, 1), empty, block(["c"], [1])).num_rows == 0


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_both_fits_recover_groups(spark):
    _, rows = blobs([[0, 0], [6, 0], [0, 6], [6, 6]], 30)
    truth = [i // 30 for i in range(120)]
    points = spark.createDataFrame(rows, POINTS)
    sets = spark.createDataFrame([(1, 4)], "query_id bigint, n_clusters int")
    inertia = {}
    for name, fitted in (
        ("grouped", kmeans.fit_bounded(points, silhouette.k_candidates(sets))),
        ("distributed", kmeans.fit_distributed(points, {1: [4]}, restarts=10)),
    ):
        got = {r.point_id: (r.cluster, r.inertia) for r in fitted.collect()}
        assert same_partition([got[r[1]][0] for r in rows], truth), name
        inertia[name] = got[rows[0][1]][1]
    assert inertia["grouped"] == pytest.approx(inertia["distributed"])


def test_large_sets_take_the_distributed_way(spark, monkeypatch):
    _, rows = blobs([[0, 0], [6, 0]], 40)
    _, more = blobs([[0, 0], [6, 0], [0, 6]], 4, query_id=2)
    _, third = blobs([[0, 0], [6, 0], [0, 6]], 30, query_id=3)
    points = spark.createDataFrame(rows + more + third, POINTS)
    sets = spark.createDataFrame([(1, 2), (2, 3), (3, 3)], "query_id bigint, n_clusters int")
    monkeypatch.setattr(kmeans, "GROUPED_ROWS", 50)
    large, whole = [], kmeans.fit_distributed
    monkeypatch.setattr(kmeans, "fit_distributed", lambda rows, ks: large.extend(ks) or whole(rows, ks))
    fitted = kmeans.fit(points, silhouette.k_candidates(sets)).collect()
    assert len(fitted) == 182
    assert sorted(large) == [1, 3] and all(r.silhouette is None for r in fitted)  # k is given: none is needed
    for query_id, size in ((1, 40), (2, 4), (3, 30)):
        codes = [r.cluster for r in sorted(fitted, key=lambda r: r.point_id) if r.query_id == query_id]
        assert same_partition(codes, [i // size for i in range(len(codes))])


@pytest.mark.parametrize("row_limit", [None, 200])
def test_automatic_k(spark, row_limit):
    _, rows = blobs([[0, 0], [8, 0], [0, 8]], 20)
    _, more = blobs([[0, 0], [8, 0], [0, 8], [8, 8], [4, 20]], 12, seed=3, query_id=2)
    points = spark.createDataFrame(rows + more, POINTS).select(
        "query_id", F.col("point_id").alias("arxiv_id"), F.col("vector").alias("dense_vector")
    )
    queries = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    got = analysis.cluster_concepts(points, queries, row_limit).select("query_id", "k").distinct().collect()
    assert {(r.query_id, r.k) for r in got} == {(1, 3), (2, 5)}


def test_k_beyond_block_rows_uses_blocks(spark, monkeypatch):
    _, rows = blobs([[0, 0], [8, 0], [0, 8]], 20)
    points = spark.createDataFrame(rows, POINTS)
    fitted = kmeans.fit_bounded(
        points, silhouette.k_candidates(spark.createDataFrame([(1, None)], "query_id bigint, n_clusters int"))
    ).persist()
    blind = fitted.withColumn("silhouette", F.lit(None).cast("double"))
    seen, computed = (analysis.choose_k(points, f).first() for f in (fitted, blind))
    assert (seen.k, seen.silhouette) == (computed.k, pytest.approx(computed.silhouette))


def test_small_sets(spark):
    rows = [(1, "a", [0.0]), (1, "b", [1.0]), (2, "c", [0.0]), (3, "d", [0.0]), (3, "e", [1.0]), (3, "f", [5.0])]
    points = spark.createDataFrame(rows, POINTS).select(
        "query_id", F.col("point_id").alias("arxiv_id"), F.col("vector").alias("dense_vector")
    )
    # Two points: k = 2. One point: too few, no clusters. Three points: only k = 2 is tried.
    queries = spark.createDataFrame([(1, None), (2, None), (3, None)], "query_id bigint, n_clusters int")
    got = analysis.cluster_concepts(points, queries, 10).collect()
    assert sorted((r.query_id, r.k, r.point_id) for r in got) == [
        (1, 2, "a"), (1, 2, "b"), (3, 2, "d"), (3, 2, "e"), (3, 2, "f"),
    ]
    # A given k above the number of points leaves the set unclustered; a given k < 2 means automatic.
    queries = spark.createDataFrame([(1, 3), (2, 1), (3, 3)], "query_id bigint, n_clusters int")
    got = analysis.cluster_concepts(points, queries, 10).collect()
    assert {(r.query_id, r.k) for r in got} == {(3, 3)}


def test_linear_measure_is_marked(spark):
    _, rows = blobs([[0, 0], [8, 0]], 20)
    points = spark.createDataFrame(rows, POINTS)
    given = label_rows(spark, rows, [i // 20 for i in range(40)], 2)
    row = silhouette.silhouette_large(points, given).first()
    assert row.measure == "squared" and row.silhouette > 0.9


def test_label_keeps_order_and_drops_pieces_after_the_cut(spark):
    weights = spark.createDataFrame(
        [(1, 0, t, w) for t, w in ((1, 5.0), (2, 4.0), (3, 4.0), (4, 2.0), (5, 1.5), (6, 1.0))]
        + [(1, 1, 4, 1.0)]
        + [(1, 0, 6, 0.1)],
        "query_id bigint, cluster int, token_id bigint, weight double",
    )
    vocabulary = spark.createDataFrame(
        [(1, "graph"), (2, "node"), (3, "edge"), (4, "##ing"), (5, "path"), (6, "cut")], "token_id bigint, token string"
    )
    got = {r.cluster: r.label for r in labels.cluster_labels(weights, vocabulary).collect()}
    assert got == {0: "graph, node, edge, path", 1: ""}
    stop = spark.createDataFrame([(1, "graphs")], "query_id bigint, token string")
    got = {r.cluster: r.label for r in labels.cluster_labels(weights, vocabulary, stop=stop).collect()}
    assert got == {0: "node, edge, path, cut", 1: ""}


def test_coarse_to_fine(spark):
    _, rows = blobs([[0, 0, 0], [4, 0, 0], [40, 0, 0], [44, 0, 0]], 15)
    points = spark.createDataFrame(rows, POINTS).select("point_id", "vector")
    got = {r.point_id: (r.cell, r.cluster) for r in kmeans.coarse_to_fine(points, 2, 2, dims=1).collect()}
    assert same_partition([got[r[1]] for r in rows], [i // 15 for i in range(60)])
    assert len({cell for cell, _ in got.values()}) == 2


def test_distributed_fit_is_a_fixed_point(spark):
    data, rows = blobs([[0, 0], [1, 0], [0, 1]], 60, seed=9)
    points = spark.createDataFrame(rows, POINTS).repartition(6)
    fitted = {r.point_id: (r.cluster, r.inertia) for r in kmeans.fit_distributed(points, {1: [3]}).collect()}
    codes = np.array([fitted[r[1]][0] for r in rows])
    stored = np.array([r[2] for r in rows], dtype=np.float32).astype(float)
    centres = np.array([stored[codes == c].mean(axis=0) for c in range(3)])
    squared = ((stored[:, None] - centres) ** 2).sum(axis=2)
    assert (squared.argmin(axis=1) == codes).mean() > 0.97
    assert squared[np.arange(len(codes)), codes].sum() == pytest.approx(fitted[rows[0][1]][1], rel=0.02)


def test_trajectory_of_a_straight_line(spark):
    centres = spark.createDataFrame(
        [(1, 1990 + 10 * i, [float(i), 2.0 * i, 0.0], 5) for i in range(4)],
        "query_id bigint, slice int, centroid array<double>, n bigint",
    )
    rows = drift.trajectory(centres).orderBy("slice").collect()
    steps = np.diff([r.x for r in rows])
    assert np.allclose(np.abs(steps), 5**0.5) and len(set(np.sign(steps))) == 1
    assert np.allclose(np.diff([r.y for r in rows]), 0.0)


def test_drift_and_spread(spark):
    rows = [(1, 1990, [1.0, 0.0]), (1, 1990, [3.0, 0.0]), (1, 2000, [0.0, 1.0]), (1, 2010, [0.0, 5.0])]
    points = spark.createDataFrame(rows, "query_id bigint, slice int, dense_vector array<double>")
    centres = drift.centroids(points, ["query_id", "slice"])
    moved = {r.slice: r.drift for r in drift.adjacent_drift(centres).collect()}
    assert moved == {1990: None, 2000: pytest.approx(1.0), 2010: pytest.approx(0.0)}
    spread = {r.slice: r.spread for r in drift.spread(points, centres, ["query_id", "slice"]).collect()}
    assert spread == {1990: pytest.approx(1.0), 2000: 0.0, 2010: 0.0}


def test_both_ways_of_fitting_agree(spark):
    _, rows = blobs([[0, 0], [9, 0], [0, 9], [9, 9], [20, 5], [5, 20]], 420)  # above the rows that starts come from
    points = spark.createDataFrame(rows, POINTS)
    sets = spark.createDataFrame([(1, 6)], "query_id bigint, n_clusters int")
    grouped = kmeans.fit_bounded(points, silhouette.k_candidates(sets), restarts=2).collect()
    distributed = kmeans.fit_distributed(points, {1: [6]}, restarts=2).collect()
    assert {r.point_id: r.cluster for r in grouped} == {r.point_id: r.cluster for r in distributed}


def test_no_k_is_dropped_for_its_size(spark):
    rng = np.random.default_rng(6)
    points = spark.createDataFrame([(1, f"p{i}", rng.normal(size=2).tolist()) for i in range(2_600)], POINTS)
    fitted = kmeans.fit_distributed(points, {1: [2_001]}, restarts=1, max_iterations=2)
    assert fitted.count() == 2_600
    assert fitted.select("cluster").distinct().count() > 1_500


def test_measure_is_the_callers_choice(spark):
    _, rows = blobs([[0, 0], [8, 0], [0, 8]], 20)
    points = spark.createDataFrame(rows, POINTS)
    sets = spark.createDataFrame([(1, None)], "query_id bigint, n_clusters int")
    fitted = kmeans.fit_bounded(points, silhouette.k_candidates(sets)).persist()
    for measure in silhouette.MEASURES:
        assert [(r.k, r.measure) for r in analysis.choose_k(points, fitted, measure=measure).collect()] == [(3, measure)]
    with pytest.raises(ValueError):
        analysis.choose_k(points, fitted, measure="other")


@pytest.mark.parametrize("k", [1, 6, 40])
def test_starts_come_from_all_rows_either_way(spark, k):
    rng = np.random.default_rng(8)
    rows = [(1, f"p{i:04d}", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(900, 5)))]
    rows += [(1, f"q{i}", rows[0][2]) for i in range(30)]  # copies
    points = spark.createDataFrame(rows, POINTS).withColumn("_h", F.xxhash64(F.lit(42), "point_id")).repartition(7)
    spread = kmeans._initial_models(points, {1: [k]}, restarts=3)[1, k]
    own = points.toPandas().sort_values("point_id")
    vectors = np.array(own["vector"].tolist(), dtype=np.float64)
    together = kmeans._starts(vectors, own["_h"].to_numpy(np.int64), k, 3)
    assert np.array_equal(spread, together) and len(np.unique(together[0], axis=0)) == k
    assert len({tuple(c) for c in together[:, 0]}) == 3  # restarts differ


def test_a_tiny_far_group_is_found(spark):
    """Five rows of 20,005: drawn as a start, since starts come from all rows by their distance."""
    rng = np.random.default_rng(1)
    far = [(1, f"far{i}", [300.0 + i / 10, 300.0]) for i in range(5)]
    points = spark.createDataFrame([(1, f"p{i:05d}", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(20_000, 2)))] + far, POINTS)
    fitted = {r.point_id: r.cluster for r in kmeans.fit_distributed(points, {1: [2]}, restarts=2).collect()}
    found = {fitted[f"far{i}"] for i in range(5)}
    assert len(found) == 1 and sum(c in found for c in fitted.values()) == 5


def test_starts_of_equal_rows():
    points = np.ones((4, 3))
    starts = kmeans._starts(points, np.arange(4), 3, 2)
    assert starts.shape == (2, 3, 3) and (starts == 1).all()


def test_all_labellings_from_one_distance_matrix(monkeypatch):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(41, 4))
    labellings = [rng.integers(0, k, 41) for k in (1, 2, 3, 5)] + [np.arange(41)]
    want = [np.mean(brute_silhouette(points, own)) if len(set(own)) > 1 else 0.0 for own in labellings]
    for rows in (3, 9, 100):
        monkeypatch.setattr("conceptstrata.operators.distances.BLOCK_ROWS", rows)
        assert mean_silhouettes(points, labellings) == pytest.approx(want)


def test_no_silhouette_where_k_is_given(spark):
    _, rows = blobs([[0, 0], [8, 0]], 10)
    _, more = blobs([[0, 0], [8, 0]], 10, query_id=2)
    points = spark.createDataFrame(rows + more, POINTS)
    sets = spark.createDataFrame([(1, 2), (2, None)], "query_id bigint, n_clusters int")
    fitted = kmeans.fit_bounded(points, silhouette.k_candidates(sets)).collect()
    assert {(r.query_id, r.k, r.silhouette is None) for r in fitted} == {(1, 2, True)} | {(2, k, False) for k in range(2, 9)}
    few = kmeans.fit_bounded(points, silhouette.k_candidates(sets.where("query_id = 9")))
    assert few.collect() == []


def test_stop_words_need_the_vocabulary_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(token):
        read.add(1)
        return token

    vocabulary = spark.createDataFrame([(1, "entropy"), (2, "heat"), (3, "gas")], "token_id bigint, token string").withColumn("token", seen("token"))
    weights = spark.createDataFrame([(1, 0, t, w) for t, w in ((1, 3.0), (2, 2.0), (3, 1.0))], "query_id bigint, cluster int, token_id bigint, weight double")
    stop = spark.createDataFrame([(1, "entropic")], "query_id bigint, token string")
    assert [r.label for r in labels.cluster_labels(weights, vocabulary, stop=stop).collect()] == ["heat, gas"]
    assert read.value == 3
