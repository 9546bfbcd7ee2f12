"""k-means for many concept sets, cluster counts and restarts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptstrata.operators.distances import INLINE_ROWS, mean_silhouettes
from conceptstrata.operators.ranking import broadcast_checked, top_k
from conceptstrata.session import task_count

SEED = 42
RESTARTS = 10
# Above this many rows a set is fitted over the whole cluster, from the same starts.
GROUPED_ROWS = 10_000
MAX_ITERATIONS = 300
PASSES = 16  # over the points, to draw the starting centres
TOGETHER = 128  # centres whose distances to all rows are held at once while drawing
TOLERANCE = 1e-4
# Centres that travel with one pass of a distributed fit
MODEL_BYTES = 64 << 20

_FIT = "query_id bigint, k int, point_id string, cluster int, inertia double, silhouette double"
_NO_FIT = pa.table(
    {
        name: pa.array([], kind)
        for name, kind in zip(
            ("query_id", "k", "point_id", "cluster", "inertia", "silhouette"),
            (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64()),
            strict=True,
        )
    }
)
_WORD = (1 << 64) - 1
_LAST = 1e300  # draw of a row that has a chosen copy


def _races(hashes: np.ndarray, restart: int, step: int) -> np.ndarray:
    """Exponential draws of the rows, from their hashes alone: the same wherever and however often they are made.

    The row with the smallest draw divided by its weight is a random row, with odds in proportion to the weights.
    """
    with np.errstate(over="ignore"):
        mixed = hashes.astype(np.uint64) + np.uint64((restart * 65_537 + step + 1) & _WORD) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
    return -np.log((mixed.astype(np.float64) + 1.0) / 2.0**64)


def _next_starts(points: np.ndarray, hashes: np.ndarray, chosen: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The `width` rows that each restart draws next, best first, and their draws (restarts, width).

    Odds are squared distances to the chosen ones (restarts, steps, dims). Rows that are copies of chosen ones come last.
    """
    restarts, step = chosen.shape[:2]
    width = min(width, len(points))
    rows, draws = np.empty((restarts, width), np.int64), np.empty((restarts, width))
    together = restarts if restarts * step <= TOGETHER else 1  # restarts measured at once
    for r in range(restarts):
        race = _races(hashes, r, step)
        if step and r % together == 0:
            nearest = _squares(points, chosen[r : r + together]).min(axis=2)
        weight = nearest[:, r % together] if step else np.ones(len(points))
        with np.errstate(divide="ignore"):
            draw = np.where(weight > 0, race / weight, _LAST * (1.0 + race))
        likely = np.argpartition(draw, width - 1)[:width]
        rows[r] = likely[np.lexsort((likely, draw[likely]))]
        draws[r] = draw[rows[r]]
    return rows, draws


def _width(k: int) -> int:
    """Rows drawn at once: one by one up to PASSES centres, in as many rounds beyond."""
    return -(-k // PASSES)


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (points, models, k) to centres (models, k, dims); those within rounding count as 0."""
    models, k, dims = centres.shape
    flat = centres.reshape(models * k, dims)
    own = (points**2).sum(axis=1, keepdims=True)
    distances = (flat**2).sum(axis=1) - 2.0 * (points @ flat.T) + own
    return np.where(distances > 1e-12 * (own + 1e-300), distances, 0.0).reshape(len(points), models, k)


def _starts(points: np.ndarray, hashes: np.ndarray, k: int, restarts: int) -> np.ndarray:
    """Starting centres of all restarts, drawn from all rows by k-means++. The same for every way of fitting."""
    chosen = np.empty((restarts, 0, points.shape[1]))
    while chosen.shape[1] < k:
        rows, _draws = _next_starts(points, hashes, chosen, _width(k))
        chosen = np.concatenate([chosen, points[rows]], axis=1)
    return chosen[:, :k].copy()


def _assign(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre and squared distance to it; centres is (models, k, dims)."""
    models, k, dims = centres.shape
    flat = centres.reshape(models * k, dims)
    distances = (flat**2).sum(axis=1) - 2.0 * (points @ flat.T) + (points**2).sum(axis=1, keepdims=True)
    distances = np.maximum(distances, 0.0).reshape(len(points), models, k)
    nearest = distances.argmin(axis=2)
    return nearest, np.take_along_axis(distances, nearest[:, :, None], axis=2)[:, :, 0]


def _totals(points: np.ndarray, nearest: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Member count and vector sum of every cluster of every model."""
    models = nearest.shape[1]
    member = np.zeros((len(points), models * k))
    member[np.arange(len(points))[:, None], nearest + np.arange(models) * k] = 1.0
    return member.sum(axis=0).reshape(models, k), (member.T @ points).reshape(models, k, -1)


def _moved(centres: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New centres (an empty cluster keeps its own) and the squared shift per model."""
    new = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1.0)[:, :, None], centres)
    return new, ((new - centres) ** 2).sum(axis=(1, 2))


def _fit_set(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, float]:
    """All restarts for one set, from their starting centres; labels and inertia of the restart with least inertia."""
    restarts, k, _ = centres.shape
    tolerance = TOLERANCE * points.var(axis=0, ddof=1).mean()
    active = np.arange(restarts)
    for _ in range(MAX_ITERATIONS):
        nearest, _squared = _assign(points, centres[active])
        centres[active], shift = _moved(centres[active], *_totals(points, nearest, k))
        active = active[shift > tolerance]
        if not len(active):
            break
    nearest, squared = _assign(points, centres)
    inertia = squared.sum(axis=0)
    best = int(inertia.argmin())
    return nearest[:, best], float(inertia[best])


def _fit_group(table: pa.Table, restarts: int) -> pa.Table:
    """Some k of one set: the distances between its rows, which the silhouettes need, are measured once for all of them."""
    table = table.combine_chunks().sort_by("point_id")
    n = table.num_rows
    points = table["vector"].combine_chunks().flatten().to_numpy().reshape(n, -1).astype(np.float64)
    automatic = table["automatic"][0].as_py()
    usable = min(max(2, n - 1), n) if automatic else n
    ks = [k for k in table["ks"][0].as_py() if k <= usable]
    # Centres drawn one by one are the first ones of a larger k.
    widest = {_width(k): k for k in ks}
    drawn = {width: _starts(points, table["_h"].to_numpy(), k, restarts) for width, k in widest.items()}
    fits = [_fit_set(points, drawn[_width(k)][:, :k].copy()) for k in ks]
    # Only a choice between several needs a silhouette.
    scored = automatic and ks and n <= INLINE_ROWS
    scores = mean_silhouettes(points, [labels for labels, _ in fits]) if scored else [None] * len(ks)
    ids, query = table["point_id"].combine_chunks(), table["query_id"].combine_chunks()
    parts = [
        pa.table(
            {
                "query_id": query,
                "k": pa.array(np.full(n, k, np.int32)),
                "point_id": ids,
                "cluster": pa.array(labels.astype(np.int32)),
                "inertia": pa.array(np.full(n, inertia)),
                "silhouette": pa.array([score] * n, pa.float64()),
            }
        )
        for k, (labels, inertia), score in zip(ks, fits, scores, strict=True)
    ]
    return pa.concat_tables(parts) if parts else _NO_FIT


def fit_bounded(points: DataFrame, candidates: DataFrame, restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """Labels per (query_id, k, point_id) for sets known to be small.

    points: query_id, point_id, vector, with at most GROUPED_ROWS rows per query_id; candidates:
    query_id, k, automatic. With many sets a task fits one of them for all k, so that its rows move and its distances are
    measured once; with few the k are dealt to more tasks, until there are two for each core. Sets of up to
    INLINE_ROWS rows get their mean silhouette on the spot where k is to be chosen, others null.
    """
    spark = points.sparkSession
    asked = candidates.persist()
    sets = asked.select("query_id").distinct().count()
    shares = max(1, -(-2 * spark.sparkContext.defaultParallelism // max(1, sets)))
    dealt = asked.groupBy("query_id", "automatic", (F.col("k") % shares).alias("_share")).agg(F.sort_array(F.collect_set("k")).alias("ks"))
    return (
        points.select("query_id", F.col("point_id").cast("string").alias("point_id"), "vector")
        .withColumn("_h", F.xxhash64(F.lit(seed), "point_id"))
        .join(broadcast_checked(dealt), "query_id")
        .repartition(task_count(spark), "query_id", "_share")
        .groupBy("query_id", "_share", "automatic")
        .applyInArrow(lambda table: _fit_group(table, restarts), _FIT)
    )


def _initial_models(points: DataFrame, ks: dict[int, list[int]], restarts: int) -> dict[tuple[int, int], np.ndarray]:
    """k-means++ centres of every set and k that it has rows for, drawn from all rows.

    A pass over the points draws the next centres of all sets and restarts: each task hands on its best rows, and the
    best of these are they. Centres drawn one by one for a small k are the first ones of a larger.
    """
    sizes = {r.query_id: r["count"] for r in points.groupBy("query_id").count().where(F.col("query_id").isin(*ks)).collect()}  # one row per set
    ks = {q: [k for k in own if k <= sizes.get(q, 0)] for q, own in ks.items()}
    most: dict[tuple[int, int], int] = {}  # (set, rows drawn at once) -> centres wanted
    for q, own in ks.items():
        for k in own:
            most[q, _width(k)] = max(k, most.get((q, _width(k)), 0))
    dims = len(points.first()["vector"]) if most else 0
    chosen = {key: np.empty((restarts, 0, dims)) for key in most}
    while True:
        open_sets = {key: chosen[key] for key, n in most.items() if chosen[key].shape[1] < n}
        if not open_sets:
            return {(q, k): chosen[q, _width(k)][:, :k].copy() for q, own in ks.items() for k in own}
        widest = max(width for _, width in open_sets)
        best = top_k(_drawn(points, open_sets), ["query_id", "width", "restart"], [F.col("draw"), F.col("point_id")], widest)
        new: dict[tuple[int, int], list] = {}
        for r in best.where(F.col("rank") <= F.col("width")).orderBy("query_id", "width", "restart", "rank").collect():
            new.setdefault((r.query_id, r.width), []).append(r.vector)
        for key, rows in new.items():
            chosen[key] = np.concatenate([chosen[key], np.array(rows, dtype=np.float64).reshape(restarts, -1, dims)], axis=1)


def _drawn(points: DataFrame, chosen: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """(query_id, width, restart, draw, point_id, vector): the best `width` rows of every task and restart."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int, int], list[tuple[float, str, np.ndarray]]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            query, hashes = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            vectors = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
            for (q, width), before in chosen.items():
                rows = np.flatnonzero(query == q)
                if not len(rows):
                    continue
                found, draws = _next_starts(vectors[rows], hashes[rows], before, width)
                for r in range(len(before)):
                    new = [(float(d), ids[i], vectors[i]) for i, d in zip(rows[found[r]], draws[r], strict=True)]
                    held = best.get((q, width, r), []) + new
                    best[q, width, r] = sorted(held, key=lambda b: b[:2])[:width]
        for (q, width, r), held in best.items():
            n = len(held)
            columns = [
                pa.array(np.full(n, q, np.int64)),
                pa.array(np.full(n, width, np.int32)),
                pa.array(np.full(n, r, np.int32)),
                pa.array([b[0] for b in held], pa.float64()),
                pa.array([b[1] for b in held], pa.string()),
                pa.array([b[2].tolist() for b in held], pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "width", "restart", "draw", "point_id", "vector"])

    schema = "query_id bigint, width int, restart int, draw double, point_id string, vector array<double>"
    return points.select("query_id", "point_id", "vector", "_h").mapInArrow(draw, schema)


def models_of(centres: pd.DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """{(query_id, k): (restarts, k, dims)} from one row per centre."""
    ordered = centres.sort_values(["query_id", "k", "restart", "cluster"])
    return {
        (int(q), int(k)): np.array(part["centre"].tolist()).reshape(part["restart"].nunique(), int(k), -1)
        for (q, k), part in ordered.groupby(["query_id", "k"])
    }


def _over_points(per_query: Callable) -> Callable:
    """mapInArrow body that hands each query's rows of a batch to `per_query(query_id, ids, vectors)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            query = batch.column(0).to_numpy()
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            vectors = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
            for query_id in np.unique(query):
                rows = np.flatnonzero(query == query_id)
                yield from per_query(int(query_id), ids[rows], vectors[rows])

    return run


def lloyd_totals(points: DataFrame, models: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """One assignment pass of every model over every point: count, sum and inertia per centre.

    The points are read in place; a task sums its own members before the shuffle, and the sums of the
    tasks are added on the JVM side.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}

        def per_query(query_id: int, _ids: np.ndarray, vectors: np.ndarray):
            for (q, k), centres in models.items():
                if q == query_id:
                    nearest, squared = _assign(vectors, centres)
                    counts, sums = _totals(vectors, nearest, k)
                    inertia = np.zeros_like(counts)
                    inertia[:, 0] = squared.sum(axis=0)
                    new = [counts, sums, inertia]
                    old = held.get((q, k))
                    held[(q, k)] = new if old is None else [a + b for a, b in zip(old, new)]
            return ()

        for _ in _over_points(per_query)(batches):
            pass
        for (q, k), (counts, sums, inertia) in held.items():
            restarts, _, dims = sums.shape
            slot = np.arange(restarts * k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(slot), q, dtype=np.int64)),
                    pa.array(np.full(len(slot), k, dtype=np.int32)),
                    pa.array((slot // k).astype(np.int32)),
                    pa.array((slot % k).astype(np.int32)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(0, len(slot) * (dims + 2) + 1, dims + 2, dtype=np.int32)),
                        pa.array(
                            np.concatenate([counts[:, :, None], inertia[:, :, None], sums], axis=2).ravel()
                        ),
                    ),
                ],
                names=["query_id", "k", "restart", "cluster", "parts"],
            )

    parts = points.select("query_id", "point_id", "vector").mapInArrow(
        tally, "query_id bigint, k int, restart int, cluster int, parts array<double>"
    )
    total = vector_to_array(Summarizer.sum(array_to_vector("parts")))
    return (
        parts.groupBy("query_id", "k", "restart", "cluster")
        .agg(total.alias("parts"))
        .select(
            "query_id",
            "k",
            "restart",
            "cluster",
            F.col("parts")[0].cast("bigint").alias("n"),
            F.col("parts")[1].alias("inertia"),
            F.slice("parts", 3, F.size("parts") - 2).alias("vector_sum"),
        )
    )


def fit_distributed(
    points: DataFrame,
    ks: dict[int, list[int]],
    restarts: int = RESTARTS,
    seed: int = SEED,
    max_iterations: int = MAX_ITERATIONS,
    starts: dict[tuple[int, int], np.ndarray] | None = None,
) -> DataFrame:
    """Labels per (query_id, k, point_id) for sets of any size; `ks` lists the counts per query_id.

    `starts` gives the centres to begin with, (restarts, k, dims) per (query_id, k); otherwise they are drawn.

    Lloyd's algorithm as one Spark job per iteration: a single pass over the cached points moves the
    centres of all sets, cluster counts and restarts. Only centres (sets x k x restarts x dims) travel
    through the driver, never points.
    """
    points = points.select("query_id", F.col("point_id").cast("string").alias("point_id"), "vector")
    points = points.withColumn("_h", F.xxhash64(F.lit(seed), "point_id")).persist()
    variance = Summarizer.variance(array_to_vector("vector"))
    spread = points.groupBy("query_id").agg(vector_to_array(variance).alias("v"))
    tolerance = {int(r.query_id): TOLERANCE * float(np.nanmean(r.v)) for r in spread.toLocalIterator()}

    models = {key: c.copy() for key, c in starts.items()} if starts else _initial_models(points, ks, restarts)
    active = {key: np.arange(len(c)) for key, c in models.items()}
    for _ in range(max_iterations):
        moving = {key: models[key][rows] for key, rows in active.items() if len(rows)}
        if not moving:
            break
        totals = lloyd_totals(points, moving).toPandas()
        for (q, k), part in totals.groupby(["query_id", "k"]):
            key = (int(q), int(k))
            part = part.sort_values(["restart", "cluster"])
            shape = moving[key].shape
            counts = part["n"].to_numpy(float).reshape(shape[:2])
            sums = np.array(part["vector_sum"].tolist()).reshape(shape)
            rows = active[key]
            models[key][rows], shift = _moved(moving[key], counts, sums)
            active[key] = rows[shift > tolerance[key[0]]]

    inertia = lloyd_totals(points, models).groupBy("query_id", "k", "restart").agg(F.sum("inertia").alias("inertia"))
    best = {}
    for r in inertia.orderBy(F.desc("inertia"), F.desc("restart")).collect():  # one row per model
        best[(int(r.query_id), int(r.k))] = (models[(int(r.query_id), int(r.k))][r.restart], float(r.inertia))
    return label_points(points, best)


def label_points(points: DataFrame, best: dict[tuple[int, int], tuple[np.ndarray, float]]) -> DataFrame:
    """Nearest centre of every point under one chosen model per (query_id, k)."""

    def per_query(query_id: int, ids: np.ndarray, vectors: np.ndarray):
        for (q, k), (centres, inertia) in best.items():
            if q == query_id:
                nearest, _squared = _assign(vectors, centres[None])
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, q, dtype=np.int64)),
                        pa.array(np.full(n, k, dtype=np.int32)),
                        pa.array(ids, pa.string()),
                        pa.array(nearest[:, 0].astype(np.int32)),
                        pa.array(np.full(n, inertia)),
                        pa.nulls(n, pa.float64()),
                    ],
                    names=["query_id", "k", "point_id", "cluster", "inertia", "silhouette"],
                )

    return points.select("query_id", "point_id", "vector").mapInArrow(_over_points(per_query), _FIT)


def fit(points: DataFrame, candidates: DataFrame, row_limit: int | None = None) -> DataFrame:
    """Labels per (query_id, k, point_id), by the way that suits the size of every set.

    `row_limit` is an upper bound of the set sizes the caller can vouch for (a search limit); without
    it the sets are counted.
    """
    if row_limit is not None and row_limit <= GROUPED_ROWS:
        return fit_bounded(points, candidates)
    sizes = points.groupBy("query_id").count()
    large = [r.query_id for r in sizes.where(F.col("count") > GROUPED_ROWS).select("query_id").toLocalIterator()]
    if not large:
        return fit_bounded(points, candidates)
    small = ~F.col("query_id").isin(*large)
    labels = fit_bounded(points.where(small), candidates.where(small))
    ks: dict[int, list[int]] = {query_id: [] for query_id in large}
    for r in candidates.where(~small).select("query_id", "k").distinct().orderBy("query_id", "k").toLocalIterator():
        ks[r.query_id].append(r.k)
    dims = len(points.select("vector").first()["vector"])
    # As many sets per pass as their centres leave room for.
    batch: dict[int, list[int]] = {}
    for query_id in large:
        batch[query_id] = ks[query_id]
        if query_id == large[-1] or sum(map(sum, batch.values())) * RESTARTS * dims * 8 > MODEL_BYTES:
            mine = points.where(F.col("query_id").isin(*batch))
            labels = labels.unionByName(fit_distributed(mine, batch))
            batch = {}
    return labels


def coarse_to_fine(points: DataFrame, coarse_k: int, fine_k: int, dims: int = 64, seed: int = SEED) -> DataFrame:
    """Two-level clusters: k-means on PCA-reduced vectors, then on the full vectors of every cell.

    points: point_id, vector. Adds `cell` and `cluster` (numbered within the cell).
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA

    features = points.withColumn("_features", array_to_vector("vector"))
    reduced = PCA(k=dims, inputCol="_features", outputCol="_reduced").fit(features).transform(features)
    cells = (
        KMeans(k=coarse_k, seed=seed, featuresCol="_reduced", predictionCol="cell")
        .fit(reduced)
        .transform(reduced)
        .select(F.col("cell").cast("bigint").alias("query_id"), F.col("point_id").cast("string"), "vector")
        .persist()
    )
    sizes = cells.groupBy("query_id").count().select(
        "query_id", F.least("count", F.lit(fine_k)).cast("int").alias("k"), F.lit(False).alias("automatic")
    )
    return fit(cells, sizes).select(F.col("query_id").cast("int").alias("cell"), "point_id", "cluster")

