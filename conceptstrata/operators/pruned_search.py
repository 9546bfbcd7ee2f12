"""Exact top-k search that reads only what can still matter.

`PostingBlocks` keeps the postings of a token, in each segment of papers, by falling weight in blocks with their largest
weight. A query first reads the heads of its lists; the k-th best sum of these is a score that the k-th best paper reaches
at least. Every paper above it has one token that contributes that score divided by the number of tokens, so only blocks
whose largest weight allows as much are read, and only papers whose sum, plus what the unread blocks of their other tokens
could add, reaches the new k-th best sum are scored in full. Blocks are read once for all queries, segment by segment, and
a task hands on only the papers that may be among the k best.

`VectorCells` keeps vectors by their nearest centre, with the largest angle to it. A vector of a cell is at most as near
to a query as the angle between query and centre less that radius allows (triangle inequality). A query first reads its
likeliest cells; its k-th best score there rules out all cells that cannot reach it.

Both give the same hits as a scan. `counts` tells how much of the data a search read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from conceptstrata.operators.lookup import joined_by_key
from conceptstrata.operators.posting_segments import SEGMENT_ROWS, SEGMENTS, SLACK, AskedTokens, cut_segments
from conceptstrata.operators.ranking import BROADCAST_ROWS, broadcast_checked, top_k
from conceptstrata.operators.retrieve import HELD_ROWS, QUERY_ROWS, DenseBlock, HITS, best_first, with_years
from conceptstrata.session import cut_lineage, task_count

BLOCK_ROWS = 512
CELLS = 256
SAMPLE_ROWS = 50_000  # vectors, in the mean, that the centres are fitted to; all are assigned


class PostingBlocks:
    """Postings (token_id, weight, arxiv_id, publication_year) with positive weights, written in blocks.

    Nothing is shuffled: the postings are cut where they lie into segments of whole papers (`posting_segments`). Postings
    made from vectors lie paper by paper; ids of which several segments have postings, that come with several years or have a
    token more than once, are found by counting. These are scored from all their postings, as one paper an id and year.
    """

    def __init__(self, postings: DataFrame, block_rows: int = BLOCK_ROWS, segment_rows: int = SEGMENT_ROWS):
        rows = postings.select(
            "token_id", F.col("weight").cast("double").alias("weight"), "arxiv_id", F.col("publication_year").cast("int").alias("year")
        ).where(F.col("token_id").isNotNull() & F.col("weight").isNotNull() & F.col("year").isNotNull())
        written = cut_lineage(rows.mapInArrow(lambda batches: cut_segments(batches, block_rows, segment_rows), SEGMENTS), "posting-blocks")
        self.blocks = written.where(F.col("token_id").isNotNull()).select("segment", "token_id", "at", "top", "n", "papers", "weights")
        lists = written.where(F.col("token_id").isNull()).select("segment", "at", F.posexplode(F.arrays_zip("arxiv_id", "year", "repeats")).alias("i", "p"))
        papers = lists.select("segment", (F.col("at") + F.col("i")).alias("at"), "p.arxiv_id", "p.year", "p.repeats")
        loose = papers.groupBy(F.col("arxiv_id").alias("_id")).agg(F.count("*").alias("n"), F.max("repeats").alias("again"))
        loose = loose.where((F.col("n") > 1) | F.col("again") | F.col("_id").isNull()).withColumn("_loose", F.lit(True))
        marked = papers.join(broadcast_checked(loose), F.col("arxiv_id").eqNullSafe(F.col("_id")), "left")
        self.papers = cut_lineage(marked.select("segment", "at", "arxiv_id", "year", F.coalesce("_loose", F.lit(False)).alias("loose")), "posting-papers")
        self.loose = not self.papers.where("loose").isEmpty()

    def _sums(self, read: DataFrame, asked: AskedTokens) -> DataFrame:
        """(query_id, arxiv_id, year, score, rest) of the papers that may be among the k best, from the blocks that are read."""
        lists = {"papers": "array<int>", "weights": "array<double>"}
        told = {"arxiv_id": "string", "year": "int", "loose": "boolean"}
        blocks = read.select("segment", "token_id", "at", *lists, *[F.lit(None).cast(kind).alias(c) for c, kind in told.items()])
        papers = self.papers.select(
            "segment", F.lit(None).cast("bigint").alias("token_id"), "at", *[F.lit(None).cast(kind).alias(c) for c, kind in lists.items()], *told
        )
        dealt = blocks.unionByName(papers).repartition(task_count(read.sparkSession), "segment")
        ordered = dealt.sortWithinPartitions("segment", F.asc_nulls_first("token_id"), "at")
        return ordered.mapInArrow(asked.scan, asked.schema)

    @staticmethod
    def _kth(sums: DataFrame, k: int) -> DataFrame:
        """(query_id, bound): the k-th best sum, 0 where fewer papers have one."""
        best = top_k(sums.select("query_id", "arxiv_id", "score"), ["query_id"], best_first(), k)
        return best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(0.0)).alias("bound"))

    def search(self, tokens: DataFrame, vectors: DataFrame, k: int, counts: list | None = None) -> DataFrame:
        """The k papers with the largest inner product per query, inside its year range.

        tokens: query_id, start_year, end_year, token_id, query_weight (positive); vectors: arxiv_id, sparse_vector, from which
        the papers that may be among the k best are scored. `counts` gets (postings read, postings of the query tokens),
        summed over the queries. A larger query set is searched in blocks.
        """
        tokens = tokens.where((F.col("query_weight") > 0) & F.col("query_id").isNotNull())
        tokens = tokens.withColumn("query_weight", F.col("query_weight").cast("double"))
        tokens = tokens.groupBy("query_id", "token_id", "query_weight", "start_year", "end_year").agg(F.count("*").alias("times"))
        tokens = cut_lineage(tokens, "query-tokens")
        queries, rows = tokens.agg(F.count_distinct("query_id"), F.count("*")).first()
        most = max(1, min(QUERY_ROWS, HELD_ROWS // (4 * k)))  # hits are held as tuples
        blocks = max(-(-queries // most), -(-rows // BROADCAST_ROWS))
        read = np.zeros(2, np.int64)
        if blocks <= 1:
            found = self._search(tokens, vectors, k, read)
        else:
            found = None
            for block in range(blocks):
                some = tokens.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
                part = cut_lineage(self._search(some, vectors, k, read), "hits")
                found = part if found is None else found.unionByName(part)
        if counts is not None:
            counts.append((int(read[0]), int(read[1])))
        return found

    def _search(self, tokens: DataFrame, vectors: DataFrame, k: int, read: np.ndarray) -> DataFrame:
        kind = tokens.schema["query_id"].dataType
        mine = broadcast_checked(tokens.select("token_id").distinct())
        lists = cut_lineage(self.blocks.select("segment", "token_id", "at", "top", "n").join(mine, "token_id"), "query-blocks")
        before = W.partitionBy("token_id").orderBy(F.desc("top"), "segment", "at").rowsBetween(W.unboundedPreceding, -1)
        heads = lists.withColumn("above", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("above") < k)
        heads = broadcast_checked(heads.select("segment", "token_id", "at"))
        first = self._kth(self._sums(self.blocks.join(heads, ["segment", "token_id", "at"]), AskedTokens(tokens.collect(), kind, k)), k)
        sizes = tokens.groupBy("query_id").agg(F.sum("times").alias("m"))
        share = sizes.join(first, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
        share = cut_lineage(share.withColumn("least", (F.col("bound") - SLACK) / F.col("m")), "query-bounds")
        allowed = F.col("top") * F.col("query_weight") >= F.col("least")
        asked = tokens.join(broadcast_checked(share), "query_id")
        chosen = lists.join(broadcast_checked(asked), "token_id").groupBy(*asked.columns).agg(
            F.min(F.when(allowed, F.col("top"))).alias("lowest"),
            F.coalesce(F.max(F.when(~allowed, F.col("top"))), F.lit(0.0)).alias("below"),
            F.coalesce(F.sum(F.when(allowed, F.col("n"))), F.lit(0)).alias("read"),
            F.sum("n").alias("whole"),
        )
        chosen = cut_lineage(chosen, "chosen-tokens")
        read += chosen.agg(*[F.coalesce(F.sum(F.col(c) * F.col("times")), F.lit(0)) for c in ("read", "whole")]).first()
        cuts = chosen.where(F.col("lowest").isNotNull()).groupBy("token_id").agg(F.min("lowest").alias("lowest"))
        wanted = self.blocks.join(broadcast_checked(cuts), "token_id").where(F.col("top") >= F.col("lowest"))
        sums = self._sums(wanted, AskedTokens(chosen.collect(), kind, k))
        if self.loose:
            parts = self._sums(self.blocks.join(mine, "token_id"), AskedTokens(tokens.collect(), kind, k, loose=True))
            added = parts.groupBy("query_id", "arxiv_id", "year").agg(F.round(F.sum("score"), 12).alias("score"), F.max("rest").alias("rest"))
            sums = sums.unionByName(added)
        sums = cut_lineage(sums, "sums")
        bound = broadcast_checked(self._kth(sums, k))
        likely = sums.join(bound, "query_id").where(F.col("score") + F.col("rest") >= F.col("bound") - SLACK)
        # Papers of which all is read need no second look; the others are scored from their whole vectors.
        whole = likely.where(F.col("rest") == 0).select("query_id", "arxiv_id", "year", "score")
        part = cut_lineage(likely.where(F.col("rest") > 0).select("query_id", "arxiv_id", "year"), "partly-read")
        scored = joined_by_key(vectors.select("arxiv_id", "sparse_vector"), part, "arxiv_id")
        weights = scored.select("query_id", "arxiv_id", "year", F.explode("sparse_vector").alias("token_id", "weight"))
        weighed = tokens.withColumn("query_weight", F.col("query_weight") * F.col("times")).drop("times")
        exact = weights.join(broadcast_checked(weighed), ["query_id", "token_id"]).where(F.col("year").between(F.col("start_year"), F.col("end_year")))
        product = F.col("weight").cast("double") * F.col("query_weight")
        exact = exact.groupBy("query_id", "arxiv_id", "year").agg(F.sum(product).alias("score"))
        return top_k(whole.unionByName(exact).withColumn("score", F.round("score", 12)), ["query_id"], best_first(), k)


class _CellBlock(DenseBlock):
    """Queries that each look at some cells only; batches carry the cell as a fourth column."""

    def __init__(self, rows: pd.DataFrame, k: int, wanted: np.ndarray):
        super().__init__(rows, k)
        self.wanted = wanted  # queries by cells

    def best(self, ids: np.ndarray, years: np.ndarray, column: pa.Array) -> Iterator[pd.DataFrame]:
        cells = column.field(1).to_numpy(zero_copy_only=False)
        vectors = column.field(0)
        parts: list[list[pd.DataFrame]] = [[] for _ in self.ids]
        for cell in np.unique(cells):
            rows = np.flatnonzero(cells == cell)
            asking = np.flatnonzero(self.wanted[:, cell])
            if not len(asking):
                continue
            scores = np.round(self.cosines(vectors.take(pa.array(rows)), asking), 12)
            for i, q in enumerate(asking):
                own = years[rows]
                valid = (own >= self.start[q]) & (own <= self.end[q]) & (scores[:, i] >= self.least[q])
                hit = rows[valid]
                if len(hit):
                    parts[q].append(pd.DataFrame({"arxiv_id": ids[hit], "year": years[hit], "score": scores[valid, i], "query_id": self.ids[q]}))
        for found in parts:
            yield self.cut(pd.concat(found)) if found else pd.DataFrame()


class VectorCells:
    """Vectors (arxiv_id, publication_year, dense_vector) written by their nearest centre."""

    def __init__(self, vectors: DataFrame, cells: int = CELLS, seed: int = 42):
        rows = vectors.select("arxiv_id", F.col("publication_year").cast("int").alias("year"), "dense_vector").where(
            F.col("year").isNotNull() & (F.size("dense_vector") > 0)
        )
        count = rows.count()
        share = F.lit(min(1.0, SAMPLE_ROWS / max(count, 1)) * (1 << 30))
        drawn = rows.where(F.pmod(F.xxhash64(F.lit(seed), "arxiv_id"), F.lit(1 << 30)) < share)
        length = F.sqrt(F.aggregate("dense_vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
        drawn = drawn.where(length > 0).select(array_to_vector(F.transform("dense_vector", lambda x: x / length)).alias("features"))
        self.centres = np.zeros((1, 1))
        if count:
            model = KMeans(k=max(2, cells), seed=seed, maxIter=8, distanceMeasure="cosine").fit(drawn) if drawn.limit(2).count() > 1 else None
            dims = len(rows.first()["dense_vector"])
            self.centres = np.array(model.clusterCenters()) if model else np.eye(1, dims)
            self.centres /= np.maximum(np.linalg.norm(self.centres, axis=1, keepdims=True), 1e-300)
        centres = self.centres

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                data = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
                data /= np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-300)
                near = data @ centres.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1.0, 1.0))
                columns = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)]
                yield pa.RecordBatch.from_arrays(columns, ["arxiv_id", "year", "dense_vector", "cell", "angle"])

        placed = rows.mapInArrow(assign, "arxiv_id string, year int, dense_vector array<float>, cell int, angle double")
        # Rows of one cell lie together: its row groups are skipped by their statistics, and a large cell is many files.
        self.vectors = cut_lineage(placed.hint("rebalance", "cell").sortWithinPartitions("cell"), "vector-cells")
        ends = self.vectors.groupBy("cell").agg(
            F.max("angle").alias("radius"), F.count("*").alias("n"), F.min("year").alias("first"), F.max("year").alias("last")
        )
        found = ends.toPandas().set_index("cell").reindex(range(len(self.centres)))  # a row per centre
        self.sizes = found["n"].fillna(0).to_numpy(np.int64)
        self.radius = found["radius"].fillna(0.0).to_numpy()
        self.first, self.last = found["first"].fillna(1 << 30).to_numpy(), found["last"].fillna(-(1 << 30)).to_numpy()

    def _bounds(self, block: DenseBlock) -> np.ndarray:
        """Queries by cells: the largest cosine that a vector of the cell can have; -inf without rows in the years."""
        angle = np.arccos(np.clip(block.unit @ self.centres.T, -1.0, 1.0))
        bound = np.cos(np.maximum(angle - self.radius - SLACK, 0.0)) + SLACK
        # A vector of length 0 lies at cosine 0 to everything.
        bound = np.maximum(bound, 0.0)
        inside = (self.first <= block.end[:, None]) & (self.last >= block.start[:, None]) & (self.sizes > 0)
        return np.where(inside, bound, -np.inf)

    def _scan(self, rows: pd.DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
        block = _CellBlock(rows, k, wanted)
        read = [int(c) for c in np.flatnonzero(wanted.any(axis=0))]
        cells = self.vectors.where(F.col("cell").isin(*read) if read else F.lit(False))
        return cells.select("arxiv_id", "year", F.struct("dense_vector", "cell").alias("v")).mapInArrow(block.scan, HITS)

    def search(self, queries: DataFrame, k: int, counts: list | None = None) -> DataFrame:
        """The k papers nearest to every query by cosine, inside its year range.

        `counts` gets (vectors compared, vectors that a scan would compare), summed over the queries.
        """
        asked = with_years(queries.where(F.size("dense_vector") > 0)).select("query_id", "dense_vector", "start_year", "end_year")
        if not self.sizes.sum():
            return self.vectors.sparkSession.createDataFrame([], HITS + ", rank int")
        asked = cut_lineage(asked, "queries")
        most = max(1, min(QUERY_ROWS, HELD_ROWS // k))
        blocks = -(-asked.count() // most)
        found: DataFrame | None = None
        compared = 0
        for number in range(blocks):
            listed = [r.asDict() for r in asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).collect()]
            for at in range(0, len(listed), most):
                rows = pd.DataFrame(listed[at : at + most])
                bounds = self._bounds(DenseBlock(rows, k))
                order = np.argsort(-bounds, axis=1, kind="stable")
                above = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
                likely = np.zeros(bounds.shape, bool)
                np.put_along_axis(likely, order, above < k, axis=1)
                likely &= bounds > -np.inf
                hits = cut_lineage(top_k(self._scan(rows, k, likely), ["query_id"], best_first(), k), "hits")
                kth = {r.query_id: r.least for r in hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).collect()}
                least = np.array([kth.get(q, -np.inf) for q in rows["query_id"]])
                further = (bounds >= least[:, None]) & (bounds > -np.inf) & ~likely
                compared += int(((likely | further) @ self.sizes).sum())
                both = hits.drop("rank").unionByName(self._scan(rows, k, further))
                part = cut_lineage(top_k(both, ["query_id"], best_first(), k), "hits")
                found = part if found is None else found.unionByName(part)
        if counts is not None:
            counts.append((compared, int(self.sizes.sum()) * asked.count()))
        return self.vectors.sparkSession.createDataFrame([], HITS + ", rank int") if found is None else found
