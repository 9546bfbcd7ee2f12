"""Dense, sparse and hybrid retrieval for a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptstrata.functions.vectors import scaled_cosine, scaled_inner_product
from conceptstrata.operators.encode import drop_smallest
from conceptstrata.operators.lookup import joined_by_key
from conceptstrata.operators.ranking import broadcast_checked, top_k
from conceptstrata.session import cut_lineage

FIRST_YEAR, LAST_YEAR = 1980, 2025
RRF_CONSTANT = 60
# Queries sent along with the scoring function (12 MB at 768 dimensions); more are scored in blocks.
QUERY_ROWS = 2_048
# Rows that all lists of a task together may have, some 100 MB; each list is cut at twice its length.
HELD_ROWS = 1_000_000
# Cells of the paper-by-token matrix of the sparse scan (64 MB)
MATRIX_CELLS = 8 << 20

HITS = "query_id bigint, arxiv_id string, year int, score double"
_ARROW_HITS = pa.schema(
    [("query_id", pa.int64()), ("arxiv_id", pa.string()), ("year", pa.int32()), ("score", pa.float64())]
)


def best_first() -> list[Column]:
    return [F.desc("score"), F.col("arxiv_id")]


def candidate_limit(limit: int) -> int:
    """How many hits each side fetches before fusion."""
    return limit * 10


def with_years(queries: DataFrame) -> DataFrame:
    """Queries with their year range, the default one where none is given."""
    for name, default in (("start_year", FIRST_YEAR), ("end_year", LAST_YEAR)):
        given = F.col(name) if name in queries.columns else F.lit(None)
        queries = queries.withColumn(name, F.coalesce(given, F.lit(default)).cast("int"))
    return queries


class _QueryBlock:
    """A bounded set of queries, scored against Arrow batches of papers."""

    def __init__(self, rows: pd.DataFrame, k: int):
        self.ids = rows["query_id"].to_numpy(np.int64)
        self.start = rows["start_year"].to_numpy(np.int64)
        self.end = rows["end_year"].to_numpy(np.int64)
        self.k = k
        self.least = np.full(len(self.ids), -np.inf)  # score below which no paper can be a hit

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
        """Papers by queries, and which of them are hits at all (None for all).

        Scores are rounded, so that equal papers tie exactly and the id decides.
        """
        raise NotImplementedError

    def best(self, ids: np.ndarray, years: np.ndarray, column: pa.Array) -> Iterator[pd.DataFrame]:
        """Per query the k best of these papers, without those that cannot reach the k best seen so far."""
        scores, hit = self.scores(column)
        for q, query_id in enumerate(self.ids):
            valid = (years >= self.start[q]) & (years <= self.end[q]) & (scores[:, q] >= self.least[q])
            rows = np.flatnonzero(valid if hit is None else valid & hit[:, q])
            hits = pd.DataFrame({"arxiv_id": ids[rows], "year": years[rows], "score": scores[rows, q]})
            yield self.cut(hits.assign(query_id=query_id))

    def cut(self, hits: pd.DataFrame) -> pd.DataFrame:
        if len(hits) <= self.k:
            return hits
        scores = hits["score"].to_numpy()
        bound = np.partition(scores, len(hits) - self.k)[len(hits) - self.k]
        above = hits[scores > bound]
        # Any number of copies may share the k-th score: the smallest ids fill the list.
        ties = hits[scores == bound].sort_values("arxiv_id").head(self.k - len(above))
        return pd.concat([above, ties])

    def scan(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Running top-k of a whole task, so a task hands on at most k rows per query.

        A query's list is cut as soon as it has twice its k rows; from then on its k-th score is the least that counts.
        """
        self.least = np.full(len(self.ids), -np.inf)
        kept: list[list[pd.DataFrame]] = [[] for _ in self.ids]
        held = np.zeros(len(self.ids), np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            years = batch.column(1).to_numpy(zero_copy_only=False)
            for q, hits in enumerate(self.best(ids, years, batch.column(2))):
                if len(hits):
                    kept[q].append(hits)
                    held[q] += len(hits)
                if held[q] >= 2 * self.k:
                    kept[q] = [self.cut(pd.concat(kept[q]))]
                    held[q] = len(kept[q][0])
                    self.least[q] = kept[q][0]["score"].min()
        for parts in kept:
            if parts:
                hits = self.cut(pd.concat(parts))
                yield pa.RecordBatch.from_pandas(hits, schema=_ARROW_HITS, preserve_index=False)


class DenseBlock(_QueryBlock):
    """Cosine of every paper with every query: one matrix product per batch."""

    column = "dense_vector"

    def __init__(self, rows: pd.DataFrame, k: int):
        super().__init__(rows, k)
        self.unit = _unit(np.array(rows[self.column].tolist(), dtype=np.float64))

    def scores(self, column: pa.Array) -> tuple[np.ndarray, None]:
        return np.round(self.cosines(column), 12), None

    def cosines(self, column: pa.Array, queries: np.ndarray | slice = slice(None)) -> np.ndarray:
        vectors = column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)
        return _unit(vectors) @ self.unit[queries].T


class _SparseBlock(_QueryBlock):
    """Inner product of positive weights; papers that share no token with a query are no hits.

    Only the tokens of the queries are kept of a batch, as the columns of a matrix.
    """

    column = "sparse_vector"

    def __init__(self, rows: pd.DataFrame, k: int):
        super().__init__(rows, k)
        entries = [dict(weights).items() for weights in rows[self.column]]
        self.tokens = np.unique(np.array([t for e in entries for t, _ in e], dtype=np.int64))
        self.weights = np.zeros((len(self.tokens), len(entries)))
        for q, entry in enumerate(entries):
            for token, weight in entry:
                self.weights[np.searchsorted(self.tokens, token), q] = weight

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        scores = np.zeros((len(column), len(self.ids)))
        if not len(self.tokens):
            return scores, scores > 0
        offsets = column.offsets.to_numpy()
        first, last = offsets[0], offsets[-1]
        tokens = column.keys.to_numpy()[first:last]
        weights = column.items.to_numpy()[first:last].astype(np.float64)
        paper = np.repeat(np.arange(len(column)), np.diff(offsets))
        place = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        shared = np.flatnonzero(self.tokens[place] == tokens)
        paper, place, weights = paper[shared], place[shared], weights[shared]
        chunk = max(1, MATRIX_CELLS // len(self.tokens))
        for low in range(0, len(column), chunk):
            high = min(low + chunk, len(column))
            a, b = np.searchsorted(paper, (low, high))
            held = np.zeros((high - low, len(self.tokens)))
            held[paper[a:b] - low, place[a:b]] = weights[a:b]
            scores[low:high] = held @ self.weights
        scores = np.round(scores, 12)
        return scores, scores > 0


def _unit(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(lengths > 0, lengths, 1.0)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k papers nearest to every query by cosine, inside the query's year range.

    vectors: arxiv_id, publication_year, dense_vector; queries: query_id, dense_vector and
    optionally start_year, end_year.
    """
    return _scan_topk(vectors, queries, k, DenseBlock)


def sparse_scan_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k papers with the largest inner product per query, inside the query's year range.

    Same result as `sparse_topk`, from the papers' weight maps instead of a postings table: better
    for queries with frequent tokens, whose (query, paper) sums would all be shuffled there.
    """
    return _scan_topk(vectors, queries, k, _SparseBlock)


def _scan_topk(vectors: DataFrame, queries: DataFrame, k: int, kind: type[_QueryBlock]) -> DataFrame:
    """Top-k of a scan: the papers are scored where they lie and every task keeps its own top-k.

    Neither papers nor scores are shuffled, only k rows per query and task. The queries travel with the scoring function,
    as many of them as a task can hold lists for; a larger set is scored block by block, each block in a scan of its own
    whose lists are written to the shared folder, so that the driver never holds more than a block.
    """
    column = kind.column
    papers = vectors.select("arxiv_id", F.col("publication_year").cast("int").alias("year"), column).where(
        F.col("year").isNotNull() & (F.size(column) > 0)
    )
    asked = with_years(queries.where(F.size(column) > 0)).select("query_id", column, "start_year", "end_year")
    most = max(1, min(QUERY_ROWS, HELD_ROWS // k))
    rows = asked.limit(most + 1).collect()
    if not rows:
        return papers.sparkSession.createDataFrame([], HITS + ", rank int")
    if len(rows) <= most:
        return _scored(papers, rows, k, kind)
    asked = cut_lineage(asked, "queries")
    blocks = -(-asked.count() // most)
    found: DataFrame | None = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        for at in range(0, len(rows), most):  # hashing fills blocks unevenly
            part = cut_lineage(_scored(papers, rows[at : at + most], k, kind), "hits")
            found = part if found is None else found.unionByName(part)
    return found


def _scored(papers: DataFrame, rows: list, k: int, kind: type[_QueryBlock]) -> DataFrame:
    """The k best papers for a bounded number of queries: one scan of the papers in the years that any of them asks for."""
    block = kind(pd.DataFrame([r.asDict() for r in rows]), k)
    span = papers.where(F.col("year").between(int(block.start.min()), int(block.end.max())))
    return top_k(span.mapInArrow(block.scan, HITS), ["query_id"], best_first(), k)


def query_tokens(queries: DataFrame, drop_ratio: float = 0.0) -> DataFrame:
    """Query weights as rows, with the year range."""
    return with_years(queries).select(
        "query_id",
        "start_year",
        "end_year",
        F.explode(drop_smallest(F.col("sparse_vector"), drop_ratio)).alias("token_id", "query_weight"),
    )


def sparse_topk(postings: DataFrame, tokens: DataFrame, k: int) -> DataFrame:
    """The k papers with the largest inner product per query, inside the query's year range.

    postings: token_id, arxiv_id, weight, publication_year; tokens: `query_tokens`. The query side is
    broadcast if it is small, so frequent tokens do not gather in one task; the products are summed
    before the shuffle on (query, paper).
    """
    product = F.col("weight").cast("double") * F.col("query_weight").cast("double")
    hits = (
        postings.join(broadcast_checked(tokens), "token_id")
        .where(F.col("publication_year").between(F.col("start_year"), F.col("end_year")))
        .groupBy("query_id", "arxiv_id", F.col("publication_year").cast("int").alias("year"))
        .agg(F.round(F.sum(product), 12).alias("score"))
    )
    return top_k(hits, ["query_id"], best_first(), k)


def _scaled(hits: DataFrame, norm: str, scale) -> DataFrame:
    if norm == "none":
        return hits
    if norm == "bounded":
        return hits.withColumn("score", scale(F.col("score")))
    if norm == "minmax":
        ends = hits.groupBy("query_id").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
        width = F.col("_hi") - F.col("_lo")
        return (
            hits.join(ends, "query_id")
            .withColumn("score", F.when(width > 0, (F.col("score") - F.col("_lo")) / width).otherwise(F.lit(1.0)))
            .drop("_lo", "_hi")
        )
    raise ValueError(f"norm must be bounded, none or minmax, not {norm!r}")


def _side(hits: DataFrame, dense: bool) -> DataFrame:
    zero, score = F.lit(0.0), F.col("score")
    return hits.select(
        "query_id",
        "arxiv_id",
        "year",
        (score if dense else zero).alias("dense_score"),
        (zero if dense else score).alias("sparse_score"),
    )


def fuse(
    dense: DataFrame, sparse: DataFrame, queries: DataFrame, limit: int, norm: str = "bounded"
) -> DataFrame:
    """Weighted rank fusion: alpha * dense + (1 - alpha) * sparse, best `limit` per query.

    A paper found on one side only counts 0 on the other. `queries` has query_id and alpha (0.5 where
    null). Both sides go through one shuffle on (query, paper).
    """
    both = _side(_scaled(dense, norm, scaled_cosine), True).unionByName(
        _side(_scaled(sparse, norm, scaled_inner_product), False)
    )
    alpha = queries.select("query_id", F.coalesce("alpha", F.lit(0.5)).alias("alpha"))
    score = F.col("alpha") * F.col("dense_score") + (F.lit(1.0) - F.col("alpha")) * F.col("sparse_score")
    fused = (
        both.groupBy("query_id", "arxiv_id")
        .agg(
            F.max("year").alias("year"),
            F.sum("dense_score").alias("dense_score"),
            F.sum("sparse_score").alias("sparse_score"),
        )
        .join(broadcast_checked(alpha), "query_id")
        .select("query_id", "arxiv_id", "year", F.round(score, 12).alias("score"))
    )
    return top_k(fused, ["query_id"], best_first(), limit)


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, limit: int) -> DataFrame:
    """Fusion by ranks: sum of 1 / (60 + rank) over the lists that hold the paper."""
    both = dense.select("query_id", "arxiv_id", "year", "rank").unionByName(
        sparse.select("query_id", "arxiv_id", "year", "rank")
    )
    fused = both.groupBy("query_id", "arxiv_id").agg(
        F.max("year").alias("year"),
        F.round(F.sum(F.lit(1.0) / (F.lit(RRF_CONSTANT) + F.col("rank"))), 12).alias("score"),
    )
    return top_k(fused, ["query_id"], best_first(), limit)


def hybrid_search(
    vectors: DataFrame,
    queries: DataFrame,
    limit: int = 1000,
    norm: str = "bounded",
    drop_ratio: float = 0.0,
    postings: DataFrame | None = None,
    candidates: int | None = None,
) -> DataFrame:
    """Dense and sparse search with over-fetch (`candidates` hits of each side), then fusion.

    vectors: arxiv_id, publication_year, dense_vector, sparse_vector; queries: query_id,
    dense_vector, sparse_vector, alpha, optionally a year range. alpha = 1 is dense only, 0 sparse
    only. Given a postings table, the sparse side looks the query tokens up there instead of scanning.
    """
    pool = candidate_limit(limit) if candidates is None else candidates
    dense = dense_topk(vectors, queries, pool)
    if postings is None:
        trimmed = queries.withColumn("sparse_vector", drop_smallest(F.col("sparse_vector"), drop_ratio))
        sparse = sparse_scan_topk(vectors, trimmed, pool)
    else:
        sparse = sparse_topk(postings, query_tokens(queries, drop_ratio), pool)
    return fuse(dense, sparse, queries, limit, norm)


def attach_metadata(hits: DataFrame, papers: DataFrame) -> DataFrame:
    """Hits with title, abstract, category and date; papers that are no hits are left out where they are read."""
    found = hits.persist()  # counted first, then joined
    return joined_by_key(papers.select("arxiv_id", "title", "abstract", "primary_category", "published_date"), found, "arxiv_id")


def restrict(papers: DataFrame, year: int | None = None, category: str | None = None) -> DataFrame:
    """Papers of one year and/or category."""
    if year is not None:
        papers = papers.where(F.year("published_date") == year)
    if category is not None:
        papers = papers.where(F.col("primary_category") == category)
    return papers


def known_item_rank(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Rank of the sought paper in every query's list (null if absent), with hit flag and 1/rank."""
    found = hits.select("query_id", "arxiv_id", "rank", "score")
    return targets.join(found, ["query_id", "arxiv_id"], "left").withColumns(
        {
            "hit": F.col("rank").isNotNull().cast("int"),
            "reciprocal_rank": F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0)),
        }
    )
