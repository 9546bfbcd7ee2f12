"""Blocks of postings by segments of papers, and the scoring of queries against them.

A segment is a bounded run of postings as they lie, cut where a paper ends. Its postings are sorted by token and falling
weight and cut into blocks; its papers are numbered in the order of their ids. As a segment holds the whole of its
papers, the queries are scored in it without moving anything, and only papers that may still be hits leave the task.
Papers that lie in several segments or whose tokens repeat are marked `loose` by the caller: they are scored by themselves,
from all blocks, and their sums all leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SEGMENT_ROWS = 500_000  # postings that a worker sorts at once, some 50 MB; its cube fits 63 bits
PAPER_ROWS = 4_096  # papers in a row of a segment's list of papers
SENT_BLOCKS, SENT_ROWS = 10_000, 50_000  # blocks and hits in a batch
SLACK = 1e-9  # for rounding, in scores and angles

#: A block of postings (paper numbers by falling weight), or, where token_id is null, papers of the segment from number `at` on.
SEGMENTS = (
    "segment bigint, token_id bigint, at int, top double, n int, papers array<int>, weights array<double>, "
    "arxiv_id array<string>, year array<int>, repeats array<boolean>"
)
_ARROW_SEGMENTS = pa.schema(
    [("segment", pa.int64()), ("token_id", pa.int64()), ("at", pa.int32()), ("top", pa.float64()), ("n", pa.int32())]
    + [("papers", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64()))]
    + [("arxiv_id", pa.list_(pa.string())), ("year", pa.list_(pa.int32())), ("repeats", pa.list_(pa.bool_()))]
)


def cut_segments(batches: Iterator[pa.RecordBatch], block_rows: int, segment_rows: int) -> Iterator[pa.RecordBatch]:
    """Segments of a task's postings (token_id, weight, arxiv_id, year)."""
    segment = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        while rows >= segment_rows:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()  # copied
            cut = yield from _segment(segment, table.slice(0, segment_rows), block_rows, True)
            held, rows, segment = table.slice(cut).to_batches(), rows - cut, segment + 1
    if rows:
        yield from _segment(segment, pa.Table.from_batches(held).combine_chunks(), block_rows, False)


def _segment(segment: int, table: pa.Table, block_rows: int, more: bool) -> Iterator[pa.RecordBatch]:
    """The blocks and papers of a segment; returns the rows it took, all up to its last paper where more follow."""
    coded = table.column(2).combine_chunks().dictionary_encode(null_encoding="encode")
    code, year = coded.indices.to_numpy(), table.column(3).to_numpy()
    starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (year[1:] != year[:-1])])
    rows = len(code)
    if more and len(starts) > 1:  # the last paper may go on; one that fills a segment is cut
        rows, starts = int(starts[-1]), starts[:-1]
    order = pc.array_sort_indices(coded.dictionary, null_placement="at_start")
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    papers, number = np.unique((place[code[starts]] << 32) + year[starts] + (1 << 31), return_inverse=True)
    number = np.repeat(number, np.diff(np.r_[starts, rows]))
    ids = coded.dictionary.take(order.take(pa.array(papers >> 32)))
    years = ((papers & 0xFFFFFFFF) - (1 << 31)).astype(np.int32)

    tokens, key = np.unique(table.column(0).to_numpy()[:rows], return_inverse=True)
    pair = key * len(papers)
    pair += number
    pair.sort()
    repeats = np.zeros(len(papers), bool)
    repeats[pair[1:][pair[1:] == pair[:-1]] % len(papers)] = True
    del pair
    weights, weight = np.unique(-table.column(1).to_numpy()[:rows], return_inverse=True)
    key *= len(weights)
    key += weight
    key *= len(papers)
    key += number
    del weight
    key.sort()
    number = (key % len(papers)).astype(np.int32)
    key //= len(papers)
    weight = -weights[key % len(weights)]
    key //= len(weights)
    token = key

    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    length = np.diff(np.r_[first, rows])
    blocks = -(-length // block_rows)
    at = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat(first, blocks) + at * block_rows
    cuts = pa.array(np.r_[starts, rows].astype(np.int32))
    written = _rows(
        segment,
        len(starts),
        token_id=pa.array(tokens[token[starts]]),
        at=pa.array(at.astype(np.int32)),
        top=pa.array(weight[starts]),
        n=pa.array(np.diff(np.r_[starts, rows]).astype(np.int32)),
        papers=pa.ListArray.from_arrays(cuts, pa.array(number)),
        weights=pa.ListArray.from_arrays(cuts, pa.array(weight)),
    )
    del key, token
    for low in range(0, len(starts), SENT_BLOCKS):
        yield written.slice(low, SENT_BLOCKS)
    low = np.arange(0, len(papers), PAPER_ROWS, dtype=np.int32)
    cuts = pa.array(np.r_[low, len(papers)].astype(np.int32))
    lists = {"arxiv_id": ids, "year": pa.array(years), "repeats": pa.array(repeats)}
    yield _rows(segment, len(low), at=pa.array(low), **{c: pa.ListArray.from_arrays(cuts, v) for c, v in lists.items()})
    return rows


def _rows(segment: int, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    columns["segment"] = pa.array(np.full(rows, segment))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in _ARROW_SEGMENTS], schema=_ARROW_SEGMENTS)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


class AskedTokens:
    """A bounded set of queries by their tokens, scored against one segment after the other.

    rows: query_id, token_id, query_weight, times (equal rows), start_year, end_year; where a first bound is known also
    `bound` (the score that the k-th best paper reaches at least), `least` (what a block must allow to be read for this row)
    and `below` (the largest weight of its token left unread). Without these, all blocks that are given count.
    """

    columns = "query_id {}, arxiv_id string, year int, score double, rest double"

    def __init__(self, rows: list, kind: T.DataType, k: int, loose: bool = False):
        listed = sorted((r.asDict() for r in rows), key=lambda r: (r["query_id"], r["token_id"]))
        names = [r["query_id"] for r in listed]
        starts = [i for i, name in enumerate(names) if not i or name != names[i - 1]]
        self.ids = [names[i] for i in starts]
        self.ends = list(zip(starts, [*starts[1:], len(names)]))
        self.bound = np.array([listed[i].get("bound", 0.0) for i in starts])
        self.tokens, self.code = np.unique(np.array([r["token_id"] for r in listed], np.int64), return_inverse=True)
        self.single = np.array([r["query_weight"] for r in listed], np.float64)
        self.times = np.array([r["times"] for r in listed], np.int64)
        self.start, self.end = (np.array([r[c] for r in listed], np.int64) for c in ("start_year", "end_year"))
        self.least = np.array([r.get("least", -np.inf) for r in listed])
        self.unread = np.array([r.get("below", 0.0) for r in listed]) * self.single * self.times
        self.kind, self.k, self.loose = kind, k, loose

    @property
    def schema(self) -> str:
        return self.columns.format(self.kind.simpleString())

    def scan(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every query the papers of these segments that may be among its k best, or the loose ones with a part of their sums.

        Batches: segment, token_id, at, papers, weights, arxiv_id, year, loose, by segment; first its papers, then its blocks.
        `rest` is the most that unread blocks can add to the score, 0 where all is read.
        """
        hits = _Hits(self)
        for table in _by_segment(batches):
            yield from self._score(table, hits)
        for q in range(len(self.ids)):
            hits.cut(q, 0)
        yield from hits.sent(1)

    def _score(self, table: pa.Table, hits: _Hits) -> Iterator[pa.RecordBatch]:
        known = table.column(1).null_count
        ids, year, loose = (table.column(c).combine_chunks().slice(0, known) for c in (5, 6, 7))
        year, loose = year.to_numpy(), loose.to_numpy(zero_copy_only=False)
        blocks = table.slice(known)
        if not blocks.num_rows:
            return
        papers, weights = (blocks.column(c).combine_chunks() for c in (3, 4))
        size = np.diff(papers.offsets.to_numpy())
        offset = np.cumsum(size) - size
        papers, weights = papers.flatten().to_numpy(), weights.flatten().to_numpy()
        token = blocks.column(1).to_numpy()
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        place = np.searchsorted(self.tokens, token[first])
        head, count = np.zeros(len(self.tokens), np.int64), np.zeros(len(self.tokens), np.int64)
        head[place], count[place] = first, np.diff(np.r_[first, len(token)])
        # Blocks lie by falling weight, so those that a row reads are the first ones of its token.
        row = np.repeat(np.arange(len(self.code)), count[self.code])
        block = _ranges(head[self.code], count[self.code])
        read = size[block] * (weights[offset[block]] * self.single[row] >= self.least[row])
        length = np.bincount(row, read, len(self.code)).astype(np.int64)
        begin = offset[head[self.code]]
        for q, (a, z) in enumerate(self.ends):
            if not length[a:z].any():
                continue
            posting = _ranges(begin[a:z], length[a:z])
            paper = papers[posting]
            spread = lambda values: np.repeat(values[a:z], length[a:z])  # noqa: B023, E731
            product = weights[posting] * spread(self.single * self.times)
            inside = True
            if (self.start[a:z] == self.start[a]).all() and (self.end[a:z] == self.end[a]).all():
                inside = (year >= self.start[a]) & (year <= self.end[a])
            else:
                keep = (year[paper] >= spread(self.start)) & (year[paper] <= spread(self.end))
                posting, paper, product = posting[keep], paper[keep], product[keep]
                spread = lambda values, keep=keep: np.repeat(values[a:z], length[a:z])[keep]  # noqa: B023, E731
            score = np.bincount(paper, product, len(year))
            open_rows = int((self.unread[a:z] > 0).sum())
            rest = np.zeros(len(year))
            if open_rows:
                left = open_rows - np.bincount(paper, spread(self.unread > 0), len(year))
                rest = np.where(left > 0, np.maximum(self.unread[a:z].sum() - np.bincount(paper, spread(self.unread), len(year)), SLACK), 0.0)
            hit = (score > 0) & inside & (loose == self.loose)
            if self.loose:
                found = np.flatnonzero(hit)
                hits.send(q, ids.take(pa.array(found)), year[found], score[found], rest[found])
            else:
                hits.add(q, ids, year, np.round(score, 12), rest, np.flatnonzero(hit & (score + rest >= hits.least[q] - SLACK)))
            yield from hits.sent(SENT_ROWS)


def _by_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        segment = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        for a, z in zip(starts, [*starts[1:], len(segment)]):
            part = batch.slice(a, z - a)
            if held and held[0].column(0)[0].as_py() != int(segment[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


class _Hits:
    """Running lists of a task: per query the papers that may be among the k best of all."""

    def __init__(self, asked: AskedTokens):
        self.asked, self.k = asked, asked.k
        self.least = asked.bound.copy()  # the k-th best paper has at least this score
        self.kept: list[list[tuple]] = [[] for _ in asked.ids]
        self.held = np.zeros(len(asked.ids), np.int64)
        self.out: list[pa.RecordBatch] = []
        self.waiting = 0

    def add(self, q: int, ids: pa.Array, year: np.ndarray, score: np.ndarray, rest: np.ndarray, found: np.ndarray) -> None:
        """Papers of a segment, numbered in the order of their ids."""
        whole = found[rest[found] == 0]
        if len(whole) > self.k:
            best = whole[np.lexsort((whole, -score[whole]))[: self.k]]
            self.least[q] = max(self.least[q], score[best[-1]])
            found = np.r_[best, found[rest[found] > 0]]
            found = found[score[found] + rest[found] >= self.least[q] - SLACK]
        if not len(found):
            return
        self.kept[q] += zip(score[found].tolist(), ids.take(pa.array(found)).to_pylist(), year[found].tolist(), rest[found].tolist())
        self.held[q] += len(found)
        if self.held[q] >= 2 * self.k:
            self.cut(q, 2 * self.k)

    def cut(self, q: int, most: int) -> None:
        """The list of a query without those that cannot be hits; if it is still longer than `most`, it is sent."""
        rows = sorted(self.kept[q], key=lambda r: (-r[0], r[1] is not None, r[1] or "", r[2]))
        if len(rows) >= self.k:
            self.least[q] = max(self.least[q], rows[self.k - 1][0])
        kept, whole = [], 0
        for row in rows:
            whole += row[3] == 0
            if row[0] + row[3] >= self.least[q] - SLACK and (row[3] > 0 or whole <= self.k):
                kept.append(row)
        if len(kept) > most:
            score, ids, year, rest = zip(*kept)
            self.send(q, pa.array(ids, pa.string()), np.array(year), np.array(score), np.array(rest))
            kept = []
        self.kept[q], self.held[q] = kept, len(kept)

    def send(self, q: int, ids: pa.Array, year: np.ndarray, score: np.ndarray, rest: np.ndarray) -> None:
        asking = pa.array([self.asked.ids[q]], to_arrow_type(self.asked.kind)).take(pa.array(np.zeros(len(ids), np.int32)))
        columns = [asking, ids, pa.array(year.astype(np.int32)), pa.array(score), pa.array(rest)]
        self.out.append(pa.RecordBatch.from_arrays(columns, ["query_id", "arxiv_id", "year", "score", "rest"]))
        self.waiting += len(ids)

    def sent(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.waiting >= least:
            yield from pa.Table.from_batches(self.out).combine_chunks().to_batches(max_chunksize=SENT_ROWS)
            self.out, self.waiting = [], 0
