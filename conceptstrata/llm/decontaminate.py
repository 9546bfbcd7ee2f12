"""Benchmark decontamination: documents that hold a test item within an edit budget.

Texts are lower-cased and their white space is turned into single blanks. An item of m characters may differ
in k = floor(m * max_error) edits from a passage of the document. Cut into k + 1 pieces, at least one piece
must then occur unchanged (pigeonhole); one automaton over the pieces of a block of items finds all exact piece
hits of a document in one pass, and each hit's surroundings are verified with Myers' bit-parallel distance.

Items shorter than `min_chars` must occur unchanged, as whole words. Items and documents that are null or blank match
nothing, and empty tables give no rows. Repeated items and rows are matched each for itself, null keys included. A text
is searched as a whole, in one task. Other columns are not read. The items are taken in blocks of bounded size, each
a pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptstrata.llm.common import short_batches

MAX_ERROR = 0.06
MIN_CHARS = 32
BLOCK_ITEMS = 2_000
BLOCK_CHARS = 4 << 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces whose lengths differ by one at most."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(item: str, text: str) -> tuple[int, int]:
    """(distance, end): least edit distance of the item to any passage of the text, and where that ends.

    Myers (1999): a column of the dynamic program as two bit vectors of +1 and -1 steps, one text character a step.
    """
    m = len(item)
    places: dict[str, int] = {}
    for i, c in enumerate(item):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, value = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        same = places.get(c, 0)
        across = (((same & up) + up) ^ up) | same | down
        rise = down | (full & ~(across | up))
        fall = up & across
        if rise & top:
            value += 1
        elif fall & top:
            value -= 1
        rise, fall = rise << 1, fall << 1  # the passage may begin anywhere: no step enters at the first row
        same |= down
        up = full & (fall | ~(same | rise))
        down = full & (rise & same)
        if value < best:
            best, end = value, j + 1
    return best, end


def stands_alone(text: str, begin: int, end: int) -> bool:
    """No letter or digit goes on at either end of the passage."""
    before, after = text[begin - 1 : begin], text[end : end + 1]
    return not (before.isalnum() and text[begin].isalnum()) and not (after.isalnum() and text[end - 1].isalnum())


class Index:
    """An automaton over the pieces of a block of items."""

    def __init__(self, items: tuple[str, ...], max_error: float, min_chars: int):
        import ahocorasick

        self.items = items
        self.exact = [len(item) < min_chars for item in items]
        self.budgets = [0 if exact else int(len(item) * max_error) for item, exact in zip(items, self.exact, strict=True)]
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(items):
            for offset, piece in pieces(item, self.budgets[i]):
                owners.setdefault(piece, []).append((i, offset))
        for piece, places in owners.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, distance, begin, end) of the nearest passage to every item within its budget.

        Hits that say the same start, give or take the budget, are verified together.
        """
        hits: dict[int, set[int]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for i, offset in places:
                hits.setdefault(i, set()).add(last - size + 1 - offset)
        for i, starts in sorted(hits.items()):
            item, budget = self.items[i], self.budgets[i]
            found = None
            if self.exact[i]:
                begin = min((b for b in starts if stands_alone(text, b, b + len(item))), default=None)
                if begin is not None:
                    yield i, 0, begin, begin + len(item)
                continue
            spans: list[list[int]] = []
            for begin in sorted(starts):
                if spans and begin - budget <= spans[-1][1]:
                    spans[-1][1] = begin + len(item) + budget
                else:
                    spans.append([max(0, begin - budget), begin + len(item) + budget])
            for a, b in spans:
                distance, end = best_match(item, text[a:b])
                if distance <= budget and (found is None or distance < found[0]):
                    found = (distance, a, a + end)
            if found:
                distance, a, end = found
                back = text[a:end][::-1]
                yield i, distance, end - best_match(item[::-1], back)[1], end


@lru_cache(maxsize=2)
def index(items: tuple[str, ...], max_error: float, min_chars: int) -> Index:
    return Index(items, max_error, min_chars)


def item_blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """The items in blocks of about BLOCK_ITEMS rows and BLOCK_CHARS characters."""
    usable = benchmark.select(key, text).where(F.length(text) > 0)
    rows, chars = usable.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    blocks = max(-(-rows // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for b in range(blocks):
        yield usable.where(F.pmod(F.xxhash64(key, text), F.lit(blocks)) == b).collect()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    max_error: float = MAX_ERROR,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """(key, item_key, distance, begin, end): a row per document and item that it holds, places in the normal text."""
    short_batches(docs.sparkSession)
    own = [T.StructField(key, docs.schema[key].dataType), T.StructField(item_key, benchmark.schema[item_key].dataType)]
    schema = T.StructType(own + [T.StructField(n, T.IntegerType()) for n in ("distance", "begin", "end")])
    found = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark, item_key, item_text):
        named = [(row[0], normal(row[1])) for row in block]
        named = sorted(((i, t) for i, t in named if t), key=lambda x: (x[1], str(x[0])))
        if named:
            found = found.unionByName(search(docs.select(key, text), named, schema, max_error, min_chars))
    return found


def search(docs: DataFrame, named: list[tuple], schema: T.StructType, max_error: float, min_chars: int) -> DataFrame:
    ids, items = [i for i, _ in named], tuple(t for _, t in named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index(items, max_error, min_chars)
        for batch in batches:
            rows, out = [], []
            for r, value in enumerate(batch.column(1)):
                for match in own.matches(normal(value.as_py() or "")):
                    rows.append(r)
                    out.append(match)
            if rows:
                columns = [pa.array([ids[m[0]] for m in out])]
                columns += [pa.array([m[k] for m in out], pa.int32()) for k in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], schema.names)

    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents without those that hold an item; a null key is a key like others."""
    held = found.select(F.col(key).alias("_held")).distinct()
    return docs.join(held, F.col(key).eqNullSafe(F.col("_held")), "left_anti")
