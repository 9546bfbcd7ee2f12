"""Shards of nearly equal bytes by histogram sort: splitters are refined by exact counts, then rows move once.

Rows are ordered by a 40-byte key: digest of the text, id, hash of the other columns, number of the row in the written
copy. So equal texts lie side by side, every shard is an even mixture of the corpus, and no two keys are equal. A
splitter should have i/shards of all bytes below it. Each round sends the candidate boundaries (probes) to all
partitions, which count the exact bytes and rows between them; the driver sums these counts, keeps the nearest boundary
where it is within `tolerance` of a shard's size, and puts new probes into the interval of each splitter that is not:

* on the digest, 4,096 times finer each round, so that a splitter falls between two texts if it can;
* where one text has more copies than the tolerance allows, between its rows, down to the nearest single row.

Every shard is cut into cells of about `cell_bytes` by splitters of the same kind (a quarter of a cell off at most),
so a row's place is the rows below its cell plus its rank in the cell: no task sorts a whole shard, and copies of one
text, a third of all rows or more, go to as many cells as others of that size.

Results: a null text counts 1 byte (size is UTF-8 bytes plus 1) and lies with the empty texts; null ids come first among
equal texts; repeated rows are rows of their own. A text longer than a shard fills it, and shards may stay empty
where rows are few. An empty table gives no rows. Columns of the input named size, shard or slot are replaced. Columns of
map type take no part in the order. The driver holds probes and counts, at most some thousands a splitter in refinement.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptstrata.llm.common import Scratch
from conceptstrata.session import ship_package

TOLERANCE = 0.005  # of a shard's bytes, on either side of a splitter
CELL_TOLERANCE = 0.25
CELL_BYTES = 256 << 20
KEY_BYTES, DIGEST_BYTES = 40, 16
TEXT_BITS = 8 * (KEY_BYTES - DIGEST_BYTES)  # of a key, below the digest
ROUND_BITS = 12
ROW_PROBES = 256
FILTERED = 64  # intervals that a scan is restricted to; with more, all rows are looked up


def _eight_bytes(number: Column) -> Column:
    """A long as bytes in the order of the numbers; null is the least."""
    shifted = F.coalesce(number, F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))
    return F.unhex(F.lpad(F.hex(shifted), 16, "0"))


def order_key(docs: DataFrame, text: str, key: str) -> Column:
    whole = isinstance(docs.schema[key].dataType, T.IntegralType)
    number = F.col(key).cast("long") if whole else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    others = [f.name for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.concat(digest, _eight_bytes(number), _eight_bytes(F.xxhash64(*others)), _eight_bytes(F.monotonically_increasing_id()))


def _to_bytes(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(KEY_BYTES, "big") for k in keys], f"S{KEY_BYTES}")


def _to_int(key: bytes) -> int:
    return int.from_bytes(key.ljust(KEY_BYTES, b"\0"), "big")  # numpy leaves out zeros at the end


@dataclass
class Cell:
    """Rows with least <= key <= most, and no others between; `below` and `rows_below` count what comes before."""

    below: int
    rows_below: int
    size: int
    rows: int
    least: int
    most: int

    def one_text(self) -> bool:
        return self.least >> TEXT_BITS == self.most >> TEXT_BITS

    def probes(self) -> list[int]:
        """Boundaries that part the rows: the next finer grid of digests, or even steps; the last ends the cell."""
        if self.one_text():
            span = self.most - self.least + 1
            return sorted({self.least + span * j // ROW_PROBES for j in range(ROW_PROBES + 1)})
        shared = 8 * KEY_BYTES - (self.least ^ self.most).bit_length()
        shift = max(TEXT_BITS, 8 * KEY_BYTES - (shared // ROUND_BITS + 1) * ROUND_BITS)
        return [k << shift for k in range(self.least >> shift, (self.most >> shift) + 2)]


def counted(keyed: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """cell -> (bytes, rows, least key, greatest key) of (order, size) rows; cell i begins at probe i - 1."""
    bounds = _to_bytes(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(bounds) + 1
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        least, most = np.full(n, b"\xff" * KEY_BYTES, f"S{KEY_BYTES}"), np.full(n, b"", f"S{KEY_BYTES}")
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array(batch.column(0).to_pylist(), f"S{KEY_BYTES}")
            by_key = np.argsort(keys)
            keys, sizes = keys[by_key], batch.column(1).to_numpy()[by_key]
            cells, first = np.unique(np.searchsorted(bounds, keys, side="right"), return_index=True)
            last = np.append(first[1:], len(keys)) - 1
            size[cells] += np.add.reduceat(sizes, first)
            rows[cells] += last - first + 1
            least[cells] = np.where(keys[first] < least[cells], keys[first], least[cells])
            most[cells] = np.where(keys[last] > most[cells], keys[last], most[cells])
        (found,) = np.nonzero(rows)
        ends = [pa.array(x[found].tolist(), pa.binary()) for x in (least, most)]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(size[found]), pa.array(rows[found]), *ends], ["cell", "size", "n", "least", "most"])

    parts = keyed.select("order", "size").mapInArrow(run, "cell bigint, size bigint, n bigint, least binary, most binary")
    sums = parts.groupBy("cell").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    return {r.cell: (r.size, r.n, _to_int(bytes(r.least)), _to_int(bytes(r.most))) for r in sums.collect()}


def splitters(keyed: DataFrame, targets: list[tuple[int, float]], parts: int, total: int, rows: int) -> list[tuple[int, int, int]]:
    """(key, bytes below, rows below) per target (i, tolerance in bytes): a boundary near i/parts of all bytes."""
    if not total:
        return [(0, 0, 0) for _ in targets]
    done: dict[int, tuple[int, int, int]] = {}
    end = 1 << 8 * KEY_BYTES
    unsettled = [(Cell(0, 0, total, rows, 0, end - 1), list(range(len(targets))))]
    while unsettled:
        bounds = [cell.probes() for cell, _ in unsettled]
        probes = sorted({p for own in bounds for p in own if p < end})
        inside = F.lit(len(unsettled) > FILTERED)
        for cell, _ in unsettled[:FILTERED]:
            low, high = (F.lit(bytearray(k.to_bytes(KEY_BYTES, "big"))) for k in (cell.least, cell.most))
            inside = inside | F.col("order").between(low, high)
        found = counted(keyed.where(inside), probes)
        number = {p: i + 1 for i, p in enumerate(probes)}
        following: dict[int, tuple[Cell, list[int]]] = {}
        for (cell, wanted), own in zip(unsettled, bounds, strict=True):
            inner, below, rows_below = [], cell.below, cell.rows_below
            for p in own[:-1]:
                if number[p] in found:
                    size, n, least, most = found[number[p]]
                    inner.append(Cell(below, rows_below, size, n, least, most))
                    below, rows_below = below + size, rows_below + n
            ends = np.array([(c.below + c.size) * parts for c in inner], object)
            for t in wanted:
                i, tolerance = targets[t]
                here = inner[int(np.searchsorted(ends, i * total, side="right"))]
                # bytes from either edge of the cell to the target, times parts
                after, before = i * total - here.below * parts, (here.below + here.size) * parts - i * total
                near_enough = not cell.one_text() and min(after, before) <= tolerance * parts
                if near_enough or here.rows == 1:
                    upper = here.most + 1, here.below + here.size, here.rows_below + here.rows
                    done[t] = (here.least, here.below, here.rows_below) if after <= before else upper
                else:
                    following.setdefault(here.least, (here, []))[1].append(t)
        unsettled = list(following.values())
    return [done[t] for t in range(len(targets))]


def shard(
    docs: DataFrame,
    shards: int = 16,
    text: str = "text",
    key: str = "doc_id",
    tolerance: float = TOLERANCE,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """The rows with `size`, `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard, in key order)."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    row = F.struct(*docs.columns).alias("doc")
    # The copy fixes the number of each row: the rounds and the exchange see the same keys.
    kept = scratch.keep(docs.select(row, size.alias("size"), order_key(docs, text, key).alias("order")), "keyed-rows")
    sums = kept.agg(F.sum("size"), F.count("*")).first()
    total, rows = sums[0] or 0, sums[1]
    per_shard = max(1, -(-total // (shards * cell_bytes)))
    parts = shards * per_shard
    near = [tolerance * total / shards if i % per_shard == 0 else CELL_TOLERANCE * total / parts for i in range(1, parts)]
    found = splitters(kept, list(zip(range(1, parts), near, strict=True)), parts, total, rows)
    firsts = sorted(found[per_shard - 1 :: per_shard])
    starts = [(0, 0, 0), *sorted(found)]  # of the cells
    shard_of = np.searchsorted(np.array([b for _, b, _ in firsts], np.int64), [b for _, b, _ in starts], side="right")
    shard_rows = np.array([0, *(r for _, _, r in firsts)], np.int64)
    base = np.array([r for _, _, r in starts], np.int64) - shard_rows[shard_of]
    bounds = _to_bytes([k for k, _, _ in starts[1:]])

    @F.pandas_udf("cell int, shard int, base long")
    def place(order: pd.Series) -> pd.DataFrame:
        cell = np.searchsorted(bounds, np.array(order.tolist(), f"S{KEY_BYTES}"), side="right")
        return pd.DataFrame({"cell": cell.astype(np.int32), "shard": shard_of[cell].astype(np.int32), "base": base[cell]})

    placed = kept.withColumn("at", place("order"))
    moved = placed.select("doc", "size", "order", F.col("at.cell").alias("cell"), F.col("at.shard").alias("shard"), F.col("at.base").alias("base"))
    moved = moved.repartitionById(parts, "cell")
    slot = F.col("base") + F.row_number().over(W.partitionBy("cell").orderBy("order")) - 1
    ranked = moved.withColumn("slot", slot)
    own = [F.col("doc")[c].alias(c) for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    return ranked.select(*own, "size", "shard", "slot")
