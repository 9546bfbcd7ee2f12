"""Best-fit packing of whole documents into token sequences, with bound-certified repacking.

Only documents longer than a sequence are cut. Pieces are dealt to groups of bounded size; each group packs
its pieces by best-fit decreasing and compares the number of sequences with a lower bound from dual-feasible
functions. Groups that meet their bound are certified and stay. The others exchange their documents: they are
dealt anew and packed again, and a round counts only if it needs no more sequences than the one before.

Null and empty texts have one token, the end id. Repeated rows are packed as often as they occur. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptstrata.llm.common import Scratch, short_batches
from conceptstrata.llm.tokens import encoder

GROUP = 50_000  # pieces that one task packs, in the mean
ROUNDS = 3


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece. Bins wait in stacks by free space; a bit mask finds the tightest fit."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, opened = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = spaces >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            stack = waiting[free]
            chosen = stack.pop()
            if not stack:
                spaces &= ~(1 << free)
        else:
            chosen, free, opened = opened, capacity, opened + 1
        bins[i], offsets[i] = chosen, capacity - free
        left = free - size
        if left:
            waiting[left].append(chosen)
            spaces |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Least number of bins by dual-feasible functions: no set of pieces that fits a bin sums to over 1 under f.

    Three families: the identity; the threshold functions (pieces above capacity - t count as whole bins,
    those below t as nothing); and the rounding functions u_k, f(x) = x if (k+1)x is whole, else floor((k+1)x)/k.
    """
    sizes, counts = np.unique(lengths, return_counts=True)
    if not len(sizes):
        return 0
    best = -(-int((sizes * counts).sum()) // capacity)
    ascending, total = np.cumsum(sizes * counts), int((sizes * counts).sum())
    for t in sizes[sizes <= capacity // 2].tolist():
        whole = int(counts[sizes > capacity - t].sum())
        below = int(np.searchsorted(sizes, t))
        upto = int(np.searchsorted(sizes, capacity - t, side="right"))
        middle = int(ascending[upto - 1] - (ascending[below - 1] if below else 0)) if upto else 0
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        value = np.where(exact, sizes * k, scaled // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def pieces(docs: DataFrame, tokenizer: str, key: str, text: str, end_id: int, capacity: int) -> DataFrame:
    """(key, piece, start, length, ids_crc32): every document with its end id, cut only where it is too long."""
    schema = docs.select(key).schema
    schema = schema.add("piece", T.IntegerType())
    for name in ("start", "length", "ids_crc32"):
        schema = schema.add(name, T.LongType())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaced=False).encode_all
        for batch in batches:
            rows, out = [], []
            for r, packed in enumerate(encode(t.as_py() for t in batch.column(1))):
                ids = packed + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(r)
                    out.append((p, at // 4, len(part) // 4, zlib.crc32(part)))
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            columns = [pa.array([x[i] for x in out], pa.int32() if i == 0 else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([keys, *columns], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def pack_groups(dealt: DataFrame, capacity: int) -> DataFrame:
    """Adds bin, offset and, per group, the bins used and the lower bound."""
    schema = T.StructType(dealt.schema.fields[:])
    for name in ("bin", "offset", "used", "bound"):
        schema = schema.add(name, T.LongType())

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "tie"], ascending=[False, True], kind="stable")
        lengths = group["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        return group.assign(bin=bins, offset=offsets, used=int(bins.max()) + 1, bound=lower_bound(lengths, capacity))

    return dealt.groupBy("group").applyInPandas(pack, schema)


def deal(table: DataFrame, count: int, turn: int) -> DataFrame:
    """Pieces spread over groups of about GROUP; another turn deals them otherwise."""
    groups = max(1, -(-count // GROUP))
    return table.withColumn("group", F.pmod(F.xxhash64(F.lit(turn), "tie"), F.lit(groups)).cast("long"))


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = 4096,
    end_id: int = 1,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset, certified) of every piece."""
    spark = docs.sparkSession
    short_batches(spark)
    scratch = Scratch(spark)
    cut = scratch.keep(pieces(docs, tokenizer, key, text, end_id, capacity), "pieces")
    full = cut.where(F.col("length") == capacity)
    # The tie breaks equal lengths and spreads equal rows; it need not be unique.
    waiting = cut.where(F.col("length") < capacity).withColumn("tie", F.xxhash64(key, "piece", "ids_crc32", "length"))
    placed: list[DataFrame] = []
    open_rows, state = None, (waiting.count(), 0, 0)
    for turn in range(rounds):
        count, bins, groups = state
        if not count or turn and groups < 2:
            break  # all certified, or one group, which has nobody to exchange with
        packed = pack_groups(deal(waiting, count, turn), capacity).withColumn("turn", F.lit(turn))
        packed = scratch.keep(packed, "packed")
        used = packed.select("group", "used").distinct().agg(F.sum("used")).first()[0]
        if turn and used > bins:
            scratch.drop(packed)
            break  # the exchange did not pay: the packing before it stands
        placed.append(packed.where("used = bound"))
        open_rows = packed.where("used > bound")
        waiting = open_rows.select(waiting.columns)
        state = open_rows.agg(F.count("*"), F.countDistinct("group", "bin"), F.countDistinct("group")).first()
    if open_rows is not None:
        placed.append(open_rows)
    columns = [key, "piece", "start", "length", "ids_crc32"]
    own = [F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset")]
    result = full.select(*columns, *own, F.lit(True).alias("certified"))
    # Negative numbers by turn, group and bin; sequences of one full piece have the others.
    number = -(1 + F.col("turn") * F.lit(1 << 56) + F.col("group") * F.lit(1 << 24) + F.col("bin"))
    for part in placed:
        result = result.unionByName(
            part.select(*columns, number.alias("sequence_id"), "offset", (F.col("used") == F.col("bound")).alias("certified"))
        )
    return result
