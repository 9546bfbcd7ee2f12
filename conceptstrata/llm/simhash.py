"""SimHash near-duplicates: whole-text fingerprints, blocked candidates, bit-sliced comparison, components.

Nulls and texts without words have the fingerprint zero and are linked like any other. Repeated rows and
repeated ids each keep a row; a null id keeps its row, and its component is the smallest id that is reachable.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptstrata.llm.common import Scratch, components, short_batches, sorted_runs
from conceptstrata.session import task_count

SEED = 42
CHUNK = 1 << 14  # shingles counted at a time
PARTS = 5  # a pair within 3 bits agrees on at least two of five parts
TILE = 4096  # fingerprints of one candidate key compared in one go


def fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode().lower().split()  # bytes: only A-Z fold, only 0x20 and 0x09-0x0D split
    if not words:
        return 0
    size = min(shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = list(zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), CHUNK):
        part = spans[at : at + CHUNK]
        h = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(spans)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp): the 64-bit fingerprint of every row, as a signed long."""
    schema = docs.select(key).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], [key, "fp"])

    return docs.select(key, text).mapInArrow(run, schema)


def exceeds(targets: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Rows of booleans per query: is the target further away than the radius?

    The targets lie as 64 vertical bit planes. A query adds plane after plane to vertical counters with
    carry-save steps; `over` marks what has passed the radius, and queries for which all have are abandoned.
    """
    n = len(targets)
    planes = np.packbits(np.unpackbits(targets.view(np.uint8).reshape(n, 8), axis=1, bitorder="little"), axis=0, bitorder="little")
    planes = np.pad(planes, ((0, -len(planes) % 8), (0, 0))).T.copy().view(np.uint64)  # 64 planes of words
    width = planes.shape[1]
    levels = max(1, int(radius).bit_length())
    start = (1 << levels) - 1 - radius  # counters begin so that the carry out of the top bit means "beyond"
    result = np.zeros((len(queries), width), np.uint64)
    live = np.arange(len(queries))
    flip = np.where((queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ~np.uint64(0), np.uint64(0))
    counters = [np.full((len(queries), width), ~np.uint64(0) if start >> k & 1 else 0, np.uint64) for k in range(levels)]
    over = np.zeros((len(queries), width), np.uint64)
    if n % 64:
        over[:, -1] = ~np.uint64(0) << np.uint64(n % 64)  # padding counts as beyond
    for p in range(64):
        carry = planes[p][None, :] ^ flip[live, p][:, None]
        for k in range(levels):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p % 8 == 7:
            going = ~(over == ~np.uint64(0)).all(axis=1)
            if not going.all():
                result[live[~going]] = over[~going]
                live, over = live[going], over[going]
                counters = [c[going] for c in counters]
                if not len(live):
                    break
    result[live] = over
    return np.unpackbits(result.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def spanning_links(fps: np.ndarray, radius: int, chunk: int = 256) -> list[tuple[int, int]]:
    """Index pairs within the radius that span the components of the fingerprints."""
    n = len(fps)
    label, links = np.arange(n), []
    for at in range(1, n, chunk):
        rows = np.arange(at, min(at + chunk, n))
        upto = int(rows[-1])  # earlier fingerprints only: each pair is looked at once
        near = ~exceeds(fps[:upto], fps[rows], radius)
        near &= np.arange(upto)[None, :] < rows[:, None]
        for r in np.flatnonzero(near.any(axis=1)):
            i, js = int(rows[r]), np.flatnonzero(near[r])
            groups, first = np.unique(label[js], return_index=True)
            fresh = groups != label[i]
            if fresh.any():
                links += [(i, int(js[f])) for f in first[fresh]]
                joined = np.append(groups, label[i])
                label[np.isin(label, joined)] = joined.min()
    return links


def candidate_masks(parts: int, radius: int) -> list[int]:
    cuts = [64 * i // parts for i in range(parts + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in itertools.combinations(blocks, parts - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = 3, parts: int = PARTS) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within the radius that span every component.

    Two fingerprints within the radius agree on parts - radius of the parts, so they share a key of one of
    the masks. Keys of one fingerprint fall away; keys above TILE fingerprints are compared tile by tile.
    """
    masks = candidate_masks(parts, radius)
    keyed = distinct.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)])).alias("k"),
    ).select("fp", "k.mask", "k.part")
    crowded = keyed.groupBy("mask", "part").count().where("count > 1")
    tiles = F.ceil(F.col("count") / F.lit(TILE)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = (
        keyed.join(crowded, ["mask", "part"])
        .withColumn("tiles", tiles)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("fp", "mask", "part", F.least("mine", "other").alias("ti"), F.greatest("mine", "other").alias("tj"))
    )
    keys = ["mask", "part", "ti", "tj"]
    spark = distinct.sparkSession
    dealt = dealt.repartition(task_count(spark), *keys).sortWithinPartitions(*keys, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, keys):
            fps = table["fp"].to_numpy().view(np.uint64)
            columns = [table[k].to_numpy() for k in keys]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            # Small groups share one bit-sliced block: a hit across groups is a true link too.
            at, cuts = 0, [*new.tolist(), len(fps)]
            for stop, following in zip(cuts, [*cuts[1:], None]):
                if following is not None and following - at <= 256:
                    continue
                block = np.unique(fps[at:stop])
                found = spanning_links(block, radius)
                at = stop
                if found:
                    a, b = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(block[a].view(np.int64)), pa.array(block[b].view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(key, fingerprint, component_id) per row; documents link within `radius` differing bits."""
    spark = docs.sparkSession
    short_batches(spark)
    scratch = Scratch(spark)
    printed = scratch.keep(fingerprints(docs, key, text, shingle), "simhash")
    distinct = printed.groupBy("fp").agg(F.min(key).alias("first"))
    found = components(links(distinct.select("fp"), radius), scratch)
    linked = distinct.join(found, distinct.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = scratch.keep(linked, "simhash-linked")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = linked.join(smallest, "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return printed.join(classes, "fp").select(key, hexed, "component_id")
