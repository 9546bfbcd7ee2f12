"""Substring dedup: paragraphs by MinHash banding, and passages inside paragraphs by content-defined blocks.

A paragraph is a line of at least `min_words` words. Its five-word shingles are min-hashed into BANDS bands of
ROWS rows, which find a pair of similarity 0.8 with probability 0.994 and one of 0.9 with 0.9999. Paragraphs that collide in a band are
compared: exact Jaccard similarity of the shingle sets, from 0.8 on a link; links make components.

A copied passage can also begin and end in the middle of lines. So every text is cut as well into blocks where
the hash of two neighbouring words is the least for five words on either side, which a copy repeats wherever it
stands. Blocks that occur again, in unbroken runs of at least `min_run` words, are passages.

Of each class the first occurrence, by key and place, is kept, and the others are removals. Words are
lower-cased and separated by white space. Null and empty texts have no paragraphs. Repeated rows with the same
key are occurrences of the same place; each keeps its rows. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptstrata.llm.common import Scratch, components, short_batches, small_side, sorted_runs
from conceptstrata.session import task_count

SHINGLE = 5
BANDS, ROWS = 5, 2
SIMILARITY = 0.8
MIN_WORDS = 10
REACH = 5  # words on either side of a cut
MIN_RUN = 30
TILE = 256  # colliding paragraphs compared in one go
BLOCK_CHARS = 1 << 20
KNOWN_WORDS = 500_000
BIG = np.uint64(0xFFFFFFFFFFFFFFFF)
ODD = [np.uint64(xxhash.xxh64_intdigest(b"row", i) | 1) for i in range(BANDS * ROWS)]
STEP = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, np.uint64))
# The characters at which Python splits words.
WHITE = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
IS_WHITE = np.isin(np.arange(0x3002), WHITE)  # the last entry stands for all characters beyond
HASHES: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    if len(HASHES) > KNOWN_WORDS:
        HASHES.clear()
    HASHES.update((w, xxhash.xxh64_intdigest(w)) for w in set(words).difference(HASHES))
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * STEP
    return x ^ (x >> np.uint64(29))


def places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and its line."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    white = np.concatenate(([True], IS_WHITE[np.minimum(codes, len(IS_WHITE) - 1)], [True]))
    turns = np.flatnonzero(white[1:] != white[:-1])
    starts, ends = turns[::2], turns[1::2]
    return starts, ends, np.searchsorted(np.flatnonzero(codes == 10), starts)


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    count = max(len(hashes) - size + 1, 0)
    out = np.zeros(count, np.uint64)
    for i in range(size):
        out = mixed(out + hashes[i : i + count])
    return out


def sequence_hashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the words from each start to the next one."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    inside = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
    return mixed(np.add.reduceat(hashes * POWERS[inside % len(POWERS)], starts))


def block_starts(hashes: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Words that begin a block: the first one, and those whose pair hash is the least around."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    pair = np.full(n + 2 * reach, BIG)
    pair[reach + 1 : reach + n] = mixed(hashes[:-1] * STEP + hashes[1:])
    centre = pair[reach : reach + n]
    least = centre < BIG
    for d in range(1, reach + 1):
        least &= (centre <= pair[reach + d : reach + d + n]) & (centre < pair[reach - d : reach - d + n])
    least[0] = True
    return np.flatnonzero(least)


def bands(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band keys (paragraph x band) of the shingles that begin at each start."""
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(starts), 1))
    for b in range(BANDS):
        for r in range(ROWS):
            least = np.minimum.reduceat(mixed(values * ODD[b * ROWS + r]), starts)
            keys[:, b] = mixed(keys[:, b] + least)
    return keys


def units(text: str, min_words: int) -> tuple[list[tuple], list[tuple], np.ndarray]:
    """Paragraphs and blocks as (start, end, words, hash), and the band keys of the paragraphs."""
    starts, ends, lines = places(text)
    hashes = word_hashes(text.lower().split()) if len(starts) else np.zeros(0, np.uint64)
    if len(hashes) != len(starts):  # lower-casing never adds white space; kept for safety of the places
        hashes = word_hashes([text[a:b].lower() for a, b in zip(starts, ends)])
    n = len(hashes)
    if not n:
        return [], [], np.zeros((0, BANDS), np.uint64)
    first = np.flatnonzero(np.append(True, lines[1:] != lines[:-1]))
    sizes = np.diff(np.append(first, n))
    named = sequence_hashes(hashes, first)
    long = np.flatnonzero(sizes >= max(min_words, SHINGLE))
    keys = np.zeros((0, BANDS), np.uint64)
    if len(long):
        all_shingles = shingles(hashes)
        counts = sizes[long] - SHINGLE + 1
        offsets = np.concatenate(([0], np.cumsum(counts)[:-1]))
        at = np.arange(counts.sum()) - np.repeat(offsets, counts) + np.repeat(first[long], counts)
        keys = bands(all_shingles[at], offsets)
    last = first + sizes - 1
    paragraphs = list(zip(starts[first[long]].tolist(), ends[last[long]].tolist(), sizes[long].tolist(), named[long].view(np.int64).tolist()))
    cut = block_starts(hashes)
    stop = np.append(cut[1:], n) - 1
    blocks = list(zip(starts[cut].tolist(), ends[stop].tolist(), (stop - cut + 1).tolist(), sequence_hashes(hashes, cut).view(np.int64).tolist()))
    return paragraphs, blocks, keys


def unit_rows(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(key, is_block, seq, begin, end, words, h, bands, line): paragraphs carry bands and their text, blocks do not."""
    schema = T.StructType(docs.select(key).schema.fields[:])
    for name in ("is_block", "seq", "begin", "end", "words"):
        schema = schema.add(name, T.BooleanType() if name == "is_block" else T.IntegerType())
    schema = schema.add("h", T.LongType()).add("bands", T.ArrayType(T.LongType())).add("line", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out, keys, lines, size = [], [], [], [], 0
            for r, value in enumerate(batch.column(1)):
                content = value.as_py() or ""
                paragraphs, blocks, own = units(content, min_words)
                rows += [r] * (len(paragraphs) + len(blocks))
                out += [(False, i, *p) for i, p in enumerate(paragraphs)] + [(True, i, *b) for i, b in enumerate(blocks)]
                keys += [*own.view(np.int64).tolist(), *[None] * len(blocks)]
                lines += [*[content[a:b] for a, b, _, _ in paragraphs], *[None] * len(blocks)]
                size += len(content)
                if size > BLOCK_CHARS or r == batch.num_rows - 1:
                    kinds = [pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                    parts = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
                    ids = batch.column(0).take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *parts, pa.array(keys, pa.list_(pa.int64())), pa.array(lines, pa.string())], schema.names)
                    rows, out, keys, lines, size = [], [], [], [], 0

    return docs.select(key, text).mapInArrow(run, schema)


def similar_links(paragraphs: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of hashes of different paragraphs with at least this Jaccard similarity.

    They span the components of each band key's paragraphs. Keys that hold the same paragraphs are compared
    once; the paragraphs of a crowded key are dealt to tiles, and every two tiles meet.
    """
    spark = paragraphs.sparkSession
    distinct = paragraphs.select("h", "bands").dropDuplicates(["h"])
    keyed = distinct.select("h", F.explode("bands").alias("band"))  # the band's number is part of its key
    keys = keyed.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.shiftright("h", 20)).alias("s"))
    crowded = keys.where("n > 1").groupBy("n", "x", "s").agg(F.min("band").alias("band")).select("n", "band")
    tiles = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    members = scratch.keep(keyed.join(crowded, "band"), "members")
    names = scratch.keep(members.select("h").distinct(), "colliding")
    texts = paragraphs.select("h", "line").join(small_side(names), "h", "left_semi").dropDuplicates(["h"])
    group = ["band", "ti", "tj"]
    paired = (
        members.withColumn("tiles", tiles)
        .withColumn("mine", F.pmod(F.xxhash64("h"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("h", "band", F.least("mine", "other").alias("ti"), F.greatest("mine", "other").alias("tj"))
    )
    dealt = paired.join(texts, "h").repartition(task_count(spark), *group).sortWithinPartitions(*group, "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, group):
            frame = table.to_pandas()
            found: list[tuple[int, int]] = []
            for _, own in frame.groupby(group, sort=False):
                own = own.drop_duplicates("h")
                sets = [set(shingles(word_hashes(line.lower().split())).tolist()) for line in own["line"]]
                found += spanning_pairs(own["h"].tolist(), sets, similarity)
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    columns = [*group, "h", "line"]
    return dealt.select(*columns).mapInArrow(run, "a long, b long").distinct()


def spanning_pairs(names: list[int], sets: list[set], similarity: float) -> list[tuple[int, int]]:
    """Pairs that span the components; two paragraphs already connected are not compared again."""
    label = list(range(len(names)))
    members = {i: [i] for i in label}
    pairs = []
    for i in range(1, len(names)):
        for j in range(i):
            if label[i] == label[j]:
                continue
            a, b = sets[i], sets[j]
            small, large = sorted((len(a), len(b)))
            if small < similarity * large:
                continue
            common = len(a & b)
            if common >= similarity * (small + large - common):
                pairs.append((names[i], names[j]))
                keep, gone = sorted((label[i], label[j]))
                for m in members[gone]:
                    label[m] = keep
                members[keep] += members.pop(gone)
    return pairs


def repeated_passages(blocks: DataFrame, key: str, min_run: int, scratch: Scratch) -> DataFrame:
    """Blocks that occur again, in unbroken runs of at least min_run words, with the first place of the block."""
    place = F.struct(F.col(key).alias("key"), F.col("begin").alias("begin"))
    often = scratch.keep(blocks.groupBy("h").count().where("count > 1").select("h"), "often")
    again = scratch.keep(blocks.join(small_side(often), "h"), "again")
    firsts = again.groupBy("h").agg(F.min(place).alias("first"))
    again = again.join(firsts, "h")
    order = W.partitionBy(key).orderBy("seq")
    run = again.withColumn("run", F.col("seq") - F.dense_rank().over(order))
    total = F.sum("words").over(W.partitionBy(key, "run"))
    return run.withColumn("total", total).where(F.col("total") >= min_run)


def removals(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    min_run: int = MIN_RUN,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(key, begin, end, n_words, kind, class_key, class_begin, removed): every occurrence in a class of several.

    The class is named by its first occurrence, which is kept. Places count characters from 0, the end excluded.
    """
    spark = docs.sparkSession
    short_batches(spark)
    scratch = Scratch(spark)
    rows = scratch.keep(unit_rows(docs, key, text, min_words), "units")
    paragraphs, blocks = rows.where(~F.col("is_block")), rows.where("is_block").select(key, "seq", "begin", "end", "words", "h")
    found = components(scratch.keep(similar_links(paragraphs, similarity, scratch), "links"), scratch)
    place = F.struct(F.col(key).alias("key"), F.col("begin").alias("begin"))
    exact = paragraphs.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    rooted = exact.join(found, exact.h == found.node, "left").select("h", "n", "first", F.coalesce("root", "h").alias("root"), F.col("root").isNotNull().alias("linked"))
    rooted = scratch.keep(rooted.where("n > 1 or linked"), "classes")
    classes = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.join(classes.withColumnRenamed("first", "class"), "root").select("h", "class")
    columns = [key, "begin", "end", F.col("words").alias("n_words")]
    lines = paragraphs.select(key, "begin", "end", "words", "h").join(named, "h").select(*columns, F.lit("paragraph").alias("kind"), "class")
    inner = repeated_passages(blocks, key, min_run, scratch).select(*columns, F.lit("passage").alias("kind"), F.col("first").alias("class"))
    result = lines.unionByName(inner)
    return result.select(
        key, "begin", "end", "n_words", "kind", F.col("class.key").alias("class_key"), F.col("class.begin").alias("class_begin"), (place != F.col("class")).alias("removed")
    )
