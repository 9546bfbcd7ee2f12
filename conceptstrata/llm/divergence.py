"""Source divergence audit: how far the sources of a language differ in their use of its terms, in exact integers.

Every (lang, source) group, and each lang, gives each term of the lang that at least `min_docs` documents hold the
smoothed share p = 1 + floor(10^9 (count + 2) / (N + 2 V)); two shares differ by floor((p - q)^2 / (p + q)).

Pairs are summed by Gustavson's row-wise product. The index is term-major: a row has the groups that use the term, with
their shares. A task takes the rows of a group in its part of the index and scatters them, term by term, into a dense
accumulator with a place per peer, so no pair of postings is ever written. A term that a group does not use has
the group's baseline share, not zero: the sum over all V terms is

    V f(b_g, b_h) + sum over g's terms of f(p_g, b_h) - f(b_g, b_h), the same for h's terms,
    + sum over common terms of f(p_g, p_h) - f(p_g, b_h) - f(b_g, p_h) + f(b_g, b_h).

The second and third sum need the shares of one group and the baselines of its peers only. The last is what the
accumulators hold. Tasks hand on one number per pair of groups; the result has a row for each of them anyway.

Texts are counted per task in bounded tables before anything is shuffled, so a source with most of the rows costs no
task more than others. A null text, lang or source reads as ''. Groups without terms, and langs without kept terms (all
values 0), have their pairs. Repeated rows are documents of their own. Other columns are not read, so names cannot
clash. An empty table gives no rows. A text is split as a whole, in one task; its terms need some times its size there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptstrata.llm.common import Scratch, short_batches, small_side

SCALE = 1_000_000_000
HELD_TERMS = 400_000  # counted terms that a task holds before it hands them on
FLAT_CELLS = 1 << 20  # cells computed at once
# Bytes of terms, A-Z as lower case: letters and all bytes of characters beyond ASCII. The others end a term.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _table(lang: str, source: str, held: Counter, docs: Counter) -> pa.RecordBatch:
    """Counts of a group's terms; a row without a term says that the group occurs."""
    terms = pa.array([*held], pa.binary()).view(pa.string())  # cut between characters, so whole ones
    n, d = pa.array([*held.values()], pa.int64()), pa.array([docs[t] for t in held], pa.int64())
    rows = len(held) + 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * rows, pa.string()),
            pa.array([source] * rows, pa.string()),
            pa.concat_arrays([terms, pa.nulls(1, pa.string())]),
            pa.concat_arrays([n, pa.array([0], pa.int64())]),
            pa.concat_arrays([d, pa.array([0], pa.int64())]),
        ],
        ["lang", "source", "term", "n", "docs"],
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        for *group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            terms = text.translate(TERM_BYTES).split()
            n, docs = groups.setdefault(tuple(group), (Counter(), Counter()))
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in groups.values()) > HELD_TERMS:
            yield from (_table(*group, *held) for group, held in groups.items())
            groups = {}
    yield from (_table(*group, *held) for group, held in groups.items())


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents per term, and a row with a null term per group."""
    short_batches(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    parts = read.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), in decimals that hold any sum; 1 where there are no terms."""
    whole = f"CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(20,0)) div CAST({total} + 2 * {terms} AS DECIMAL(20,0))"
    return F.expr(f"CASE WHEN {terms} = 0 THEN 1L ELSE 1L + ({whole}) END")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)  # shares are at most 10^9 + 1, so squares fit 64 bits


def _baselines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, g, peers): per peer h, the sum over g's terms of f(p_g, b_h) - f(b_g, b_h)."""
    for batch in batches:
        for lang, g, base, shares, times, peers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            p, n, b = np.array(shares, np.int64), np.array(times, np.int64), np.array(peers, np.int64)
            total = -n.sum() * _apart(np.int64(base), b)
            step = max(1, FLAT_CELLS // max(1, len(b)))
            for at in range(0, len(p), step):
                total += n[at : at + step] @ _apart(p[at : at + step, None], b[None, :])
            yield pa.RecordBatch.from_pydict({"lang": [lang], "g": pa.array([g], pa.int32()), "peers": [total.tolist()]})


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, g, h, v): corrections for the terms that both groups use, g < h, summed over this part of the index."""
    sums: dict[str, dict[int, np.ndarray]] = {}  # lang -> group -> accumulator, a place per later peer
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        langs = np.array(batch.column(0).to_pylist(), object)
        postings = batch.column(1)
        flat, cuts = postings.values, postings.offsets.to_numpy()
        gid, p, b = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        sizes = np.diff(cuts)
        term = np.repeat(np.arange(len(sizes)), sizes)  # of a posting; a sliced array has its own first offset
        where = np.arange(cuts[0], cuts[-1])
        for lang in dict.fromkeys(langs):
            mine = where[(langs == lang)[term]]
            order = mine[np.argsort(gid[mine], kind="stable")]
            edges = np.flatnonzero(np.diff(gid[order], prepend=-1))
            width = int(gid[mine].max()) + 1
            rows = sums.setdefault(lang, {})
            for a, z in zip(edges, [*edges[1:], len(order)], strict=True):
                row = order[a:z]  # the group's postings, in term order
                g, spans = int(gid[row[0]]), sizes[term[row - cuts[0]]]
                starts = cuts[term[row - cuts[0]]]
                ends = np.cumsum(spans)
                peer = np.repeat(starts - (ends - spans), spans) + np.arange(ends[-1])
                pg = np.repeat(p[row], spans)
                later = gid[peer] > g
                peer, pg = peer[later], pg[later]
                if not len(peer):
                    continue
                acc = rows.get(g)
                if acc is None or len(acc) < width:
                    grown = np.zeros(width, np.int64)
                    if acc is not None:
                        grown[: len(acc)] = acc
                        held -= len(acc)
                    acc = rows[g] = grown
                    held += width
                bg = b[row[0]]
                np.add.at(acc, gid[peer], _apart(pg, p[peer]) - _apart(pg, b[peer]) - _apart(bg, p[peer]) + _apart(bg, b[peer]))
        if held > 4 * FLAT_CELLS:
            yield from _flush(sums)
            sums, held = {}, 0
    yield from _flush(sums)


def _flush(sums: dict[str, dict[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, rows in sums.items():
        for g, acc in rows.items():
            h = np.flatnonzero(acc)
            columns = [pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), g, np.int32)), pa.array(h.astype(np.int32)), pa.array(acc[h])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "g", "h", "v"])


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows for each other source, `term` rows for the leading terms."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.keep(term_counts(docs, lang, source, text), "term-counts")
    in_lang = W.partitionBy("lang", "term")  # at most one row per source
    terms = counts.where("term IS NOT NULL").withColumn("in_docs", F.sum("docs").over(in_lang)).withColumn("lang_count", F.sum("n").over(in_lang))
    kept = scratch.keep(terms.where(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "lang_count"), "kept-terms")

    per_lang = kept.dropDuplicates(["lang", "term"]).groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("lang_size"))
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = (
        counts.where("term IS NULL").select("lang", "source").join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
    ).na.fill(0, ["size", "v", "lang_size"])
    groups = groups.withColumn("b", share("0", "size", "v")).withColumn("g", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    groups = scratch.keep(groups, "groups")
    known = small_side(groups)

    shares = kept.join(known, ["lang", "source"]).withColumn("p", share("n", "size", "v"))
    # Gustavson: dense accumulators over the term-major index
    index = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "b")).alias("postings"))
    common = index.select("lang", "postings").mapInArrow(_scatter, "lang string, g int, h int, v bigint")
    # baselines: a group's distinct shares against its peers' baselines
    peers = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "b"))), lambda x: x["b"]).alias("peers"))
    spread = shares.groupBy("lang", "g", "p").agg(F.count("*").alias("times"))
    spread = spread.groupBy("lang", "g").agg(F.collect_list(F.struct("p", "times")).alias("s"))
    rows = groups.join(spread, ["lang", "g"], "left").join(peers, "lang")
    none = F.array().cast("array<bigint>")
    rows = rows.select("lang", "g", "b", F.coalesce(F.col("s.p"), none).alias("p"), F.coalesce(F.col("s.times"), none).alias("times"), "peers")
    own = rows.mapInArrow(_baselines, "lang string, g int, peers array<bigint>").select("lang", "g", F.posexplode("peers").alias("h", "v"))
    both = own.where("g <> h").select("lang", F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"), "v").unionByName(common)
    sums = both.groupBy("lang", "g", "h").agg(F.sum("v").alias("v"))
    one = known.select("lang", "g", F.col("source").alias("one"), F.col("b").alias("b1"), F.col("v").alias("terms"))
    two = known.select("lang", F.col("g").alias("h"), F.col("source").alias("two"), F.col("b").alias("b2"))
    pairs = sums.join(one, ["lang", "g"]).join(two, ["lang", "h"]).withColumn("value", F.col("v") + F.col("terms") * apart("b1", "b2"))
    ways = F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))
    pairs = pairs.select("lang", "value", F.inline(ways)).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    leading = shares.withColumn("q", share("lang_count", "lang_size", "v")).where("p > q")
    leading = leading.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart("p", "q").alias("value"))
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(leading.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))
