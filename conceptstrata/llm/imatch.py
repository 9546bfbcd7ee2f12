"""I-Match fingerprints of documents over randomised lexicon subsets, with DataFrame functions only.

Terms are runs of letters and digits, lower-cased. The lexicon holds the terms within a band of inverse
document frequency, counted over all documents. Its randomised subsets lie on levels: level l keeps a term with
chance 2^-l and deals the kept terms to SLICES subsets. A document uses LEVELS levels, the lowest by the number of
its lexicon terms, such that LEAST_TERMS or all of them lie on it; for each subset that holds any of its terms,
the distinct terms are sorted and hashed. The fingerprint lists `level.slice:hash`. The likeness of two fingerprints is the share of subsets with
the same hash among the subsets that either has; equal texts have equal fingerprints and likeness 1.

A null text is an empty one. A text without lexicon terms has an empty fingerprint, whose likeness to another
is 1 if the texts are equal, else 0. Repeated rows each keep a row. Rows with a null key come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptstrata.llm.common import Scratch, let

SLICES = 16
LEVELS = 3
TERMS = 24  # terms of a document on its lowest level, about
LEAST_TERMS = 6
MAX_SHARE = 0.02  # terms of more than this share of the documents are outside the band
MIN_DOCS = 1
WORDS = r"[^\p{L}\p{N}]+"


def term_hashes(text: Column) -> Column:
    """Distinct hashed terms of a text."""
    words = F.filter(F.split(F.lower(text), WORDS), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def on_level(term: Column, level: Column) -> Column:
    """The lowest `level` bits of the term's hash are zero."""
    return term.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1) == 0


def lowest_level(terms: Column) -> Column:
    """The level on which a document of these lexicon terms has half of TERMS to TERMS, about; level 0 has all terms."""
    aim = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(terms), F.lit(1)) / F.lit(TERMS)))).cast("int")
    return F.array_max(F.filter(F.sequence(F.lit(0), aim), lambda v: (v == 0) | (F.size(F.filter(terms, lambda t: on_level(t, v))) >= LEAST_TERMS)))


def levelled(terms: Column) -> Column:
    """Structs (level, term) of the lexicon terms on the document's levels."""

    def on(level: Column) -> Column:
        return F.transform(F.filter(terms, lambda t: on_level(t, level)), lambda t: F.struct(level.alias("level"), t.alias("term")))

    return let(lowest_level(terms), lambda low: F.concat(*[on(low + i) for i in range(LEVELS)]))


def lexicon_edges(docs: DataFrame, text: str, max_share: float, min_docs: int) -> tuple[DataFrame, DataFrame | None]:
    """Terms outside the band: the common ones, and those of under `min_docs` documents (None if there is no such bound).

    At most (terms of a document, in the mean) / max_share terms can be common, whatever the number of documents.
    """
    counts = docs.select(F.explode(term_hashes(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy("term").count()
    total = docs.count()
    common = counts.where(F.col("count") > F.lit(max(max_share * total, min_docs))).select("term")
    rare = counts.where(F.col("count") < min_docs).select("term") if min_docs > 1 else None
    return common, rare


def neighbours(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """(bucket, at, key, text, follower): every row with the text of the next one in descending key order.

    Rows go to ascending key ranges by value, and one row more stands at each range's end: the first row of
    the range that follows. After the last row of all comes the first.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = rows.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    rows = rows.withColumn("bucket", F.coalesce(part, F.lit(-1)).cast("int"))
    order = [F.col("ending"), F.desc_nulls_last(key), F.desc("text")]
    heads = rows.groupBy("bucket").agg(F.max(key).alias(key)).collect()  # one row per range
    ranges = sorted((h["bucket"] for h in heads), reverse=True)
    if not ranges:
        return rows.select("bucket", F.lit(0).alias("at"), key, "text", F.col("text").alias("follower"))
    before = {ranges[(i + 1) % len(ranges)]: b for i, b in enumerate(ranges)}  # head's range -> range it ends
    tops = rows.where(F.col(key).isin([h[key] for h in heads if h[key] is not None]) | F.col(key).isNull())
    first = W.partitionBy("bucket").orderBy(F.desc_nulls_last(key), F.desc("text"))
    mapped = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    tops = tops.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    endings = tops.withColumn("bucket", mapped[F.col("bucket")]).withColumn("ending", F.lit(True))
    together = rows.withColumn("ending", F.lit(False)).unionByName(endings)
    window = W.partitionBy("bucket").orderBy(*order)
    return (
        together.withColumn("follower", F.lead("text").over(window))
        .withColumn("at", F.row_number().over(window))
        .where(~F.col("ending"))
        .select("bucket", "at", key, "text", "follower")
    )


def fingerprint_terms(terms: Column) -> Column:
    """Per subset, the hash of its sorted distinct terms. `terms`: structs (level, term)."""
    slots = F.array_sort(
        F.array_distinct(
            F.transform(
                terms,
                lambda t: F.struct(
                    (t["level"] * F.lit(SLICES) + F.pmod(F.shiftright(t["term"], 40), F.lit(SLICES)).cast("int")).alias("slot"), t["term"].alias("term")
                ),
            )
        )
    )

    def lines(sorted_slots: Column) -> Column:
        def line(slot: Column) -> Column:
            own = F.transform(F.filter(sorted_slots, lambda s: s["slot"] == slot), lambda s: F.hex(s["term"]))
            where = F.concat_ws(".", F.floor(slot / SLICES).cast("string"), (slot % SLICES).cast("string"))
            return F.concat(where, F.lit(":"), F.substring(F.md5(F.concat_ws(" ", own)), 1, 8))

        return F.concat_ws(" ", F.transform(F.array_distinct(sorted_slots["slot"]), line))

    return let(slots, lines)


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Share of equal subsets among those of either fingerprint."""
    def share_of(lines: Column) -> Column:
        slots = [F.transform(lines[i], lambda s: F.substring_index(s, ":", 1)) for i in (0, 1)]
        return F.try_divide(F.size(F.array_intersect(lines[0], lines[1])), F.size(F.array_union(*slots)))

    share = let(F.array(*[F.filter(F.split(x, " "), lambda s: s != "") for x in (a, b)]), share_of)
    return F.when(equal, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0)))


def fingerprints(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    max_share: float = MAX_SHARE,
    min_docs: int = MIN_DOCS,
    buckets: int | None = None,
) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n / 2) characters replaced by the first as many of the next document.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    common, rare = lexicon_edges(docs, text, max_share, min_docs)
    common = scratch.keep(common, "imatch-common")
    pairs = neighbours(docs, key, text, buckets)
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    made = pairs.select(
        "bucket",
        "at",
        key,
        n.alias("n_chars"),
        "text",
        F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("follower"), F.lit(1), half)).alias("edited"),
    ).select("bucket", "at", key, "n_chars", "text", "edited", F.sha2("edited", 256).alias("edited_sha256"), F.sha2("text", 256).alias("sha"))

    about = F.struct(key, "n_chars", "edited_sha256", "sha")

    def of_kind(column: str, kind: int) -> Column:
        none = F.when(F.lit(False), about)
        return F.transform(term_hashes(F.col(column)), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term"), none.alias("about")))

    # Every lexicon term is needed to choose the level. One row a document has the other columns, so that the rest are narrow.
    one = F.array(F.struct(F.lit(0).alias("kind"), F.lit(None).cast("long").alias("term"), about.alias("about")))
    rows = made.select("bucket", "at", F.explode(F.concat(of_kind("text", 0), of_kind("edited", 1), one)).alias("t")).select("bucket", "at", "t.*")
    # The bound on the common terms is the one in lexicon_edges; beyond it Spark would shuffle for this join.
    outside = F.broadcast(common.withColumn("outside", F.lit(True)))
    rows = rows.join(outside, "term", "left").where("outside is null").drop("outside")
    if rare is not None:
        rows = rows.join(rare, "term", "left_anti")
    groups = rows.groupBy("bucket", "at").agg(
        F.first("about", ignorenulls=True).alias("about"), *[F.collect_list(F.when(F.col("kind") == kind, F.col("term"))).alias(f"terms{kind}") for kind in (0, 1)]
    )
    printed = groups.select(
        "bucket",
        "at",
        "about.*",
        fingerprint_terms(levelled(F.col("terms0"))).alias("fingerprint"),
        fingerprint_terms(levelled(F.col("terms1"))).alias("edited_fingerprint"),
    )
    printed = scratch.keep(printed, "imatch")
    return next_likeness(printed, key)


def next_likeness(printed: DataFrame, key: str) -> DataFrame:
    """Adds the likeness to the edited text and to the next document, whose fingerprint ends each range."""
    ranges = sorted((r[0] for r in printed.select("bucket").distinct().collect()), reverse=True)
    window = W.partitionBy("bucket").orderBy("ending", "at")
    rows = printed.withColumn("ending", F.lit(False))
    if ranges:
        before = {ranges[(i + 1) % len(ranges)]: b for i, b in enumerate(ranges)}
        mapped = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        endings = printed.where("at = 1").withColumn("bucket", mapped[F.col("bucket")]).withColumn("ending", F.lit(True))
        rows = rows.unionByName(endings)
    rows = rows.withColumn("next", F.lead(F.struct("fingerprint", "sha")).over(window)).where(~F.col("ending"))
    return rows.select(
        key,
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), F.col("sha") == F.col("edited_sha256")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next.fingerprint"), F.col("sha") == F.col("next.sha")).alias("near_next"),
    )
