"""Line dedup over a suffix array of line ids, with DataFrame functions only.

A document is the sequence of its lines that are not blank; a line's id is a 128-bit hash of the line without
surrounding blanks, tabs and carriage returns. Lines that occur once in the corpus end every repeat, so only
chains of consecutive repeated lines enter the suffix array. Prefix doubling ranks the suffixes by their first
1, 2, 4 ... lines: a round splits each group of equal rank by the rank of the suffix k lines further on, which
leaves the other groups as they are, so no round sorts the corpus. A repeat counts from `min_chars` characters:
the least number of lines that reaches them is a suffix's depth, and the suffixes that agree to that depth are
an interval of longest common prefixes. In every interval the first copy, by key and line, stays; the lines of
later copies are deleted. A run goes on to its end: where the next suffix is no later copy, the lines beyond the
depth (its tail, under `min_chars` characters after the first line) are compared line by line within the interval,
and those that an earlier copy has as well are deleted too. So every line of a maximal run goes.

A null text stays null. Blank lines stay where they are, unless everything else in the document goes: then the
text is empty. Rows with the same key and text are one document to the counts, and each keeps its row.
A null key is a key, the smallest. An empty table gives no rows. However long a text, its lines are rows of their own
until the kept ones are joined again. A column named `runs` is replaced; other extra columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptstrata.llm.common import Scratch

MIN_CHARS = 100
BLANKS = " \t\r"


def bare_lines(text: Column) -> Column:
    """Structs (line, bare) of all lines of a text."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.btrim(x, F.lit(BLANKS)).alias("bare")))


def line_ids(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, th, idx, h1, h2, size): the lines that are not blank, in order."""
    full = F.filter(bare_lines(F.col(text)), lambda x: x["bare"] != "")
    hashed = F.transform(
        full,
        lambda x: F.struct(
            F.xxhash64(x["bare"]).alias("h1"), F.xxhash64(x["bare"], F.lit(1)).alias("h2"), F.length(x["bare"]).cast("long").alias("size")
        ),
    )
    return docs.select(key, F.xxhash64(text).alias("th"), F.posexplode(hashed).alias("idx", "l")).select(key, "th", "idx", "l.*")


def first_ranks(lines: DataFrame) -> DataFrame:
    """(h1, h2, r, n): lines by id, with the number of suffixes that begin with a smaller line, and with this one.

    Ids are hashes, so their upper bits deal them evenly; sums of the 4,096 deals give each its base.
    """
    counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).withColumn("deal", F.shiftright("h1", 52))
    totals = counts.groupBy("deal").agg(F.sum("n").alias("total"))
    before = W.orderBy("deal").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("deal", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("deal").orderBy("h1", "h2").rowsBetween(W.unboundedPreceding, -1)
    ranked = counts.withColumn("r", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return ranked.join(F.broadcast(bases), "deal").select("h1", "h2", (F.col("base") + F.col("r")).alias("r"), "n")


def repeated_chains(lines: DataFrame, key: str, min_chars: int) -> DataFrame:
    """(key, th, chain, idx, r, depth, tail): repeated lines with their rank, in chains of consecutive ones.

    The depth is the number of lines from here that reach min_chars, null where the chain ends before. The tail has
    the ranks of the lines beyond, as long as those after this one stay below min_chars: from there on, the next
    suffix has the same run in an interval of its own.
    """
    often = lines.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    again = lines.join(often, ["h1", "h2"]).distinct()  # equal rows are one document
    often = again.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    again = again.join(often, ["h1", "h2"])
    ranked = again.join(first_ranks(again).select("h1", "h2", "r"), ["h1", "h2"])
    document = W.partitionBy(key, "th").orderBy("idx")
    chained = ranked.withColumn("chain", F.col("idx") - F.row_number().over(document))
    chain = W.partitionBy(key, "th", "chain").orderBy("idx")
    chained = chained.withColumn("upto", F.sum("size").over(chain))
    # Lines are not empty, so at most min_chars of them are needed.
    chained = chained.withColumn("ahead", F.collect_list(F.struct("upto", "r")).over(chain.rowsBetween(0, min_chars)))
    need = F.col("upto") - F.col("size") + min_chars
    short = F.size(F.filter("ahead", lambda v: v["upto"] < need))
    depth = F.when(short < F.size("ahead"), (short + 1).cast("int"))
    beyond = F.filter("ahead", lambda v, i: (i >= F.col("depth")) & (v["upto"] - F.col("upto") < min_chars))
    tail = F.transform(beyond, lambda v: v["r"])
    return chained.withColumn("depth", depth).select(key, "th", "chain", "idx", "r", "depth", tail.alias("tail"))


def refine(state: DataFrame, key: str, k: int) -> DataFrame:
    """Ranks by the first 2k lines from ranks by the first k: adds r2, null where the chain is shorter.

    Within a group of equal rank, the pairs (rank, rank k lines on) are counted first and then ordered, so a
    group is as large as the number of its continuations, not of its suffixes.
    """
    chain = W.partitionBy(key, "th", "chain").orderBy("idx")
    paired = state.withColumn("second", F.lead("r", k).over(chain))
    pairs = paired.where("second is not null").groupBy("r", "second").agg(F.count("*").alias("n"))
    within = W.partitionBy("r").orderBy("second").rowsBetween(W.unboundedPreceding, -1)
    named = pairs.withColumn("r2", F.col("r") + F.coalesce(F.sum("n").over(within), F.lit(0))).drop("n")
    return paired.join(named, ["r", "second"], "left").drop("second")


def intervals(lines: DataFrame, key: str, min_chars: int, scratch: Scratch) -> DataFrame:
    """(key, th, idx, depth, tail, k, ra, rb): suffixes that reach min_chars; equal (k, ra, rb) means equal to the depth.

    With k the largest power of two within the depth, the ranks by k lines at both ends of the prefix name it.
    """
    state = scratch.keep(repeated_chains(lines, key, min_chars), "suffixes")
    found: DataFrame | None = None
    k = 1
    while True:
        chain = W.partitionBy(key, "th", "chain").orderBy("idx")
        last = state.withColumn("ranks", F.collect_list(F.struct("idx", "r")).over(chain.rowsBetween(0, k)))
        at_end = F.filter("ranks", lambda s: s["idx"] == F.col("idx") + F.col("depth") - k)
        settled = last.where((F.col("depth") >= k) & (F.col("depth") < 2 * k)).select(
            key, "th", "idx", "depth", "tail", F.lit(k).alias("k"), F.col("r").alias("ra"), F.try_element_at(at_end, F.lit(1))["r"].alias("rb")
        )
        found = settled if found is None else found.unionByName(settled)
        deeper = state.where(F.col("depth") >= 2 * k).select(F.col(key).alias("_key"), F.col("th").alias("_th"), F.col("chain").alias("_chain"))
        deeper = deeper.distinct()
        if deeper.isEmpty():
            return found
        same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("th") == F.col("_th")) & (F.col("chain") == F.col("_chain"))
        going = state.join(deeper, same, "left_semi")
        refined = refine(going, key, k)
        state = scratch.keep(refined.select(key, "th", "chain", "idx", F.col("r2").alias("r"), "depth", "tail"), "suffixes")
        k *= 2


def repeats(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(key, th, gone): per document the places, among its lines that are not blank, of later copies."""
    scratch = Scratch(docs.sparkSession)
    lines = scratch.keep(line_ids(docs.where(F.col(text).isNotNull()), key, text), "lines")
    grams = scratch.keep(intervals(lines, key, min_chars, scratch), "intervals")
    name = ["k", "depth", "ra", "rb"]
    firsts = grams.groupBy(*name).agg(F.min(F.struct(key, "th", "idx")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = grams.join(firsts, name).where(F.struct(key, "th", "idx") > F.col("first")).select(key, "th", "idx", *name, "tail")
    later = scratch.keep(later, "later")
    covered = later.select(key, "th", F.explode(F.sequence("idx", F.col("idx") + F.col("depth") - 1)).alias("idx"))
    covered = covered.unionByName(run_ends(grams, later, key, name))
    return covered.groupBy(key, "th").agg(F.array_sort(F.collect_set("idx")).alias("gone"))


def run_ends(grams: DataFrame, later: DataFrame, key: str, name: list[str]) -> DataFrame:
    """(key, th, idx): the lines beyond the last window of a run that an earlier copy has as well.

    Only where the next suffix is no later copy; elsewhere its run reaches as far as this one.
    """
    follows = F.lead("idx").over(W.partitionBy(key, "th").orderBy("idx"))
    ends = later.withColumn("follows", follows).where(~F.col("follows").eqNullSafe(F.col("idx") + 1) & (F.size("tail") > 0))
    members = grams.where(F.size("tail") > 0).join(ends.select(*name).distinct(), name)
    prefixes = members.select(key, "th", "idx", *name, "tail", F.explode(F.sequence(F.lit(1), F.size("tail"))).alias("more"))
    prefixes = prefixes.withColumn("tail", F.slice("tail", F.lit(1), F.col("more")))
    firsts = prefixes.groupBy(*name, "tail").agg(F.min(F.struct(key, "th", "idx")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = prefixes.join(firsts, [*name, "tail"]).where(F.struct(key, "th", "idx") > F.col("first"))
    return again.select(key, "th", (F.col("idx") + F.col("depth") + F.col("more") - 1).alias("idx"))


def maximal_runs(gone: Column) -> Column:
    """Structs (first, last) of the runs of consecutive places."""
    starts = F.filter(gone, lambda i: ~F.array_contains(gone, i - 1))
    ends = F.filter(gone, lambda i: ~F.array_contains(gone, i + 1))
    return F.arrays_zip(starts.alias("first"), ends.alias("last"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns, with the text after deletion and `runs`, the deleted runs of lines (first, last)."""
    plan = repeats(docs, key, text, min_chars).toDF("_key", "_th", "_gone")
    columns = [c for c in docs.columns if c != "runs"]
    rows = docs.select(*columns).withColumn("_own", F.xxhash64(text))
    joined = rows.join(plan, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_th")), "left")
    # Places count lines that are not blank: the running number of a line is looked up in the deleted ones.
    marked = F.aggregate(
        bare_lines(F.col(text)),
        F.struct(F.lit(-1).alias("at"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("any")),
        lambda acc, x: F.when(
            x["bare"] == "", F.struct(acc["at"].alias("at"), F.concat(acc["kept"], F.array(x["line"])).alias("kept"), acc["any"].alias("any"))
        ).otherwise(
            F.struct(
                (acc["at"] + 1).alias("at"),
                F.when(F.array_contains("_gone", acc["at"] + 1), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x["line"]))).alias("kept"),
                (acc["any"] | ~F.array_contains("_gone", acc["at"] + 1)).alias("any"),
            )
        ),
    )
    left = F.when(marked["any"], F.array_join(marked["kept"], "\n")).otherwise(F.lit(""))
    none = F.array().cast("array<struct<first:int,last:int>>")
    return joined.select(
        *[F.when(F.col("_gone").isNull(), F.col(text)).otherwise(left).alias(text) if c == text else F.col(c) for c in columns],
        F.when(F.col("_gone").isNull(), none).otherwise(maximal_runs(F.col("_gone"))).alias("runs"),
    )
