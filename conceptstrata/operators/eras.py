"""Yearly activity and its division into eras of steady level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("query_id", "cluster_label")
MAX_ERAS = 5


def yearly_counts(clusters: DataFrame, keys: Sequence[str] = KEYS, time: str = "year") -> DataFrame:
    """Papers per label and year. Rows are counted before they are shuffled."""
    return clusters.groupBy(*keys, time).agg(F.count("*").alias("n"))


def _series(counts: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """One row per label with at least two distinct years: first year and gap-free counts.

    A label has at most as many entries as the calendar has years.
    """
    entry = F.struct(F.col(time).cast("int"), F.col("n").cast("double"))
    return (
        counts.where(F.col(time).isNotNull())
        .groupBy(*keys)
        .agg(
            F.min(time).cast("int").alias("_first"),
            F.max(time).cast("int").alias("_last"),
            F.map_from_entries(F.collect_list(entry)).alias("_known"),
        )
        .where(F.size("_known") >= 2)
        .withColumn(
            "_counts",
            F.transform(
                F.sequence("_first", "_last"), lambda y: F.coalesce(F.element_at("_known", y), F.lit(0.0))
            ),
        )
    )


def dense_counts(counts: DataFrame, keys: Sequence[str] = KEYS, time: str = "year") -> DataFrame:
    """Counts with the missing years between first and last filled by 0; labels of one year drop out."""
    return _series(counts, keys, time).select(
        *keys, F.posexplode_outer("_counts").alias("_i", "n"), "_first"
    ).select(*keys, (F.col("_first") + F.col("_i")).alias(time), F.col("n").cast("bigint").alias("n"))


def _segment(low: Column, high: Column, sums: Column) -> Column:
    """Stretch [low, high) of a series with the cut that lowers its squared error most.

    The first best cut wins; a stretch that cannot be improved has gain 0. The gain is written over
    one difference of whole numbers, so that equal means give exactly 0 and equal gains tie exactly.
    """
    total, length = sums[high] - sums[low], high - low
    cuts = F.when(length >= 2, F.sequence(low + 1, high - 1)).otherwise(F.array().cast("array<int>"))

    def gain(cut: Column) -> Column:
        excess = (sums[cut] - sums[low]) * length - total * (cut - low)
        weight = length.cast("double") * (cut - low) * (high - cut)
        return excess * excess / weight

    none = F.struct(F.lit(0.0).alias("gain"), F.lit(-1).alias("cut"))

    def better(best: Column, cut: Column) -> Column:
        found = gain(cut)
        return F.when(found > best["gain"], F.struct(found.alias("gain"), cut.alias("cut"))).otherwise(
            best
        )

    best = F.aggregate(cuts, none, better)
    return F.struct(low.alias("low"), high.alias("high"), best["gain"].alias("gain"), best["cut"].alias("cut"))


def find_eras(
    counts: DataFrame, max_eras: int = MAX_ERAS, keys: Sequence[str] = KEYS, time: str = "year"
) -> DataFrame:
    """Split every label's series into at most `max_eras` contiguous eras, best cut first.

    One shuffle brings a label's yearly counts (not its papers) into one row; all rounds of cutting
    are then expressions on that row. Result: keys, era_no, start, end, avg_count, with zero years
    counted in the mean.
    """
    series = (
        _series(counts, keys, time)
        .withColumn(
            "_sums",
            F.aggregate(
                "_counts",
                F.array(F.lit(0.0)),
                lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
            ),
        )
        .withColumn("_eras", F.array(_segment(F.lit(0), F.size("_counts"), F.col("_sums"))))
    )
    sums = F.col("_sums")

    def cut_best(eras: Column, _round: Column) -> Column:
        best = F.aggregate(eras, eras[0], lambda b, e: F.when(e["gain"] > b["gain"], e).otherwise(b))

        def halves(era: Column) -> Column:
            return F.when(
                (era["low"] == best["low"]) & (best["gain"] > 0),
                F.array(
                    _segment(era["low"], era["cut"], sums),
                    _segment(era["cut"], era["high"], sums),
                ),
            ).otherwise(F.array(era))

        return F.flatten(F.transform(eras, halves))

    rounds = F.sequence(F.lit(2), F.lit(max_eras)) if max_eras >= 2 else F.array().cast("array<int>")
    return (
        series.withColumn("_eras", F.aggregate(rounds, F.col("_eras"), cut_best))
        # The outer form adds no filter on the array, which would be computed a second time below it.
        .select(*keys, "_first", "_sums", F.posexplode_outer("_eras").alias("_no", "_era"))
        .select(
            *keys,
            (F.col("_no") + 1).alias("era_no"),
            (F.col("_first") + F.col("_era.low")).alias("start"),
            (F.col("_first") + F.col("_era.high") - 1).alias("end"),
            (
                (sums[F.col("_era.high")] - sums[F.col("_era.low")]) / (F.col("_era.high") - F.col("_era.low"))
            ).alias("avg_count"),
        )
    )


def era_listing(eras: DataFrame) -> DataFrame:
    """Eras as text: period and mean activity with one decimal."""
    return eras.withColumns(
        {"period": F.concat_ws("-", "start", "end"), "activity": F.format_number("avg_count", 1)}
    )
