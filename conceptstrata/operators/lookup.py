"""Rows of a wide table by a list of keys, without moving the rest of the table.

A list counted below a bound is broadcast. A longer one becomes a bitmap of hashed keys first: its size is chosen from the
number of keys and never exceeds MAX_BITS, so it can be broadcast whatever the list. Rows whose bit is not set
are left out where they are read, and only the others, the wanted ones and a few by chance, go through the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptstrata.operators.ranking import BROADCAST_ROWS

BITS_PER_KEY = 16  # one row in sixteen that is not wanted passes
MAX_BITS = 1 << 27  # 16 MB
WORD_BITS = 32_768  # bits of one row of the bitmap, as Spark's bitmap aggregate makes them
MAX_VALUES = 2_000  # distinct partition values written into a filter


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(word, bitmap): the set bits of the keys' hashes, one row of 4 KB per word that has any."""
    slots = keys.select(_slot(F.col(key), bits).alias("_slot"))
    return slots.groupBy(F.expr(f"_slot div {WORD_BITS}").alias("_word")).agg(
        F.bitmap_construct_agg(F.col("_slot") % WORD_BITS).alias("_bitmap")
    )


def bits_for(count: int) -> int:
    """A power of two, enough for the keys as long as the bound allows."""
    return min(MAX_BITS, max(WORD_BITS, 1 << (count * BITS_PER_KEY - 1).bit_length()))


def narrowed(wide: DataFrame, keys: DataFrame, key: str, count: int) -> DataFrame:
    """The rows whose key may be among the `count` keys; all that are, and few others."""
    bits = bits_for(count)
    rows = wide.withColumn("_at", _slot(F.col(key), bits)).withColumn("_word", F.expr(f"_at div {WORD_BITS}"))
    bit = F.expr("shiftright(CAST(conv(hex(substring(_bitmap, CAST(_at % 32768 div 8 AS INT) + 1, 1)), 16, 10) AS INT), CAST(_at % 8 AS INT)) % 2")
    return rows.join(F.broadcast(bitmap(keys, key, bits)), "_word").where(bit == 1).select(*wide.columns)


def rows_with_keys(wide: DataFrame, ids: DataFrame, key: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of `wide` whose key is in `ids`. Null keys match nothing; repeated ones count once."""
    wanted = ids.select(key).where(F.col(key).isNotNull()).distinct()
    count = wanted.count()
    if count <= max_rows:
        return wide.join(F.broadcast(wanted), key, "left_semi")
    return narrowed(wide, wanted, key, count).join(wanted, key, "left_semi")


def joined_by_key(wide: DataFrame, listed: DataFrame, key: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of a wide table with rows that name some of its keys, once or several times."""
    count = listed.count()
    if count <= max_rows:
        return wide.join(F.broadcast(listed), key)
    return narrowed(wide, listed.select(key), key, count).join(listed, key)


def in_partitions(wide: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """Restrict a table to the partition values that the list names, so that the others are not read."""
    values = [r[0] for r in listed.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_VALUES + 1).collect()]
    return wide if len(values) > MAX_VALUES else wide.where(F.col(column).isin(*values) if values else F.lit(False))
