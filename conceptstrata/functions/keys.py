"""Stable hashes: record keys, shards and repeatable uniforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = float(1 << 60)


def hash60(value: Column) -> Column:
    """First 15 hex digits of the md5 of a string, as a non-negative long."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 15), 16, 10).cast("long")


def partition_key(year: Column, category: Column) -> Column:
    """Hash of `<year>_<category>`."""
    return hash60(F.concat(year.cast("string"), F.lit("_"), category))


def uniform(value: Column, stream: str) -> Column:
    """Repeatable uniform in [0, 1) per value; each `stream` name gives an independent draw.

    Stands where a random() call would give another answer whenever a task is run again.
    """
    return hash60(F.concat(F.lit(stream + ":"), value.cast("string"))) / F.lit(HASH_SPACE)


def shuffle_key(value: Column, stream: str) -> Column:
    """Sort key in the order of `uniform`, without the cost of turning the hash into a number."""
    return F.substring(F.md5(F.concat(F.lit(stream + ":"), value.cast("string"))), 1, 15)


def in_shard(value: Column, num_shards: int, shard_id: int) -> Column:
    """Disjoint, complete and stable split of the keys over `num_shards` workers."""
    return F.pmod(F.xxhash64(value.cast("string")), F.lit(num_shards)) == F.lit(shard_id)


def md5_shard(value: Column, num_shards: int) -> Column:
    """Shard number from the md5 key, the same in every engine."""
    return (hash60(value) % F.lit(num_shards)).cast("int")
