"""Hash partitioning of keys, as a level-0 grouping of an input has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def portable_hash(key: str) -> Column:
    """The first 32 bits of the MD5 of the key as text, which other engines compute alike; slower than the default."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def partition_counts(df: DataFrame, key: str, slots: int = 32, hashed: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """Rows and distinct keys in each of ``slots`` hash slots of a key."""
    slot = F.pmod(hashed(key), F.lit(slots)).cast("int").alias("slot")
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.groupBy(slot).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"))
