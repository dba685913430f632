"""Sets of days as bitmaps: what a key covers, in a size that does not depend on its history.

A day is a bit; 32,768 bits (almost ninety years) are one bucket of four kilobytes. A key's set is
a map from bucket to bitmap, with as many entries as buckets that hold one of its days, so that
any calendar is exact and almost every key has one entry. Rows of a hot key are merged into its
bitmap in the map tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET, BITS = "_bucket", "_bits"


def _number(day: str) -> str:
    return f"CAST(unix_date({day}) AS BIGINT)"


def day_bits(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """One bitmap per key and bucket; null days are no days."""
    rows = df.where(F.col(day).isNotNull()).withColumn(BUCKET, F.expr(f"bitmap_bucket_number({_number(day)})"))
    position = F.expr(f"bitmap_bit_position({_number(day)})")
    return rows.groupBy(*keys, BUCKET).agg(F.bitmap_construct_agg(position).alias(BITS))


def united(bits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bitmaps of finer keys merged to those of ``keys``."""
    return bits.groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))


def day_sets(bits: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """The set of each key: a map from bucket to bitmap."""
    entries = F.collect_list(F.struct(BUCKET, BITS))
    return bits.groupBy(*keys).agg(F.map_from_entries(entries).alias(out))


def has_day(days: str, day: str) -> str:
    """SQL text: whether the set ``days`` holds ``day``; false where either is null."""
    position = f"bitmap_bit_position({_number(day)})"
    byte = f"substring(element_at({days}, bitmap_bucket_number({_number(day)})), CAST({position} DIV 8 AS INT) + 1, 1)"
    return f"coalesce(bit_get(CAST(conv(hex({byte}), 16, 10) AS INT), CAST({position} % 8 AS INT)) = 1, FALSE)"


def days_held(days: str, wanted: str) -> str:
    """SQL text: how many days of the array ``wanted`` the set ``days`` holds."""
    return f"size(filter({wanted}, d -> {has_day(days, 'd')}))"
