"""Merging, tiering, checking and pruning of cached tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.frames import latest_by_key

MIN_BARS = 80

# Retention in days.
RETENTION_DAYS = {"runs": 45, "broker": 150, "prices": 550}


def merge_cache(
    cache: DataFrame, fresh: DataFrame, keys: Sequence[str], as_of: date | str | None = None, keep_days: int | None = None
) -> DataFrame:
    """Cache with fresh rows appended; the fresh row wins its key; old days drop out."""
    both = cache.withColumn("_fresh", F.lit(0)).unionByName(
        fresh.withColumn("_fresh", F.lit(1)), allowMissingColumns=True
    )
    if keep_days is not None and as_of is not None:
        both = both.where(F.col("trade_date") >= F.date_sub(F.lit(str(as_of)).cast("date"), keep_days))
    return latest_by_key(both, keys, [F.col("_fresh")]).drop("_fresh")


def load_recent(
    df: DataFrame,
    universe: DataFrame,
    lookback_days: int,
    as_of: date | str,
    source: str | None = None,
    default_verified: bool = False,
) -> DataFrame:
    """Recent rows of the universe with missing provenance columns filled in.

    The day bound reaches the scan (and its partitions); ``default_verified``
    is True for official tables and False for vendor tables.
    """
    rows = df.where(F.col("trade_date") >= F.date_sub(F.lit(str(as_of)).cast("date"), lookback_days))
    if source is not None:
        rows = rows.where(F.col("source") == source)
    rows = rows.join(universe.select("ticker"), "ticker", "left_semi")
    defaults: dict[str, Column] = {
        "source_verified": F.lit(default_verified),
        "source_url": F.lit(None).cast("string"),
        "provenance_state": F.lit(None).cast("string"),
    }
    return rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns})


def tier_choice(universe: DataFrame, tiers: Mapping[str, DataFrame], min_bars: int = MIN_BARS) -> DataFrame:
    """The first tier that holds enough bars of a ticker; ``tier`` null where none does."""
    counts = None
    for place, (name, bars) in enumerate(tiers.items()):
        part = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("bars")).where(F.col("bars") >= min_bars)
        part = part.select("ticker", F.struct(F.lit(place).alias("place"), F.lit(name).alias("tier"), "bars").alias("t"))
        counts = part if counts is None else counts.unionByName(part)
    best = counts.groupBy("ticker").agg(F.min("t").alias("t"))
    return universe.select("ticker").distinct().join(best, "ticker", "left").select("ticker", "t.tier", "t.bars")


def coalesce_tiers(
    universe: DataFrame, tiers: Mapping[str, DataFrame], min_bars: int = MIN_BARS, period: str = "1y", seed: str = "seed"
) -> DataFrame:
    """Bars of the chosen tier of every ticker. The seed tier serves ``6mo`` and ``1y`` only."""
    used = {n: b for n, b in tiers.items() if n != seed or period.lower() in ("6mo", "1y")}
    choice = tier_choice(universe, used, min_bars).where(F.col("tier").isNotNull())
    out = None
    for name, bars in used.items():
        part = bars.join(choice.where(F.col("tier") == name).select("ticker"), "ticker", "left_semi")
        part = part.withColumn("tier", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def tier_stats(choice: DataFrame) -> DataFrame:
    """Tickers served per tier and tickers without any; one row per tier."""
    return choice.groupBy(F.coalesce("tier", F.lit("unavailable")).alias("tier")).agg(
        F.count(F.lit(1)).alias("tickers"), F.coalesce(F.sum("bars"), F.lit(0)).alias("bars")
    )


def seed_gate(universe: DataFrame, bars: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    """Bar count of every universe ticker and whether the seed accepts it."""
    counts = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"), F.max("date").alias("latest"))
    n = F.coalesce("bars", F.lit(0))
    return universe.select("ticker").distinct().join(counts, "ticker", "left").select(
        "ticker", n.alias("bars"), (n >= min_bars).alias("accepted"), "latest"
    )


def seed_meta(gate: DataFrame, min_ratio: float = 0.90) -> DataFrame:
    """One row: accepted share of the universe and whether the gate holds."""
    ok = F.col("accepted")
    stats = gate.agg(
        F.count(F.lit(1)).alias("universe_count"),
        F.count(F.when(ok, True)).alias("valid_tickers"),
        F.max(F.when(ok, F.col("latest"))).alias("latest_trade_date"),
    )
    share = F.col("valid_tickers") / F.greatest(F.col("universe_count"), F.lit(1))
    return stats.withColumns({"valid_ratio": share, "passed": share >= min_ratio})


def prune(df: DataFrame, as_of: date | str, keep_days: int, column: str = "trade_date") -> DataFrame:
    """Rows younger than the retention; a plain day bound that prunes partitions."""
    return df.where(F.col(column) >= F.date_sub(F.lit(str(as_of)).cast("date"), keep_days))
