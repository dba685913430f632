"""Choosing one provider per ticker-day or per ticker, never two for the same activity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.config import (
    BROKER_SOURCE_PRIORITY,
    FOREIGN_SOURCE_PRIORITY,
    OFFICIAL_STOCK_SUMMARY,
    VENDOR_EXACT_DAY,
    VENDOR_FOREIGN_SOURCES,
)
from tidebook.functions.frames import latest_by_key
from tidebook.functions.scalars import lenient_bool, pick
from tidebook.operators.normalize import normalize_broker_summary


def broker_source_choice(broker: DataFrame, priority: Mapping[str, int] | None = None) -> DataFrame:
    """The chosen source of every ticker-day.

    Order: verified share of rows, source priority, distinct brokers, source
    name, all descending. Two aggregates, each combined map-side, so a hot
    ticker-day never sits in one task.
    """
    priority = BROKER_SOURCE_PRIORITY if priority is None else priority
    broker = _named_source(broker)
    verified = lenient_bool(F.col("source_verified")) if "source_verified" in broker.columns else F.lit(False)
    options = broker.groupBy("ticker", "trade_date", "source").agg(
        (F.lit(100.0) * F.avg(verified.cast("double"))).alias("verified_pct"),
        F.count_distinct("broker_code").alias("brokers"),
    )
    best = options.groupBy("ticker", "trade_date").agg(
        F.max(
            F.struct("verified_pct", pick(F.col("source"), priority, 0).alias("priority"), "brokers", "source")
        ).alias("best")
    )
    return best.select("ticker", "trade_date", F.col("best.source").alias("source"), "best.verified_pct", "best.brokers")


def _named_source(broker: DataFrame) -> DataFrame:
    """Rows without a source count as the user's own import."""
    return broker.withColumn("source", F.coalesce("source", F.lit("USER_IMPORT")))


def select_broker_evidence(broker: DataFrame, priority: Mapping[str, int] | None = None) -> DataFrame:
    """All rows of the chosen source of every ticker-day."""
    chosen = broker_source_choice(broker, priority).select("ticker", "trade_date", "source")
    return _named_source(broker).join(chosen, ["ticker", "trade_date", "source"], "left_semi")


def source_day_counts(choice: DataFrame) -> DataFrame:
    return choice.groupBy("source").agg(F.count(F.lit(1)).alias("ticker_days"))


def price_days(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """The last ``lookback`` bar days of each ticker and how many they are."""
    from tidebook.operators.bars import newest_first

    days = bars.select("ticker", "date").withColumn("rn", F.row_number().over(newest_first()))
    days = days.where(F.col("rn") <= lookback)
    count = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    return days.select("ticker", F.col("date").alias("trade_date"), count.alias("sessions"))


def foreign_source_choice(
    universe: DataFrame,
    candidates: DataFrame,
    bars: DataFrame,
    lookback: int = 20,
    priority: Mapping[str, int] | None = None,
) -> DataFrame:
    """Per universe ticker the source with most covered sessions; null where none covers any.

    Ties go to the higher priority, then to the later source name.
    """
    priority = FOREIGN_SOURCE_PRIORITY if priority is None else priority
    covered = (
        candidates.select("ticker", "trade_date", F.coalesce("source", F.lit("UNKNOWN")).alias("source"))
        .distinct()
        .join(price_days(bars, lookback), ["ticker", "trade_date"])
        .groupBy("ticker", "source")
        .agg((F.lit(100.0) * F.count(F.lit(1)) / F.max("sessions")).alias("coverage_pct"))
    )
    best = covered.groupBy("ticker").agg(
        F.max(F.struct("coverage_pct", pick(F.col("source"), priority, 0).alias("priority"), "source")).alias("best")
    )
    return universe.select("ticker").join(best, "ticker", "left").select(
        "ticker", F.col("best.source").alias("source"), F.coalesce("best.coverage_pct", F.lit(0.0)).alias("coverage_pct")
    )


def prepare_foreign_evidence(
    universe: DataFrame,
    candidates: DataFrame,
    bars: DataFrame,
    lookback: int = 20,
    priority: Mapping[str, int] | None = None,
) -> DataFrame:
    """Rows of exactly one share-unit source per ticker."""
    choice = foreign_source_choice(universe, candidates, bars, lookback, priority)
    return take_choice(candidates, choice)


def take_choice(candidates: DataFrame, choice: DataFrame) -> DataFrame:
    rows = candidates.withColumn("source", F.coalesce("source", F.lit("UNKNOWN")))
    picked = choice.where(F.col("source").isNotNull()).select("ticker", "source")
    return rows.join(picked, ["ticker", "source"], "left_semi").withColumns(
        {"flow_unit": F.lit("SHARES"), "foreign_evidence_source": F.col("source")}
    )


def foreign_choice_stats(choice: DataFrame) -> DataFrame:
    """Counts per kind of source and the median coverage, one row."""
    source = F.col("source")
    vendor = source.isin(*VENDOR_FOREIGN_SOURCES)
    official = source == OFFICIAL_STOCK_SUMMARY
    return choice.agg(
        F.count(F.when(official, True)).alias("official_selected_tickers"),
        F.count(F.when(vendor, True)).alias("vendor_selected_tickers"),
        F.count(F.when(source.isNotNull() & ~official & ~vendor, True)).alias("other_selected_tickers"),
        F.count(F.when(source.isNull(), True)).alias("foreign_unavailable_tickers"),
        F.coalesce(F.median("coverage_pct"), F.lit(0.0)).alias("median_selected_coverage_pct"),
    )


def vendor_first_choice(
    universe: DataFrame, vendor: DataFrame, official: DataFrame, bars: DataFrame, lookback: int = 20
) -> DataFrame:
    """Vendor rows wherever they cover a session; official rows for the other tickers only."""
    first = foreign_source_choice(universe, vendor, bars, lookback)
    second = foreign_source_choice(universe, official, bars, lookback)
    second = second.select("ticker", F.col("source").alias("_source"), F.col("coverage_pct").alias("_coverage"))
    taken = F.col("source").isNotNull()
    return first.join(second, "ticker").select(
        "ticker",
        F.coalesce("source", "_source").alias("source"),
        F.when(taken, F.col("coverage_pct")).otherwise(F.col("_coverage")).alias("coverage_pct"),
    )


def vendor_first_foreign(
    universe: DataFrame, vendor: DataFrame, official: DataFrame, bars: DataFrame, lookback: int = 20
) -> DataFrame:
    choice = vendor_first_choice(universe, vendor, official, bars, lookback)
    return take_choice(vendor.unionByName(official, allowMissingColumns=True), choice)


def merge_broker_frames(*frames: DataFrame) -> DataFrame:
    """Keyed union in which rows of a later frame replace those of an earlier one."""
    out = None
    for position, frame in enumerate(frames):
        tagged = frame.withColumn("_frame", F.lit(position))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    rows = normalize_broker_summary(out)
    keys = ["ticker", "trade_date", "broker_code", "market_type", "source"]
    return latest_by_key(rows, keys, [F.col("_frame")]).drop("_frame")


def assemble_finalist_broker(
    finalists: DataFrame,
    stored: DataFrame,
    bundled: DataFrame,
    fresh: DataFrame | None = None,
    vendor_source: str = VENDOR_EXACT_DAY,
) -> DataFrame:
    """Stored, bundled and fresh vendor rows of the finalists, one provider per ticker-day."""
    names = finalists.select("ticker")
    parts = [stored.where(F.col("source") == vendor_source), bundled]
    if fresh is not None:
        parts.append(fresh)
    merged = merge_broker_frames(*[p.join(names, "ticker", "left_semi") for p in parts])
    return select_broker_evidence(merged)


def data_stats(evidence: DataFrame) -> DataFrame:
    """Rows, tickers, days, verified tickers and freshest day, one row."""
    verified = lenient_bool(F.col("source_verified")) if "source_verified" in evidence.columns else F.lit(False)
    folded = evidence.groupBy("ticker", "trade_date").agg(
        F.count(F.lit(1)).alias("n"), F.max(verified).alias("verified")
    )
    return folded.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_distinct("ticker").alias("tickers"),
        F.count_distinct("trade_date").alias("days"),
        F.count_distinct(F.when(F.col("verified"), F.col("ticker"))).alias("verified_tickers"),
        F.max("trade_date").alias("freshest"),
    )
