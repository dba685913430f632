"""Which days to load, and which ticker-days are missing."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Calendar days behind each look-back label; an unknown label means one year.
PERIOD_DAYS = {"1mo": 30, "3mo": 91, "6mo": 182, "1y": 365, "2y": 730, "5y": 1826, "10y": 3652, "max": None}


def period_days(label: str | None) -> int | None:
    return PERIOD_DAYS.get((label or "1y").strip().lower(), 365)


def within_period(df: DataFrame, label: str | None, as_of: date | str, column: str = "date") -> DataFrame:
    """Rows inside the look-back that ends on ``as_of``."""
    days = period_days(label)
    return df if days is None else df.where(F.col(column) >= F.date_sub(F.lit(str(as_of)).cast("date"), days))


def last_weekday(day: date) -> date:
    while day.weekday() >= 5:
        day -= timedelta(days=1)
    return day


def weekdays(spark: SparkSession, end: date | str, count: int) -> DataFrame:
    """The last ``count`` weekdays up to ``end``, newest first."""
    span = 7 * (count // 5 + 2)
    stop = F.lit(str(end)).cast("date")
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(stop, span), stop)).alias("trade_date"))
    return days.where(~F.dayofweek("trade_date").isin(1, 7)).orderBy(F.col("trade_date").desc()).limit(count)


def candidate_trade_dates(flows: DataFrame, end: date | str, count: int = 20) -> DataFrame:
    """The newest ``count`` distinct flow days; weekdays up to ``end`` where there is no flow at all."""
    observed = flows.select("trade_date").where(F.col("trade_date").isNotNull()).distinct()
    newest = observed.orderBy(F.col("trade_date").desc()).limit(count)
    none = newest.agg(F.count(F.lit(1)).alias("n"))
    fallback = weekdays(flows.sparkSession, end, count).where(none.scalar() == 0)
    return newest.union(fallback)


def missing_ticker_days(universe: DataFrame, days: DataFrame, existing: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` absent (day, ticker) pairs, newest day first, then universe order.

    ``days`` is the short list of wanted sessions. It becomes one array that
    every ticker row unfolds, so the grid is made in place without a join.
    """
    wanted = days.select("trade_date").distinct().agg(F.array_sort(F.collect_list("trade_date")).alias("days"))
    grid = universe.select("ticker", "position", F.explode(wanted.scalar()).alias("trade_date"))
    present = existing.select("ticker", "trade_date").where(F.col("trade_date").isNotNull()).distinct()
    missing = grid.join(present, ["ticker", "trade_date"], "left_anti")
    return missing.orderBy(F.col("trade_date").desc(), "position").limit(max(0, budget)).select("ticker", "trade_date")
