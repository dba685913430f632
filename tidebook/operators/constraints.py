"""Row and closed-book checks that split a table into accepted and rejected rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.config import EXACT_DAY_STATE, EXACT_DAY_STATE_LIKE, VENDOR_EXACT_DAY
from tidebook.functions.frames import last_by_key
from tidebook.functions.scalars import number

BROKER_ROW = (
    "ticker string, trade_date string, broker_code string, market_type string, buy_value string, sell_value string,"
    " buy_volume string, sell_volume string, buy_avg string, sell_avg string, source string, source_verified string,"
    " source_url string, provenance_state string"
)


def balance_error_pct(buy: Column, sell: Column) -> Column:
    return F.lit(100.0) * F.abs(buy - sell) / F.greatest((buy + sell) / F.lit(2.0), F.lit(1.0))


def closed_book(broker: DataFrame, keys: tuple[str, ...] = ("ticker", "trade_date", "market_type", "source")) -> DataFrame:
    """Per ticker-day book: brokers, sums, balance error and whether it is acceptable."""
    # At least 2 brokers, both sides, error within 10 %.
    book = broker.groupBy(*keys).agg(
        F.count_distinct("broker_code").alias("brokers"),
        F.coalesce(F.sum("buy_value"), F.lit(0.0)).alias("buy_value"),
        F.coalesce(F.sum("sell_value"), F.lit(0.0)).alias("sell_value"),
    )
    error = balance_error_pct(F.col("buy_value"), F.col("sell_value"))
    return book.withColumn("balance_error_pct", error).withColumn(
        "accepted",
        (F.col("brokers") >= 2)
        & (F.col("buy_value") > 0)
        & (F.col("sell_value") > 0)
        & (F.col("balance_error_pct") <= 10),
    )


def closed_book_violations(broker: DataFrame, source: str = VENDOR_EXACT_DAY) -> DataFrame:
    return closed_book(broker.where(F.col("source") == source)).where(~F.col("accepted")).drop("accepted")


def split_closed_book(broker: DataFrame, source: str = VENDOR_EXACT_DAY) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, quarantined rows); rows of other sources are always accepted."""
    keys = ["ticker", "trade_date", "market_type", "source"]
    bad = closed_book_violations(broker, source).select(*keys)
    return broker.join(bad, keys, "left_anti"), broker.join(bad, keys, "left_semi")


def provenance_ok(
    source_url: str, source: str = VENDOR_EXACT_DAY, state: str = EXACT_DAY_STATE, market: str = "RG"
) -> Column:
    """True for rows of other sources and for rows of ``source`` with its exact provenance, the
    address it was fetched from included."""
    exact = (
        (F.col("market_type") == market)
        & F.col("source_verified")
        & (F.col("provenance_state") == state)
        & (F.col("source_url") == source_url)
    )
    return F.coalesce((F.col("source") != source) | exact, F.lit(False))


def split_provenance(broker: DataFrame, source_url: str, **rule) -> tuple[DataFrame, DataFrame]:
    ok = provenance_ok(source_url, **rule)
    return broker.where(ok), broker.where(~ok)


def normalize_cache_rows(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON object texts of a broker cache as typed rows; rows without a key field drop out."""
    j = raw.select(F.from_json(column, BROKER_ROW).alias("j")).select("j.*")

    def amount(name: str) -> Column:
        return F.greatest(F.coalesce(number(F.col(name)), F.lit(0.0)), F.lit(0.0)).alias(name)

    return j.where(
        F.col("ticker").isNotNull() & F.col("trade_date").isNotNull() & F.col("broker_code").isNotNull()
    ).select(
        F.upper("ticker").alias("ticker"),
        F.col("trade_date").try_cast("date").alias("trade_date"),
        F.upper("broker_code").alias("broker_code"),
        F.upper(F.coalesce(F.when(F.col("market_type") != "", F.col("market_type")), F.lit("RG"))).alias("market_type"),
        *[amount(c) for c in ("buy_value", "sell_value", "buy_volume", "sell_volume", "buy_avg", "sell_avg")],
        "source",
        F.coalesce(F.col("source_verified").try_cast("boolean"), F.lit(False)).alias("source_verified"),
        "source_url",
        "provenance_state",
    )


def eligible_cache_rows(
    rows: DataFrame,
    as_of: date | str,
    source_url: str,
    source: str = VENDOR_EXACT_DAY,
    state_like: str = EXACT_DAY_STATE_LIKE,
    days: int = 180,
) -> DataFrame:
    """Rows that may be stored: key patterns, date window, provenance, some positive amount,
    and a ticker-day with a closed book."""
    # Key patterns.
    end = F.lit(str(as_of)).cast("date")
    keep = (
        F.col("ticker").rlike("^[A-Z0-9]{1,10}$")
        & F.col("broker_code").rlike("^[A-Z0-9]{1,8}$")
        & F.col("trade_date").between(F.date_sub(end, days), end)
        & (F.col("market_type") == "RG")
        & (F.col("source") == source)
        & F.col("source_verified")
        & F.col("provenance_state").like(state_like)
        & (F.col("source_url") == source_url)
        & ((F.col("buy_value") > 0) | (F.col("sell_value") > 0) | (F.col("buy_volume") > 0) | (F.col("sell_volume") > 0))
    )
    eligible = rows.where(keep)
    valid = closed_book(eligible, ("ticker", "trade_date")).where("accepted").select("ticker", "trade_date")
    return eligible.join(valid, ["ticker", "trade_date"], "left_semi")


def sync_broker_cache(raw: DataFrame, as_of: date | str, source_url: str, column: str = "value", **rule) -> DataFrame:
    """JSON cache rows to the rows an upsert stores, one per storage key; two that differ are an error."""
    rows = eligible_cache_rows(normalize_cache_rows(raw, column), as_of, source_url, **rule)
    return last_by_key(rows, ["ticker", "trade_date", "broker_code", "market_type", "source"], None, "broker cache")
