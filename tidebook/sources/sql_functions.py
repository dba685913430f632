"""SQL functions that return tables, over the views of a session.

They are the SQL face of the operators: the views hold what the operators give, a function picks
from them, and Catalyst folds it into the query that calls it, so that a bound on tickers or runs
reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebook.operators import runs
from tidebook.operators.bars import dedupe_days

PRICE_VIEW, TELEMETRY_VIEW = "tidebook_price_days", "tidebook_run_telemetry"
BAR = "trade_date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
NAMES = ("trade_date", "open", "high", "low", "close", "volume")


def _wanted(tickers: str) -> str:
    """Null asks for every ticker; names are trimmed and taken in upper case."""
    return f"({tickers} IS NULL OR array_contains(transform({tickers}, t -> upper(trim(t))), ticker))"


def _newest(tickers: str, bars: str) -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) AS rn FROM {PRICE_VIEW} WHERE {_wanted(tickers)}"
    return f"(SELECT * FROM ({ranked}) WHERE rn <= {bars})"


def register_prices(spark: SparkSession, prices: DataFrame) -> None:
    """``price_cache(tickers, bars)`` and ``price_cache_by_ticker(tickers, bars)`` over stored prices."""
    dedupe_days(prices).createOrReplaceTempView(PRICE_VIEW)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION price_cache(tickers ARRAY<STRING>, bars INT) RETURNS TABLE (ticker STRING, {BAR})
            RETURN SELECT ticker, {', '.join(NAMES)} FROM {_newest('price_cache.tickers', 'price_cache.bars')}"""
    )
    fields = ", ".join(f"'{n}', {n}" for n in NAMES)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION price_cache_by_ticker(tickers ARRAY<STRING>, bars INT)
            RETURNS TABLE (ticker STRING, payload ARRAY<STRUCT<{BAR.replace(' DATE', ': DATE').replace(' DOUBLE', ': DOUBLE')}>>)
            RETURN SELECT ticker, array_sort(collect_list(named_struct({fields})))
            FROM {_newest('price_cache_by_ticker.tickers', 'price_cache_by_ticker.bars')} GROUP BY ticker"""
    )


def register_telemetry(spark: SparkSession, results: DataFrame, vendor: DataFrame, official: DataFrame) -> None:
    """``run_telemetry(run)``: evidence of one run, or of every run where it is null."""
    runs.evidence_telemetry(results, vendor, official).createOrReplaceTempView(TELEMETRY_VIEW)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION run_telemetry(run STRING)
            RETURNS TABLE (run_id STRING, foreign_evidence_tickers BIGINT, foreign_evidence_days BIGINT, foreign_evidence_sources MAP<STRING, BIGINT>)
            RETURN SELECT run_id, foreign_evidence_tickers, foreign_evidence_days, foreign_evidence_sources FROM {TELEMETRY_VIEW}
            WHERE run_telemetry.run IS NULL OR run_id = run_telemetry.run"""
    )
