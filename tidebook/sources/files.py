"""Readers of the user-facing files. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.frames import require_columns
from tidebook.functions.scalars import canonical_ticker
from tidebook.operators.normalize import normalize_broker_summary, normalize_price_frame, parse_universe
from tidebook.operators.participants import TRADE_REQUIRED


def _text_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV with a header; every column stays text and is cast by the normalisers."""
    return spark.read.option("header", True).option("sep", sep).csv(path)


def read_broker_csv(spark: SparkSession, path: str) -> DataFrame:
    return normalize_broker_summary(_text_csv(spark, path))


def read_universe_csv(spark: SparkSession, path: str) -> DataFrame:
    """Distinct tickers in file order."""
    rows = _text_csv(spark, path).withColumn("_position", F.monotonically_increasing_id())
    return parse_universe(rows, "_position")


def read_price_seed(spark: SparkSession, path: str, min_bars: int = 80) -> DataFrame:
    """Seed bars of the tickers that have enough of them.

    A gzip file cannot be split; land it once with ``land_partitioned`` where it is large.
    """
    raw = _text_csv(spark, path)
    require_columns(raw.toDF(*[c.strip().lower() for c in raw.columns]), ("ticker", "date", "open", "high", "low", "close", "volume"), "price seed")
    # Files are read front to back, so the row's number is its arrival: of a day the last row stays.
    bars = normalize_price_frame(raw.withColumn("_row", F.monotonically_increasing_id()), "_row")
    enough = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_bars)
    return bars.join(enough.select("ticker"), "ticker", "left_semi")


def sniff_separator(spark: SparkSession, path: str) -> str:
    """``|`` where the header line has one, else ``,``."""
    first = spark.read.text(path).limit(1).collect()
    return "|" if first and "|" in first[0][0] else ","


def read_trade_detail_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    rows = _text_csv(spark, path, sep or sniff_separator(spark, path))
    rows = rows.toDF(*[c.strip().lower() for c in rows.columns])
    require_columns(rows, TRADE_REQUIRED, "trade detail")
    return rows


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """A file holding one JSON array, as one JSON object text per element."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "array<string>")).alias("value"))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """``{"tickers": [...]}`` as distinct canonical tickers with their position."""
    whole = spark.read.text(path, wholetext=True)
    listed = whole.select(F.posexplode(F.from_json(F.get_json_object("value", "$.tickers"), "array<string>")))
    rows = listed.select(canonical_ticker(F.col("col")).alias("ticker"), F.col("pos").alias("position"))
    return rows.where(F.col("ticker") != "").groupBy("ticker").agg(F.min("position").alias("position"))


def read_table(
    spark: SparkSession,
    path: str,
    universe: DataFrame | None = None,
    since: str | None = None,
    unit: str | None = None,
    verified_only: bool = False,
) -> DataFrame:
    """Stored rows by ticker set, first day, unit and provenance; the day bound prunes partitions."""
    rows = spark.read.parquet(path)
    if since is not None:
        rows = rows.where(F.col("trade_date") >= F.lit(since).cast("date"))
    if unit is not None:
        rows = rows.where(F.col("flow_unit") == unit)
    if verified_only:
        rows = rows.where(F.col("source_verified"))
    return rows if universe is None else rows.join(universe.select("ticker"), "ticker", "left_semi")
