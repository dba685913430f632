"""Incremental ingestion: trade days, late corrections, open outcomes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidebook.operators.caches import prune
from tidebook.operators.outcomes import apply_updates, refresh_pending
from tidebook.operators.participants import aggregate_trades, leg_sums, with_balances
from tidebook.sources.sinks import held_table, upsert

FLOW_KEYS = ("ticker", "trade_date", "participant")


def trade_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Arriving Parquet files of raw trades."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def daily_totals(trades: DataFrame, delay: str = "3 days") -> DataFrame:
    """Event-time daily buy and sell sums per participant, late rows within ``delay``.

    Needs the event time ``ts``; state of a day is dropped once the watermark passes it.
    """
    legs = trades.withWatermark("ts", delay).select(
        "ts",
        "ticker",
        F.expr(
            "stack(2, participant_buy, volume, value, 0D, 0D, participant_sell, 0D, 0D, volume, value)"
            " AS (participant, buy_volume, buy_value, sell_volume, sell_value)"
        ),
    )
    sums = legs.groupBy(F.window("ts", "1 day"), "ticker", "participant").agg(
        *[F.sum(c).alias(c) for c in ("buy_volume", "buy_value", "sell_volume", "sell_value")]
    )
    return sums.select(
        "ticker",
        F.col("window.start").cast("date").alias("trade_date"),
        "participant",
        "buy_volume",
        "buy_value",
        "sell_volume",
        "sell_value",
    )


def ingest_trade_days(
    trades: DataFrame,
    table_path: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    delivery: Callable[[Column], Column] | None = None,
    version: Callable[[Column], Column] | None = None,
) -> StreamingQuery:
    """Trades as they arrive, in files of any cut; sums are kept per delivery and added when read.

    A day whose trades lie in several files, read in one batch or in many, adds up. A delivery is a
    file, unless ``delivery`` names it by less than the file's name (``day12`` of ``day12.v2``): a
    file of a delivery that is held replaces all that it gave before, participants and days it no
    longer has included; of several in one batch the one modified last counts. A delivery of several
    files needs ``version``, which names by a file's name what belongs together (``day12.v2`` of
    ``day12.v2.p3``): files of one version add up, and must arrive in one batch. ``flow_table`` reads
    the table, which is partitioned by delivery, so a batch rewrites what it brings only. A delivery
    is written by months, so that a large one is not one task's.
    ``prepare`` turns a batch into trades and must keep the column ``delivery``.
    """
    name = F.col("_metadata.file_name")
    named = trades.select(
        "*",
        (name if delivery is None else delivery(name)).alias("delivery"),
        F.struct(
            F.col("_metadata.file_modification_time").alias("at"), name.alias("name"), (name if version is None else version(name)).alias("version")
        ).alias("_file"),
    )

    def store(batch: DataFrame, _batch_id: int) -> None:
        last = batch.select("delivery", "_file").distinct().groupBy("delivery").agg(F.max("_file")["version"].alias("_version"))
        # One row for each delivery of the batch, whose files the driver has listed: no row moves for it.
        versions = batch.withColumn("_version", F.col("_file.version"))
        rows = versions.join(F.broadcast(last), ["delivery", "_version"], "left_semi").drop("_file", "_version")
        flow = aggregate_trades(rows if prepare is None else prepare(rows), by=("delivery",))
        flow = flow.withColumn("trade_month", month_number("trade_date")).hint("rebalance", "delivery", "trade_month")
        flow.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("delivery").parquet(table_path)

    return (
        named.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def flow_table(spark: SparkSession, table_path: str, first_month: Column | None = None) -> DataFrame:
    """Flow per key of all deliveries ingested so far, from a month on where one is given."""
    held = spark.read.parquet(table_path)
    if first_month is not None:
        held = held.where(F.col("trade_month") >= first_month)
    return with_balances(held.groupBy(*FLOW_KEYS).agg(*leg_sums()))


def drop_repeats(trades: DataFrame, keys: Sequence[str], delay: str = "3 days") -> DataFrame:
    """Exact re-deliveries removed within the watermark."""
    return trades.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def month_number(day: str) -> Column:
    return F.year(day) * 100 + F.month(day)


def retained(spark: SparkSession, table_path: str, as_of: str, keep_days: int = 45) -> DataFrame:
    """Rows young enough to keep; older months are skipped by the files' statistics."""
    first = F.date_sub(F.lit(as_of).cast("date"), keep_days)
    return prune(flow_table(spark, table_path, F.year(first) * 100 + F.month(first)), as_of, keep_days)


def refresh_outcomes_on_bars(
    price_batches: DataFrame, price_path: str, outcome_path: str, universe: DataFrame, checkpoint: str
) -> StreamingQuery:
    """Each batch of price rows is upserted, then open outcomes of its tickers advance."""

    def advance(batch: DataFrame, _batch_id: int) -> None:
        spark = batch.sparkSession
        upsert(batch, price_path, ("ticker", "trade_date", "source"), "trade_date", [F.col("ingested_at")])
        outcomes = held_table(spark, outcome_path)
        if outcomes is None:
            return
        names = universe.join(batch.select("ticker").distinct(), "ticker", "left_semi")
        prices = spark.read.parquet(price_path).join(names.select("ticker"), "ticker", "left_semi")
        updates = refresh_pending(outcomes, names, prices)
        changed = apply_updates(outcomes.join(updates.select("run_id", "ticker"), ["run_id", "ticker"], "left_semi"), updates)
        upsert(changed, outcome_path, ("run_id", "ticker"), "run_id")

    return (
        price_batches.writeStream.foreachBatch(advance)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
