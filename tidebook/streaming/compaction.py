"""Folding a table of deliveries: reads stop adding up every delivery ever made.

A flow table has three folders. ``deliveries`` holds what the stream writes, one partition each.
Compaction moves those rows to ``ledger``, the same rows by month, and their sums over deliveries to
``base``. A read takes the base, plus what was delivered since. A delivery that comes again after it
was folded lies in ``deliveries`` and in the ledger: the months it touched are then added up from
the ledger without it, all others from the base, so that a late correction is right at once and no
sum is ever taken back by subtraction.

Each step leaves a table that reads right: ledger first, then base, then the deliveries are removed;
a compaction that was cut short is simply run again. One compaction or stream at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.frames import staged
from tidebook.operators.participants import leg_sums, with_balances
from tidebook.sources.sinks import held_table, partitions, remove
from tidebook.streaming.trades import FLOW_KEYS

MONTH = "trade_month"
SUMS = ("buy_volume", "buy_value", "sell_volume", "sell_value")


def deliveries_path(root: str) -> str:
    """Where ``ingest_trade_days`` is to write."""
    return f"{root}/deliveries"


def _held(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    held = held_table(spark, f"{root}/{name}")
    return held if held is None else held.select(*(c for c in ("delivery",) if c in held.columns), *FLOW_KEYS, *SUMS, MONTH)


def compacted_flow(spark: SparkSession, root: str, first_month: Column | None = None) -> DataFrame:
    """Flow per key of all deliveries so far, folded or not, from a month on where one is given."""
    young, ledger, base = (_held(spark, root, n) for n in ("deliveries", "ledger", "base"))
    if base is None:
        parts = [young]
    elif young is None:
        parts = [base]
    else:
        names = young.select("delivery").distinct()
        touched = ledger.join(names, "delivery", "left_semi").select(MONTH).distinct()
        kept = ledger.join(touched, MONTH, "left_semi").join(names, "delivery", "left_anti")
        parts = [base.join(touched, MONTH, "left_anti"), kept, young]
    rows = None
    for part in parts:
        part = part.select(*FLOW_KEYS, *SUMS, MONTH)
        if first_month is not None:
            part = part.where(F.col(MONTH) >= first_month)
        rows = part if rows is None else rows.unionByName(part)
    return with_balances(rows.groupBy(*FLOW_KEYS).agg(*leg_sums()))


def _by_month(rows: DataFrame, path: str) -> None:
    rows.hint("rebalance", MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def compact(spark: SparkSession, root: str, first_day: Column | None = None) -> None:
    """Folds all deliveries, and drops what lies before ``first_day`` where one is given.

    Only the months that the deliveries touch, now or when they were folded before, are written."""
    young, ledger = _held(spark, root, "deliveries"), _held(spark, root, "ledger")
    if young is not None:
        folded = [p["delivery"] for p in partitions(spark, deliveries_path(root))]
        names = young.select("delivery").distinct()
        rows = young
        if ledger is not None:
            touched = ledger.join(names, "delivery", "left_semi").select(MONTH).union(young.select(MONTH)).distinct()
            rows = ledger.join(staged(touched, "months"), MONTH, "left_semi").join(names, "delivery", "left_anti").unionByName(young)
            empty = touched.join(rows.select(MONTH).distinct(), MONTH, "left_anti")
            gone = [r[0] for r in empty.collect()]  # months, a number bounded by the calendar
        else:
            gone = []
        # The months are read while they are written, so their rows are staged first.
        rows = staged(rows, "ledger")
        _by_month(rows, f"{root}/ledger")
        _by_month(rows.groupBy(*FLOW_KEYS, MONTH).agg(*leg_sums()), f"{root}/base")
        for name in ("ledger", "base"):
            for month in gone:
                remove(spark, f"{root}/{name}/{MONTH}={month}")
        for delivery in folded:
            remove(spark, f"{deliveries_path(root)}/delivery={delivery}")
    if first_day is not None:
        retain(spark, root, first_day)


def retain(spark: SparkSession, root: str, first_day: Column) -> list[int]:
    """Drops whole months before the first day, and rewrites its own month without earlier days.

    Deliveries that are not folded yet keep their rows until they are. Returns the dropped months."""
    day, month = spark.range(1).select(first_day.alias("d"), (F.year(first_day) * 100 + F.month(first_day)).alias("m")).first()
    dropped = set()
    for name in ("base", "ledger"):
        path = f"{root}/{name}"
        for p in partitions(spark, path):
            if int(p[MONTH]) < month:
                remove(spark, f"{path}/{MONTH}={p[MONTH]}")
                dropped.add(int(p[MONTH]))
        held = _held(spark, root, name)
        if held is not None:
            edge = held.where((F.col(MONTH) == month))
            early = edge.where(F.col("trade_date") < F.lit(day))
            if not early.isEmpty():
                _by_month(staged(edge.where(F.col("trade_date") >= F.lit(day)), "edge"), path)
    return sorted(dropped)
