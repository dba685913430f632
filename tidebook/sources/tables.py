"""The data model derived from a directory of star-schema Parquet tables.

Each view is a plain lazy frame over the whole tables. Join strategies are left
to the optimizer, which broadcasts a side only when its size is known to be
below the session's threshold and otherwise shuffles both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.config import OFFICIAL_STOCK_SUMMARY, VENDOR_FOREIGN_FLOW
from tidebook.operators.participants import leg_sums, with_balances


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _ticker() -> Column:
    return F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("ticker")


def _participant(nation: str, alias: str) -> Column:
    return F.concat(F.lit("N"), F.col(nation)).alias(alias)


def _price(rough: bool = False) -> Column:
    """Unit price in whole thousandths, so that every sum of values is exact."""
    unit = (
        F.col("l_extendedprice") / F.col("l_quantity")
        if rough
        else F.col("p_retailprice") * (F.lit(1.0) - F.col("l_discount"))
    )
    return F.round(unit * 1000.0)


def trades(spark: SparkSession, root: str, lineitem: DataFrame | None = None) -> DataFrame:
    """One row per trade with its buying and selling participant."""
    li = table(spark, root, "lineitem") if lineitem is None else lineitem
    customer = table(spark, root, "customer").select("c_custkey", _participant("c_nationkey", "participant_buy"))
    supplier = table(spark, root, "supplier").select("s_suppkey", _participant("s_nationkey", "participant_sell"))
    return _sided(spark, root, li, customer, supplier).select(
        "ticker",
        F.col("l_shipdate").cast("date").alias("trade_date"),
        "participant_buy",
        "participant_sell",
        F.col("l_quantity").alias("volume"),
        (_price() * F.col("l_quantity")).alias("value"),
        F.col("l_linestatus").alias("line_status"),
        F.col("l_returnflag").alias("return_flag"),
        # what a stream adds to the rows it delivers
        *[c for c in ("delivery",) if c in li.columns],
    )


def _sided(spark: SparkSession, root: str, lineitem: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Line items with the part's ticker and price and the columns of their customer and supplier."""
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, root, "part").select("p_partkey", _ticker(), "p_retailprice")
    buyers = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    return (
        # Both sides grow with the data, so neither may be broadcast at any scale.
        lineitem.join(buyers.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )


def bars(spark: SparkSession, root: str, rough: bool = False) -> DataFrame:
    """Daily bars. ``rough`` uses the noisy unit price, which gaps on most days."""
    part = table(spark, root, "part").select("p_partkey", _ticker(), "p_retailprice")
    price = _price(rough)
    # Trades of a day are ordered by the whole key: order, line, part, supplier, quantity and
    # price paid; (order, line) alone is not unique. Fixed-width keys would keep a hash
    # aggregate, but would have to leave some of the key out.
    trade_no = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    ticks = (
        table(spark, root, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "ticker",
            F.col("l_shipdate").cast("date").alias("date"),
            trade_no.alias("key"),
            price.alias("price"),
            F.col("l_quantity").alias("quantity"),
        )
    )
    return ticks.groupBy("ticker", "date").agg(
        F.min_by("price", "key").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "key").alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum(F.col("price") * F.col("quantity")).alias("traded_value"),
    )


def daily_prices(spark: SparkSession, root: str, rough: bool = False) -> DataFrame:
    """Bars in storage form, two sources per day with different arrival times."""
    base = bars(spark, root, rough).withColumnRenamed("date", "trade_date")
    copies = F.explode(
        F.array(
            F.struct(F.lit("SEED").alias("source"), F.lit(0).alias("age"), F.lit(1.25).alias("skew")),
            F.struct(F.lit("FRESH").alias("source"), F.lit(1).alias("age"), F.lit(1.0).alias("skew")),
        )
    )
    return base.withColumn("copy", copies).select(
        "ticker",
        "trade_date",
        *[(F.col(c) * F.col("copy.skew")).alias(c) for c in ("open", "high", "low", "close")],
        "volume",
        "traded_value",
        F.col("copy.source").alias("source"),
        (F.col("trade_date").cast("timestamp_ntz") + F.make_dt_interval(F.col("copy.age"))).alias("ingested_at"),
    )


def trade_legs(spark: SparkSession, root: str) -> DataFrame:
    """Buy and sell sums per (ticker, day, participant) and what broker rows and foreign flow tell
    apart: line status, return flag and whether the two sides are of different regions, null where
    the nation of one is not known. The number of rows is bounded by the calendar, not by the
    trades, so a query that needs both kinds of rows stages these and reads the trades once.
    """
    nation = table(spark, root, "nation").select("n_nationkey", F.struct(F.col("n_regionkey").alias("region")).alias("of"))

    def placed(name: str, key: str, number: str, side: str) -> DataFrame:
        # Nations are met by customers and suppliers, not once more by every trade, and stay
        # numbers until the sums are made.
        known = table(spark, root, name).join(nation, F.col(number) == F.col("n_nationkey"), "left")
        return known.select(key, F.col(number).alias(f"nation_{side}"), F.col("of").alias(side))

    sides = (placed("customer", "c_custkey", "c_nationkey", "buy"), placed("supplier", "s_suppkey", "s_nationkey", "sell"))
    rows = _sided(spark, root, table(spark, root, "lineitem"), *sides).withColumns(
        {"volume": F.col("l_quantity"), "value": _price() * F.col("l_quantity")}
    )
    crosses = F.when(F.col("buy").isNotNull() & F.col("sell").isNotNull(), F.coalesce(F.col("buy.region") != F.col("sell.region"), F.lit(False)))
    legs = rows.select(
        "ticker",
        F.col("l_shipdate").cast("date").alias("trade_date"),
        F.col("l_linestatus").alias("line_status"),
        F.col("l_returnflag").alias("return_flag"),
        crosses.alias("crosses"),
        F.expr(
            "stack(2, nation_buy, buy.region, volume, value, 0D, 0D, volume IS NOT NULL, nation_sell, sell.region, 0D, 0D, volume, value, FALSE)"
            " AS (nation, region, buy_volume, buy_value, sell_volume, sell_value, known)"
        ),
    )
    keys = ("ticker", "trade_date", "nation", "region", "line_status", "return_flag", "crosses")
    sums = legs.groupBy(*keys).agg(*leg_sums(), F.max("known").alias("known"))
    return sums.withColumn("participant", _participant("nation", "participant")).drop("nation")


def broker_flows(spark: SparkSession, root: str, all_verified: bool = False, legs: DataFrame | None = None) -> DataFrame:
    """Broker rows: one source per line status, one third of the rows unverified."""
    marked = (trade_legs(spark, root) if legs is None else legs).withColumns(
        {
            "source": F.when(F.col("line_status") == "F", F.lit("DIRECT")).otherwise(F.lit("VENDOR")),
            "source_verified": F.lit(True) if all_verified else F.col("return_flag") != "R",
        }
    )
    flow = with_balances(marked.groupBy("ticker", "trade_date", "participant", "source", "source_verified").agg(*leg_sums()))
    return flow.withColumnRenamed("participant", "broker_code").withColumns(
        {
            "gross_value": F.col("buy_value") + F.col("sell_value"),
            "market_type": F.lit("RG"),
            "source_url": F.lit(None).cast("string"),
            "provenance_state": F.lit(None).cast("string"),
        }
    )


def foreign_flows(spark: SparkSession, root: str, legs: DataFrame | None = None) -> DataFrame:
    """Cross-region share flow per (ticker, day, source)."""
    rows = (trade_legs(spark, root) if legs is None else legs).where(F.col("crosses").isNotNull())
    foreign = F.col("crosses") & (F.col("region") == 0)
    source = F.when(F.col("line_status") == "F", F.lit(OFFICIAL_STOCK_SUMMARY)).otherwise(F.lit(VENDOR_FOREIGN_FLOW))
    flows = rows.groupBy("ticker", "trade_date", source.alias("source")).agg(
        F.coalesce(F.sum(F.when(foreign, F.col("buy_volume"))), F.lit(0.0)).alias("foreign_buy"),
        F.coalesce(F.sum(F.when(foreign, F.col("sell_volume"))), F.lit(0.0)).alias("foreign_sell"),
        F.when(F.max("known"), F.sum("buy_volume")).alias("volume"),
    )
    return flows.withColumn("foreign_net", F.col("foreign_buy") - F.col("foreign_sell"))


def universe(spark: SparkSession, root: str) -> DataFrame:
    """All tickers of the part table; the position is the first part that names one."""
    return (
        table(spark, root, "part")
        .groupBy(_ticker())
        .agg(F.min("p_partkey").alias("position"))
    )


def signals(spark: SparkSession, root: str, rough: bool = False) -> DataFrame:
    """Every bar of a ticker as an open signal, in the run of its number."""
    oldest = Window.partitionBy("ticker").orderBy("date")
    return (
        bars(spark, root, rough)
        .select("ticker", "date", F.row_number().over(oldest).alias("n"))
        .select(
            F.concat(F.lit("R"), "n").alias("run_id"),
            "ticker",
            F.col("date").alias("as_of_date"),
        )
    )


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Scan-run rows out of the event stream."""
    running = F.col("event_type").isin("view", "click", "signup")
    return table(spark, root, "events").select(
        F.col("event_id").alias("id"),
        F.when(running, F.lit("RUNNING"))
        .when(F.col("event_type") == "error", F.lit("FAILED"))
        .otherwise(F.lit("COMPLETED"))
        .alias("status"),
        F.floor("value").cast("int").alias("processed_count"),
        F.lit(0).alias("error_count"),
        (F.col("ts") - F.expr("INTERVAL 10 MINUTES")).alias("started_at"),
        F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("heartbeat_at"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"),
        F.concat(F.lit("T"), F.col("event_id")).alias("current_ticker"),
        F.create_map(
            F.lit("universe_signature"),
            F.when(F.col("user_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("S"), F.col("user_id"))),
            F.lit("version"),
            F.when(F.col("event_id") % 11 == 0, F.lit("0.1.2")).otherwise(F.lit("0.3.0")),
        ).alias("config"),
    )
