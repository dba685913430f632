"""Queries over streams: the tables arrive in four deliveries of days, each read by a query that is
started anew and goes on from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebook.functions.frames import staged
from tidebook.plans import catalogue as Q
from tidebook.plans.catalogue import query
from tidebook.sources import tables as T
from tidebook.sources import sinks
from tidebook.streaming import compaction, outcome_state, run_state
from tidebook.streaming import trades as stream

CUTS = ("1996-09-15", "1998-06-01", "2000-02-15")


def cut_of(day: str, cuts: tuple[str, ...] = CUTS, kind: str = "DATE") -> str:
    """SQL text: the delivery that brings ``day``."""
    steps = " ".join(f"WHEN {day} < {kind} '{c}' THEN {k}" for k, c in enumerate(cuts))
    return f"CASE {steps} ELSE {len(cuts)} END"


def _hand_over(spark: SparkSession, made: str, arriving: str, name: str) -> None:
    """The files of a folder, moved among the arriving ones under ``name``; no row is read or written."""
    files, source = sinks._file_system(spark, made)
    home = sinks._file_system(spark, arriving)[1]
    files.mkdirs(home)
    if not files.exists(source):  # a delivery without rows
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = sorted(x.getPath().getName() for x in files.listStatus(source) if x.getPath().getName().startswith("part-"))
    for k, file in enumerate(found):
        assert files.rename(path(source, file), path(home, f"{name}.p{k:05d}.parquet"))


def _delivered(
    rows: DataFrame, cut: str, home: str, start: Callable[[DataFrame], StreamingQuery], last: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Hands over one delivery after the other and lets a new query take each. All are written in one
    pass over the rows. ``last``, made from all that was delivered, comes with the last one."""
    spark = rows.sparkSession
    rows.withColumn("_cut", F.expr(cut)).write.partitionBy("_cut").parquet(f"{home}/made")
    for k in range(4):
        _hand_over(spark, f"{home}/made/_cut={k}", f"{home}/in", f"cut{k}")
        if k == 3 and last is not None:
            held = spark.read.schema(rows.schema).parquet(f"{home}/in")
            last(held).select(rows.columns).write.mode("append").parquet(f"{home}/in")
        start(spark.readStream.schema(rows.schema).parquet(f"{home}/in")).awaitTermination()


GAP = """prev > 0 AND open > 0 AND abs(open / prev - 1) >= 0.35 AND abs(close / open - 1) <= 0.25 AND list_min(list_transform(
  [0.1, 0.2, 0.25, 1.0 / 3.0, 0.5, 2.0, 3.0, 4.0, 5.0, 10.0], lambda f: abs(open / prev - f) / f)) <= 0.06"""


@query(
    Q.OUTCOME_SPEC + " stamped",
    f"""SELECT o.* REPLACE (coalesce(c.through, o.evaluated_through) AS evaluated_through), evaluation_status <> 'PENDING' AS stamped FROM outcomes_rough o LEFT JOIN (
      WITH g AS (SELECT *, {cut_of('date')} AS cut, coalesce({GAP}, FALSE) AS gap FROM (
          SELECT ticker, date, open, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM bars_rough)),
        m AS (SELECT ticker, cut, max(max(date)) OVER (PARTITION BY ticker ORDER BY cut) AS through FROM g GROUP BY ticker, cut)
      SELECT x.run_id, x.ticker, m.through FROM (
        SELECT s.run_id, s.ticker, min(b.cut) AS cut FROM signals_rough s JOIN g e ON e.ticker = s.ticker AND e.date = s.as_of_date
        JOIN g b ON b.ticker = s.ticker AND b.pos BETWEEN e.pos + 1 AND e.pos + 60 AND (b.gap OR b.pos = e.pos + 60) GROUP BY s.run_id, s.ticker) x
      JOIN m ON m.ticker = x.ticker AND m.cut = x.cut) c ON c.run_id = o.run_id AND c.ticker = o.ticker
    WHERE CAST(substr(o.run_id, 2) AS INT) % 3 <> 0 AND CAST(substr(o.run_id, 2) AS INT) % 5 <> 0""",
)
def stream_outcomes(spark, root):
    """Open outcomes of bars with split-like gaps: each closes with the delivery that brings its last
    bar or its gap, and stands as it was then."""
    home = Q._home(spark, "open-outcomes")
    prices = staged(T.daily_prices(spark, root, rough=True), "prices")
    stored = staged(Q._stored_outcomes(spark, root, rough=True), "outcomes")
    now = F.lit(Q.NOW).cast("timestamp_ntz")

    def start(arriving: DataFrame) -> StreamingQuery:
        return outcome_state.track_outcomes(arriving, stored, f"{home}/table", f"{home}/checkpoint", now=now)

    _delivered(prices, cut_of("trade_date"), home, start)
    return outcome_state.tracked_outcomes(spark, f"{home}/table").withColumn("stamped", F.col("evaluated_at").isNotNull())


RUN_CUTS = ("2024-01-07 00:00:00", "2024-01-13 06:00:00", "2024-01-20 11:30:00")


@query(
    "id:i status error_count:i stale_failure_reason stale_max_age_minutes",
    f"""SELECT id, 'FAILED' AS status, 1 AS error_count, 'SERVER_CRON_STALE_HEARTBEAT' AS stale_failure_reason, '45' AS stale_max_age_minutes
        FROM runs WHERE status = 'RUNNING' AND coalesce(heartbeat_at, started_at) < TIMESTAMP '{Q.NOW}' - INTERVAL 45 MINUTE""",
)
def stream_stale_runs(spark, root):
    """Each run arrives when it starts and again with its last heartbeat; what would arrive after now arrives now."""
    home, now = Q._home(spark, "run-state"), F.lit(Q.NOW).cast("timestamp_ntz")
    runs = T.runs(spark, root)
    started = runs.withColumns({"status": F.lit("RUNNING"), "heartbeat_at": F.lit(None).cast("timestamp_ntz")})
    at_start = run_state.run_updates(started, F.least("started_at", now))
    at_end = run_state.run_updates(runs, F.least(F.expr("started_at + INTERVAL 10 MINUTES"), now))
    updates = staged(at_start.unionByName(at_end), "run-updates")
    tick = spark.range(1).select(
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("error_count"),
        F.lit(0).cast("long").alias("seen"), now.cast("timestamp").alias("at"),
    )

    def start(arriving: DataFrame) -> StreamingQuery:
        return run_state.watch_runs(arriving, f"{home}/table", f"{home}/checkpoint")

    _delivered(updates, cut_of("at", RUN_CUTS, "TIMESTAMP"), home, start, lambda held: tick)
    return run_state.stale_found(spark, f"{home}/table")


def _to_files(rows: DataFrame, home: str) -> StreamingQuery:
    sink = rows.writeStream.format("parquet").option("path", f"{home}/table").option("checkpointLocation", f"{home}/checkpoint")
    return sink.outputMode("append").trigger(availableNow=True).start()


@query(
    "ticker trade_date participant buy_volume:4 buy_value:4 sell_volume:4 sell_value:4",
    "SELECT * FROM flow",
)
def stream_event_totals(spark, root):
    """Daily sums by event time. With the last delivery the first one comes again, too late to count,
    and a row far ahead, which closes all days before it."""
    home = Q._home(spark, "event-totals")
    columns = ("ticker", "participant_buy", "participant_sell", "volume", "value")
    trades = T.trades(spark, root).select(F.expr("CAST(trade_date AS TIMESTAMP) + INTERVAL 9 HOURS").alias("ts"), *columns)
    ahead = spark.range(1).select(F.lit("2100-01-01").cast("timestamp").alias("ts"), *(F.lit(None).cast(trades.schema[c].dataType).alias(c) for c in columns))
    cut = cut_of("ts", CUTS, "TIMESTAMP")

    def late(held: DataFrame) -> DataFrame:
        return held.where(f"{cut} = 0").unionByName(ahead)

    _delivered(trades, cut, home, lambda arriving: _to_files(stream.daily_totals(arriving), home), late)
    return spark.read.parquet(f"{home}/table")


TRADE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "l_suppkey:i deliveries:i quantity:4",
    f"""SELECT l_suppkey, count(*) AS deliveries, sum(l_quantity) AS quantity FROM (
          SELECT DISTINCT l_shipdate, {', '.join(TRADE_KEY)} FROM lineitem
          UNION ALL SELECT DISTINCT l_shipdate, {', '.join(TRADE_KEY)} FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUTS[0]}' AND l_orderkey % 8 = 1) GROUP BY l_suppkey""",
)
def stream_redelivery(spark, root):
    """Rows that are delivered again: at once (dropped), too late (dropped) and under a new event time
    beyond the delay (a delivery of their own)."""
    home = Q._home(spark, "redelivery")
    rows = staged(T.table(spark, root, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("ts"), *TRADE_KEY), "timed-lineitem")
    first = rows.where(cut_of("ts", CUTS, "TIMESTAMP") + " = 0")
    again = first.where("l_orderkey % 8 = 1").withColumn("ts", F.expr("ts + INTERVAL 2600 DAYS"))
    late = first.where("l_orderkey % 8 = 2")
    twice = rows.unionByName(rows.where("l_orderkey % 4 = 0"))
    _delivered(twice, cut_of("ts", CUTS, "TIMESTAMP"), home, lambda arriving: _to_files(stream.drop_repeats(arriving, TRADE_KEY), home), lambda held: late.unionByName(again))
    held = spark.read.parquet(f"{home}/table")
    return held.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("deliveries"), F.sum("l_quantity").alias("quantity"))


def _compacting(spark: SparkSession, root: str, name: str) -> str:
    """Eight deliveries, folded after five and again at the end; the third was wrong at first and comes
    again after it was folded, as does the last before it is. A delivery is as many files as its rows
    need, and all of them are written in one pass over the rows, wrong ones in another."""
    home, lineitem = Q._home(spark, name), T.table(spark, root, "lineitem")
    sliced = lineitem.withColumn("_slice", F.pmod(F.xxhash64("l_orderkey"), F.lit(8)))
    wrong = sliced.where("_slice IN (2, 7)").withColumns(
        {"l_quantity": F.col("l_quantity") * 2, "l_suppkey": F.lit(1).cast("long"), "l_shipdate": F.expr("l_shipdate - INTERVAL 200 DAYS")}
    )
    for kind, rows in (("wrong", wrong), ("right", sliced)):
        rows.write.partitionBy("_slice").parquet(f"{home}/{kind}")

    def deliver(kind: str, k: int, version: int) -> None:
        _hand_over(spark, f"{home}/{kind}/_slice={k}", f"{home}/in", f"d{k}.v{version}")

    def ingest() -> None:
        raw = stream.trade_stream(spark, f"{home}/in", lineitem.schema)
        stream.ingest_trade_days(
            raw, compaction.deliveries_path(f"{home}/table"), f"{home}/checkpoint", prepare=lambda batch: T.trades(spark, root, batch),
            delivery=lambda file: F.substring_index(file, ".", 1), version=lambda file: F.substring_index(file, ".", 2),
        ).awaitTermination()

    for k in range(5):
        deliver("wrong" if k == 2 else "right", k, 1)
    ingest()
    compaction.compact(spark, f"{home}/table")
    for kind, k, version in (("right", 5, 1), ("right", 6, 1), ("wrong", 7, 1), ("right", 2, 2)):
        deliver(kind, k, version)
    ingest()
    deliver("right", 7, 2)
    ingest()
    return f"{home}/table"


@query(Q.FLOW, "SELECT * FROM flow")
def stream_compacted(spark, root):
    """Folded deliveries, a late correction of one of them and deliveries since, read together."""
    return compaction.compacted_flow(spark, _compacting(spark, root, "compacted"))


@query(
    Q.FLOW + " months:i",
    """SELECT *, (SELECT count(DISTINCT year(trade_date) * 100 + month(trade_date)) FROM flow WHERE trade_date >= DATE '2001-06-30' - 45) AS months
       FROM flow WHERE trade_date >= DATE '2001-06-30' - 45""",
)
def stream_dropped_months(spark, root):
    """The same after the second compaction and with old months deleted; how many month folders are left."""
    table = _compacting(spark, root, "dropped")
    compaction.compact(spark, table, F.date_sub(F.lit(Q.AS_OF).cast("date"), 45))
    assert not sinks.partitions(spark, compaction.deliveries_path(table))
    left = len(sinks.partitions(spark, f"{table}/base"))
    return compaction.compacted_flow(spark, table).withColumn("months", F.lit(left))


@query(
    "trade_month bars:i",
    "SELECT strftime(date, '%Y-%m') AS trade_month, count(*) AS bars FROM bars WHERE strftime(date, '%Y-%m') >= strftime(DATE '2001-06-30' - 550, '%Y-%m') GROUP BY ALL",
)
def prices_retained(spark, root):
    """Prices by month folder, months wholly older than 550 days deleted as folders."""
    path = f"{Q._home(spark, 'price-months')}/table"
    rows = T.bars(spark, root).withColumn("trade_month", F.date_format("date", "yyyy-MM"))
    sinks.land_partitioned(rows.hint("rebalance", "trade_month"), path, "trade_month")
    sinks.drop_partitions(spark, path, "trade_month", str(date.fromisoformat(Q.AS_OF) - timedelta(550))[:7])
    return spark.read.parquet(path).groupBy("trade_month").agg(F.count(F.lit(1)).alias("bars"))
