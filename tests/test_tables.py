"""Sinks and streams: keyed replacement, count check, stream equals batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidebook.operators.participants import aggregate_trades
from tidebook.plans import stream_queries
from tidebook.sources import sinks
from tidebook.streaming import trades as stream

TRADES = "ticker string, trade_date date, participant_buy string, participant_sell string, volume double, value double"


def rows(day, factor=1.0):
    d = dt.date(2026, 8, day)
    return [("A", d, "P", "Q", 10.0 * factor, 100.0 * factor), ("A", d, "Q", "R", 5.0 * factor, 40.0 * factor)]


def test_upsert_replaces_only_its_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k string, day string, v int"
    sinks.upsert(spark.createDataFrame([("a", "d1", 1), ("b", "d1", 2), ("c", "d2", 3)], schema), path, ["k", "day"], "day")
    sinks.upsert(spark.createDataFrame([("b", "d1", 20), ("e", "d1", 5)], schema), path, ["k", "day"], "day")
    got = {(r.k, r.day, r.v) for r in spark.read.parquet(path).collect()}
    assert got == {("a", "d1", 1), ("b", "d1", 20), ("c", "d2", 3), ("e", "d1", 5)}


def test_result_count_is_checked(spark, tmp_path):
    path = str(tmp_path / "r")
    assert sinks.write_results(spark.range(7), path, "run-1") == 7


def test_partition_must_follow_from_the_key(spark, tmp_path):
    with pytest.raises(ValueError, match="must be one of the keys"):
        sinks.upsert(spark.createDataFrame([("a", "d1")], "k string, day string"), str(tmp_path / "t"), ["k"], "day")


def test_strict_json_reaches_nested_values(spark):
    df = spark.sql("SELECT named_struct('a', double('nan'), 'b', array(1D, double('inf'))) AS c, map('k', float('nan')) AS m")
    assert sinks.strict_json(df).collect()[0].value == '{"c":{"a":null,"b":[1.0,null]},"m":{"k":null}}'


def test_strict_json_has_no_nan(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), 1.5)], "a double, b double, c double")
    assert sinks.strict_json(df).collect()[0].value == '{"a":null,"b":null,"c":1.5}'


def test_stream_equals_batch_with_a_repeated_day(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    # a day in two files, and a correction of the second of them that lacks a trade
    for name, data in (("day12a.v1", rows(12)), ("day13.v1", rows(13)), ("day12b.v1", rows(12, 3.0)), ("day12b.v2", rows(12, 2.0)[:1])):
        folder = str(tmp_path / name)
        spark.createDataFrame(data, TRADES).coalesce(1).write.parquet(folder)
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / "in" / f"{name}.parquet")
        schema = spark.read.parquet(source).schema
        stream.ingest_trade_days(
            stream.trade_stream(spark, source, schema), table, str(tmp_path / "checkpoint"),
            delivery=lambda file: F.substring_index(file, ".", 1),
        ).awaitTermination()
    want = aggregate_trades(spark.createDataFrame(rows(12) + rows(13) + rows(12, 2.0)[:1], TRADES))
    columns = ["ticker", "trade_date", "participant", "buy_value", "sell_value", "net_value"]
    got = stream.flow_table(spark, table).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*columns).collect()))
    kept = stream.retained(spark, table, "2026-09-27", 45).select("trade_date").distinct().collect()
    assert [r[0] for r in kept] == [dt.date(2026, 8, 13)]


def test_a_large_delivery_is_not_one_tasks(spark, tmp_path):
    """A file of many months is written by months, each by a task of its own."""
    days = spark.range(400).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("trade_date"))
    rows = days.select(
        F.lit("A").alias("ticker"), "trade_date", F.lit("P").alias("participant_buy"), F.lit("Q").alias("participant_sell"), F.lit(1.0).alias("volume"), F.lit(2.0).alias("value")
    )
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    rows.coalesce(1).write.parquet(source)
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merging)
    spark.conf.set(merging, "false")
    try:
        stream.ingest_trade_days(stream.trade_stream(spark, source, rows.schema), table, str(tmp_path / "c")).awaitTermination()
    finally:
        spark.conf.set(merging, before)
    assert len(spark.read.parquet(table).inputFiles()) > 1
    assert stream.flow_table(spark, table).count() == 800


def test_a_delivery_of_several_files_adds_up(spark, tmp_path):
    """Files of one version count together, and a later version replaces all of them."""
    source, table = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    schema = None
    for batch in ((("d1.v1.p0", rows(12)), ("d1.v1.p1", rows(13)), ("d2.v1.p0", rows(14))), (("d1.v2.p0", rows(12, 2.0)), ("d1.v2.p1", rows(15)[:1]))):
        for name, data in batch:
            spark.createDataFrame(data, TRADES).coalesce(1).write.parquet(str(tmp_path / name))
            next((tmp_path / name).glob("*.parquet")).rename(source / f"{name}.parquet")
        schema = schema or spark.read.parquet(str(source)).schema
        stream.ingest_trade_days(
            stream.trade_stream(spark, str(source), schema), table, str(tmp_path / "checkpoint"),
            delivery=lambda file: F.substring_index(file, ".", 1), version=lambda file: F.substring_index(file, ".", 2),
        ).awaitTermination()
    want = aggregate_trades(spark.createDataFrame(rows(12, 2.0) + rows(15)[:1] + rows(14), TRADES))
    columns = ["ticker", "trade_date", "participant", "buy_value", "sell_value", "net_value"]
    got = stream.flow_table(spark, table).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_deliveries_are_written_in_one_pass(spark, tmp_path):
    """Each delivery is as many files as tasks wrote of it, and none is written twice."""
    got = []

    def start(arriving):
        job = arriving.writeStream.foreachBatch(lambda batch, _: got.append((batch.count(), batch.select(F.input_file_name()).distinct().count())))
        return job.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()

    rows = spark.range(0, 90, 1, 3).withColumn("day", F.pmod("id", F.lit(3)))
    stream_queries._delivered(rows, "CAST(day AS INT)", str(tmp_path), start, lambda held: held.where("day = 0"))
    assert [n for n, _ in got] == [30, 30, 30, 30] and got[0][1] == 3


def test_event_time_daily_totals(spark, tmp_path):
    source = str(tmp_path / "ticks")
    data = [(dt.datetime(2026, 8, 12, 9), "A", "P", "Q", 1.0, 10.0), (dt.datetime(2026, 8, 20, 9), "A", "P", "Q", 1.0, 1.0)]
    schema = "ts timestamp, ticker string, participant_buy string, participant_sell string, volume double, value double"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(source)
    live = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    job = (
        stream.daily_totals(live, "1 day").writeStream.format("memory").queryName("totals").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    job.awaitTermination()
    closed = spark.table("totals").where(F.col("trade_date") == dt.date(2026, 8, 12)).collect()
    assert {(r.participant, r.buy_value, r.sell_value) for r in closed} == {("P", 10.0, 0.0), ("Q", 0.0, 10.0)}


def test_outcomes_advance_with_arriving_bars(spark, tmp_path):
    price_in, prices, table = (str(tmp_path / n) for n in ("in", "prices", "outcomes"))
    dates = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(8)]
    bars = [("A", d, 10.0 + i, 11.0 + i, 9.0 + i, 10.0 + i, "S", dt.datetime(2026, 2, 1)) for i, d in enumerate(dates)]
    schema = "ticker string, trade_date date, open double, high double, low double, close double, source string, ingested_at timestamp"
    spark.createDataFrame(bars, schema).coalesce(1).write.parquet(price_in)
    held = "run_id string, ticker string, as_of_date date, evaluation_status string, evaluated_through date, return_5d double"
    spark.createDataFrame([("r", "A", dates[0], "PENDING", None, None)], held).write.partitionBy("run_id").parquet(table)
    live = spark.readStream.schema(spark.read.parquet(price_in).schema).parquet(price_in)
    universe = spark.createDataFrame([("A",)], "ticker string")
    stream.refresh_outcomes_on_bars(live, prices, table, universe, str(tmp_path / "c")).awaitTermination()
    row = spark.read.parquet(table).collect()[0]
    assert row.evaluation_status == "PARTIAL" and row.return_5d == 50.0 and row.evaluated_through == dates[-1]


@pytest.mark.parametrize("make", ["_scan", "_funnel"])
def test_scan_reads_the_trades_once(spark, monkeypatch, make):
    """Broker rows and foreign flow are made of the same stored sums."""
    from tidebook.plans import catalogue
    from tidebook.sources import tables

    calls, read = [], tables.trades
    monkeypatch.setattr(tables, "trades", lambda *a, **k: calls.append(a) or read(*a, **k))
    root = "/root/testdata/sf0.001"
    catalogue._scan(spark, root, "verified") if make == "_scan" else catalogue._funnel(spark, root)
    assert len(calls) == 1


def test_foreign_flow_of_unknown_nations_and_volumes(spark, monkeypatch):
    from tidebook.sources import tables

    day = dt.date(2020, 1, 1)
    rows = [("A", "N1", "N2", 5.0), ("A", "N2", "N1", 3.0), ("A", "N1", "N1", 2.0), ("A", "N1", "N9", 7.0), ("B", "N1", "N2", None), ("C", "N9", "N1", 1.0)]
    made = spark.createDataFrame([(t, day, b, s, v, v, "F", "R") for t, b, s, v in rows], "ticker string, trade_date date, participant_buy string, participant_sell string, volume double, value double, line_status string, return_flag string")
    nation = spark.createDataFrame([(1, 0), (2, 1)], "n_nationkey int, n_regionkey int")
    monkeypatch.setattr(tables, "trades", lambda *a: made)
    monkeypatch.setattr(tables, "table", lambda *a: nation)
    got = {(r.ticker, r.foreign_buy, r.foreign_sell, r.volume) for r in tables.foreign_flows(spark, "").collect()}
    assert got == {("A", 5.0, 3.0, 10.0), ("B", 0.0, 0.0, None)}
    brokers = tables.broker_flows(spark, "", True)
    assert {(r.ticker, r.broker_code, r.buy_volume, r.sell_volume) for r in brokers.where("ticker <> 'B'").collect()} == {
        ("A", "N1", 14.0, 5.0), ("A", "N2", 3.0, 5.0), ("A", "N9", 0.0, 7.0), ("C", "N9", 1.0, 0.0), ("C", "N1", 0.0, 1.0)
    }


@pytest.mark.parametrize(
    "name",
    ["participant_top10", "bars_last_n", "price_flow_features", "smc_levels", "broker_features", "outcomes_excluded", "duplicate_runs"],
)
def test_oracle(spark, name):
    from compare import differences, oracle_connection

    from tidebook.plans.catalogue import ORACLE, QUERIES

    root = "/root/testdata/sf0.001"
    got = QUERIES[name](spark, root).toPandas()
    assert differences(got, oracle_connection(root).execute(ORACLE[name]).df()) == []
