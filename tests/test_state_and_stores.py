"""Keyed state, compaction, checked writes, day sets, variants and SQL functions on exact cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidebook.functions import days
from tidebook.operators import funnel, outcomes
from tidebook.operators.bars import split_like_gap
from tidebook.sources import sinks, sql_functions
from tidebook.streaming import compaction, outcome_state, run_state
from tidebook.streaming import trades as stream

START = dt.date(2024, 1, 1)
PRICE = "ticker string, trade_date date, open double, high double, low double, close double, source string, ingested_at timestamp_ntz"


def day(i):
    return START + dt.timedelta(i)


# --- sets of days


def test_day_sets_hold_exactly_their_days(spark):
    held = {"a": ["1969-12-31", "1970-01-01", "1970-01-02", "2059-09-18", "2059-09-19", "0001-01-01", "9999-12-31"], "b": ["2024-02-29"] * 3, "c": [None]}
    rows = spark.createDataFrame([(k, d) for k, ds in held.items() for d in ds], "k string, d string").withColumn("d", F.to_date("d"))
    sets = days.day_sets(days.day_bits(rows, ["k"], "d"), ["k"], "days")
    asked = sorted({*held["a"], *held["b"], "1970-01-03", "1880-01-01", "2059-09-17", "2024-02-28"})
    ask = spark.createDataFrame([(d,) for d in asked], "d string").withColumn("d", F.to_date("d"))
    got = sets.join(ask).select("k", F.col("d").cast("string").alias("d"), F.expr(days.has_day("days", "d")).alias("has")).collect()
    assert {(r.k, r.d) for r in got if r.has} == {(k, d) for k, ds in held.items() for d in ds if d}
    assert {r.k for r in got} == {"a", "b"}  # a key without days has no row
    counted = sets.selectExpr("k", days.days_held("days", "array(DATE '2024-02-29', DATE '1970-01-02', NULL)") + " AS n").collect()
    assert {r.k: r.n for r in counted} == {"a": 1, "b": 1}
    none = spark.sql("SELECT CAST(NULL AS MAP<BIGINT, BINARY>) AS days").selectExpr(days.has_day("days", "DATE '2024-01-01'") + " AS has").first()
    assert none.has is False


# --- open outcomes


@pytest.fixture(scope="module")
def priced(spark):
    rng, rows = random.Random(1), []
    for ticker in ("A", "B", "C"):
        close = 100.0
        for i in range(90):
            if ticker == "C" and i % 7 == 3:
                continue
            open_ = close * (0.5 if ticker == "B" and i == 40 else 1 + rng.uniform(-0.02, 0.02))
            close = open_ * (1 + rng.uniform(-0.02, 0.02))
            new = dt.datetime(2024, 6, 2)
            rows.append((ticker, day(i), open_, max(open_, close) * 1.01, min(open_, close) * 0.99, close, "X", new))
            if i % 10 == 0:  # an older row of the day, which must lose
                rows.append((ticker, day(i), 1.0, 2.0, 0.5, 1.5, "A", dt.datetime(2024, 6, 1)))
    return spark.createDataFrame(rows, PRICE).cache()


def test_tracked_outcomes_are_those_of_the_batch_refresh(spark, priced, tmp_path):
    signals = [(f"R{i}", t, day(i), "PENDING", None) for t in "ABCD" for i in range(0, 100, 4)] + [("R1", "A", day(1), "COMPLETE", None)]
    stored = spark.createDataFrame(signals, "run_id string, ticker string, as_of_date date, evaluation_status string, evaluated_through date")
    now = F.lit("2024-07-01").cast("timestamp")
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    cut = F.datediff("trade_date", F.lit(START)) >= 45
    for late in (False, True):  # the second query goes on from the checkpoint
        priced.where(cut == late).write.mode("append").parquet(source)
        outcome_state.track_outcomes(spark.readStream.schema(priced.schema).parquet(source), stored, table, checkpoint, now=now).awaitTermination()
    tracked = outcome_state.tracked_outcomes(spark, table)
    want = outcomes.refresh_signal_outcomes(stored, priced, now)
    columns = [c for c in want.columns if c != "evaluated_through"]
    key = lambda r: (r.ticker, r.run_id)
    got = sorted(tracked.select(columns).collect(), key=key)
    assert got == sorted(want.select(columns).collect(), key=key) and len(got) > 50
    assert {r.evaluation_status for r in got} == {"PENDING", "PARTIAL", "COMPLETE", "EXCLUDED"}
    early = {(r.run_id, r.ticker) for r in tracked.where(F.col("evaluated_through") < day(45)).collect()}
    assert early == {(f"R{i}", "B") for i in range(0, 40, 4)}  # closed by the gap in the first delivery


def test_gap_in_state_is_the_gap_of_the_batch(spark):
    rng = random.Random(3)
    rows = [tuple(rng.choice([None, 0.0, -1.0, 10.0, 20.0, 21.0, 30.0, 33.0, 100.0, 104.0, 5.0]) for _ in range(3)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "prev double, open double, close double")
    want = [r.gap for r in frame.select(split_like_gap(F.col("prev"), F.col("open"), F.col("close")).alias("gap")).collect()]
    assert [outcome_state.gap_like(*r, outcome_state.SPLIT_FACTORS) for r in rows] == want and any(want)


# --- heartbeats


def test_runs_go_stale_as_the_clock_passes(spark, tmp_path):
    noon = dt.datetime(2024, 1, 20, 12)
    ago = lambda m: noon - dt.timedelta(minutes=m)
    schema = "id long, status string, error_count int, started_at timestamp_ntz, heartbeat_at timestamp_ntz, at timestamp_ntz"
    batches = [
        [(1, "RUNNING", 0, ago(100), None, ago(100)), (2, "RUNNING", 0, ago(100), ago(90), ago(90)), (3, "RUNNING", 0, ago(60), ago(45), ago(45)), (7, "RUNNING", 2, ago(46), None, ago(46))],
        [(2, "RUNNING", 0, ago(100), ago(50), ago(40)), (4, "RUNNING", 0, ago(60), ago(44), ago(30)), (7, "RUNNING", 2, ago(46), None, ago(20)), (2, "RUNNING", 0, ago(100), ago(10), ago(9))],
        [(None, None, None, None, None, noon), (5, "COMPLETED", 0, ago(60), ago(50), noon), (5, "RUNNING", 0, ago(60), ago(50), noon)],
    ]
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        updates = run_state.run_updates(spark.readStream.schema(schema).parquet(source), F.col("at"))
        run_state.watch_runs(updates, table, checkpoint).awaitTermination()
    # 3 is exactly as old as allowed; 5 has ended, whatever order its updates come in.
    got = {(r.id, r.status, r.error_count) for r in run_state.stale_found(spark, table).collect()}
    assert got == {(1, "FAILED", 1), (7, "FAILED", 2)}
    with pytest.raises(ValueError, match="within 15 and 120"):
        run_state.watch_runs(updates, table, checkpoint, 10)


def test_state_of_runs_is_a_table_of_open_ones(spark, tmp_path):
    """No run is handled by itself, and none stays in the state when its time has passed."""
    noon = dt.datetime(2024, 1, 20, 12)
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    runs = spark.range(20_000).select(
        "id", F.when(F.col("id") % 4 == 0, "COMPLETED").otherwise("RUNNING").alias("status"), F.lit(0).alias("error_count"),
        F.lit(noon).cast("timestamp_ntz").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("heartbeat_at"),
    )
    schema = "id long, status string, error_count int, started_at timestamp_ntz, heartbeat_at timestamp_ntz, at timestamp_ntz"
    for minutes in (0, 60):
        at = F.lit(noon + dt.timedelta(minutes=minutes)).cast("timestamp_ntz")
        # An hour later one run comes that is new, and an update that is too late to revive its run.
        rows = runs.withColumn("at", at) if not minutes else runs.limit(0).withColumn("at", at).unionByName(
            spark.createDataFrame([(99_999, "RUNNING", 0, noon + dt.timedelta(minutes=60), None, noon + dt.timedelta(minutes=60)), (4, "RUNNING", 0, noon, None, noon)], schema)
        )
        rows.coalesce(1).write.mode("append").parquet(source)
        updates = run_state.run_updates(spark.readStream.schema(schema).parquet(source), F.col("at"))
        run_state.watch_runs(updates, table, checkpoint).awaitTermination()
    assert run_state.stale_found(spark, table).count() == 15_000
    open_ = spark.read.schema(run_state.KEPT).parquet(f"{checkpoint}/runs/batch=1").where("NOT due AND id IS NOT NULL")
    assert [r.id for r in open_.collect()] == [99_999]


# --- compaction


def test_folded_deliveries_take_late_corrections(spark, tmp_path):
    schema = "ticker string, trade_date date, participant_buy string, participant_sell string, volume double, value double"
    source, root = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()

    def deliver(name, *rows):
        spark.createDataFrame(list(rows), schema).toPandas().to_parquet(source / name, index=False)

    def ingest():
        raw = spark.readStream.schema(schema).parquet(str(source))
        by = lambda name: F.regexp_extract(name, r"^([^.]+)", 1)
        stream.ingest_trade_days(raw, compaction.deliveries_path(root), str(tmp_path / "checkpoint"), delivery=by).awaitTermination()

    def flow():
        return {(r.ticker, str(r.trade_date), r.participant): (r.buy_value, r.sell_value) for r in compaction.compacted_flow(spark, root).collect()}

    june, july = dt.date(2026, 6, 3), dt.date(2026, 7, 3)
    deliver("d1.v1.parquet", ("A", june, "P", "Q", 1.0, 10.0), ("A", july, "P", "Q", 1.0, 5.0))
    deliver("d2.v1.parquet", ("A", june, "P", "R", 1.0, 7.0))
    ingest()
    before = flow()
    compaction.compact(spark, root)
    assert flow() == before == {
        ("A", "2026-06-03", "P"): (17.0, 0.0), ("A", "2026-06-03", "Q"): (0.0, 10.0), ("A", "2026-06-03", "R"): (0.0, 7.0),
        ("A", "2026-07-03", "P"): (5.0, 0.0), ("A", "2026-07-03", "Q"): (0.0, 5.0),
    }
    assert sinks.partitions(spark, compaction.deliveries_path(root)) == []
    deliver("d1.v2.parquet", ("A", june, "S", "Q", 1.0, 3.0))  # it has no July any more
    ingest()
    want = {("A", "2026-06-03", "P"): (7.0, 0.0), ("A", "2026-06-03", "Q"): (0.0, 3.0), ("A", "2026-06-03", "R"): (0.0, 7.0), ("A", "2026-06-03", "S"): (3.0, 0.0)}
    assert flow() == want
    compaction.compact(spark, root)
    assert flow() == want and [p["trade_month"] for p in sinks.partitions(spark, f"{root}/base")] == ["202606"]
    compaction.compact(spark, root)  # nothing new
    assert flow() == want
    deliver("d3.v1.parquet", ("A", dt.date(2026, 6, 20), "P", "Q", 1.0, 1.0))
    ingest()
    compaction.compact(spark, root, F.lit("2026-06-10").cast("date"))
    assert flow() == {("A", "2026-06-20", "P"): (1.0, 0.0), ("A", "2026-06-20", "Q"): (0.0, 1.0)}
    assert compaction.retain(spark, root, F.lit("2026-07-01").cast("date")) == [202606]


def test_old_partition_folders_are_dropped(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.drop_partitions(spark, path, "d", "2024") == [] and not sinks.remove(spark, path)
    spark.sql("SELECT explode(array('2023-01-01', '2024-01-01', '2024-01-02')) AS d, 1 AS v").write.partitionBy("d").parquet(path)
    assert sinks.drop_partitions(spark, path, "d", "2024-01-02") == ["2023-01-01", "2024-01-01"]
    assert [str(r.d) for r in spark.read.parquet(path).collect()] == ["2024-01-02"]


# --- sinks


def test_a_write_that_loses_rows_fails_the_run(spark, tmp_path):
    path = str(tmp_path / "r")
    assert sinks.write_results(spark.range(7), path, "whole") == 7
    with pytest.raises(sinks.WriteMismatch, match="run short: expected 7 rows, found 5"):
        sinks.write_results(spark.range(7), path, "short", lambda df: df.where("id < 5").write.mode("append").partitionBy("run_id").parquet(path))
    assert sinks.write_results(spark.range(7).where("id < 0"), path, "empty") == 0


def test_landing_counts_what_it_rejects(spark, tmp_path):
    path, audit = str(tmp_path / "t"), str(tmp_path / "a")
    rows = spark.range(100).withColumn("v", F.when(F.col("id") % 10 != 0, F.col("id")))
    assert sinks.land_accepted(rows, F.col("v") > 9, path, audit, "P", "D") == {"received": 100, "accepted": 81, "rejected": 19}
    assert sinks.land_accepted(rows, F.lit(False), path, audit, "P", "E") == {"received": 100, "accepted": 0, "rejected": 100}
    assert spark.read.parquet(path).count() == 81
    assert {(r.dataset, r.status) for r in spark.read.parquet(audit).collect()} == {("D", "COMPLETED"), ("E", "INSUFFICIENT")}


# --- diagnostics


def test_bad_diagnostics_are_an_object_without_fields(spark):
    texts = ['{"guarded_rank": 2, "guarded_score": 1.5, "x": null}', '{"guarded_rank": "a"}', "", None, "{", "[1]", "3", '"text"', "null", "{}"]
    rows = funnel.parse_diagnostics(spark.createDataFrame(list(enumerate(texts)), "i int, diagnostics string"))
    got = rows.select("i", F.to_json("diagnostics").alias("text"), funnel._diag_field(rows, "guarded_rank", "int").alias("rank")).orderBy("i").collect()
    assert [r.rank for r in got] == [2] + [None] * 9 and all(r.text == "{}" for r in got[2:])
    assert funnel.parse_diagnostics(rows).schema == rows.schema


# --- SQL functions


def test_sql_price_cache(spark, priced):
    sql_functions.register_prices(spark, priced.withColumn("volume", F.lit(1.0)))
    got = spark.sql("SELECT * FROM price_cache(array(' a '), 2)").collect()
    assert [(r.ticker, r.trade_date) for r in sorted(got, key=lambda r: r.trade_date)] == [("A", day(88)), ("A", day(89))]
    assert {r.ticker: len(r.payload) for r in spark.sql("SELECT * FROM price_cache_by_ticker(NULL, 3)").collect()} == {"A": 3, "B": 3, "C": 3}
    assert spark.sql("SELECT * FROM price_cache(array('none'), 3)").count() == 0


# --- rows without an order


def test_rows_of_a_key_that_differ_need_an_order(spark):
    from tidebook.functions.frames import last_by_key

    rows = spark.createDataFrame([("a", 1, 5), ("a", 9, 1), ("b", 2, 3), ("b", 2, 4)], "k string, v int, at int")
    assert {(r.k, r.v) for r in last_by_key(rows, ["k"], "at", "rows").collect()} == {("a", 1), ("b", 2)}
    assert [tuple(r) for r in last_by_key(rows.where("k = 'b'").drop("at"), ["k"], None, "rows").collect()] == [("b", 2)]
    with pytest.raises(Exception, match='no order among them: {"k":"a"}'):
        last_by_key(rows.drop("at"), ["k"], None, "rows").collect()


def test_outcomes_of_a_day_that_is_there_twice(spark):
    bars = [("A", day(i), 1.0, 1.0, 1.0, 10.0 + i, 1) for i in range(10)] + [("A", day(3), 1.0, 1.0, 1.0, 5.0, 2)]
    frame = spark.createDataFrame(bars, "ticker string, date date, open double, high double, low double, close double, at int")
    signals = spark.createDataFrame([("R", "A", day(3))], "run_id string, ticker string, as_of_date date")
    assert outcomes.compute_signal_outcomes(signals, frame, "at").first().entry_close == 5.0
    with pytest.raises(Exception, match="two bars of one ticker-day: A 2024-01-04"):
        outcomes.compute_signal_outcomes(signals, frame).collect()
