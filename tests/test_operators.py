"""Small exact cases, each worked out by hand or by a direct pandas computation."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.config import ScanConfig, ScoreWeights
from tidebook.functions.frames import average_rank_pct, latest_by_key
from tidebook.functions.scalars import between, canonical_ticker, lenient_bool
from tidebook.functions.text import clip, nearest_split_factor
from tidebook.operators import bars as B
from tidebook.operators import broker as K
from tidebook.operators import evidence, outcomes, planning, price
from tidebook.operators import participants as P
from tidebook.operators.scan import scan_universe
from tidebook.sources import payloads


def days(n, start="2026-01-02"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def bar_frame(spark, closes, ticker="AAA", start="2026-01-02", opens=None):
    opens = opens or [c - 0.5 for c in closes]
    rows = [
        (ticker, d, float(o), float(max(o, c) + 1), float(min(o, c) - 1), float(c), 2_000_000.0)
        for d, o, c in zip(days(len(closes), start), opens, closes)
    ]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")


def rising(n=100):
    return [100 + 8 * i / (n - 1) + math.sin(i / 5) for i in range(n)]


def test_scalar_rules(spark):
    df = spark.createDataFrame([(" bbca.jk ", "Yes", 0.48), (None, "no", 3.4)], "t string, b string, r double")
    out = df.select(
        canonical_ticker(F.col("t")).alias("t"), lenient_bool(F.col("b")).alias("b"), F.expr(nearest_split_factor("r")).alias("f")
    ).collect()
    assert [tuple(r) for r in out] == [("BBCA", True, 0.5), ("", False, 3.0)]


def test_bounds_keep_null(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (150.0,), (7.0,)], "x double")
    got = df.select(between(F.col("x"), 0.0, 100.0).alias("a"), F.expr(clip("x")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(None, None), (0.0, 0.0), (100.0, 100.0), (7.0, 7.0)]


def test_no_verified_row_is_no_verified_share(spark):
    rows = [("A", 10.0, 5.0, False), ("B", 0.0, 0.0, True), ("C", 3.0, 1.0, True), ("C", 4.0, 0.0, False)]
    got = K.verified_source_pct(spark.createDataFrame(rows, "ticker string, buy_value double, sell_value double, source_verified boolean"))
    assert {r.ticker: r.verified_source_pct for r in got.collect()} == {"A": 0.0, "B": 0.0, "C": 50.0}


def test_caps_are_errors_or_gone(spark):
    with pytest.raises(ValueError):
        B.last_n_bars(bar_frame(spark, rising(5)), 0)
    assert B.last_n_bars(bar_frame(spark, rising(700)), 650).count() == 650
    with pytest.raises(ValueError):
        ScanConfig(direct_min_brokers=1)
    with pytest.raises(ValueError):
        ScoreWeights(accumulation=0.5)


def test_trade_detail_and_top_participants(spark):
    trades = spark.createDataFrame(
        [("2026-08-14", "ELSA", "AB", "CD", 100.0, 100000.0), ("2026-08-14", "ELSA", "AB", "EF", 200.0, 200000.0), ("bad", "ELSA", "GH", "CD", 50.0, 50000.0)],
        "tradingdate string, asset string, participant_buy string, participant_sell string, volume double, value double",
    )
    universe = spark.createDataFrame([("ELSA",)], "ticker string")
    flow = P.aggregate_trade_detail(trades, "2026-08-14", universe)
    net = {r.participant: r.net_value for r in flow.collect()}
    assert net == {"AB": 300000.0, "CD": -150000.0, "EF": -200000.0, "GH": 50000.0}
    top = P.trim_top_participants(flow, 1).collect()
    assert {r.participant for r in top} == {"AB", "EF"}
    assert {(r.participant, r.net_rank, r.sell_rank) for r in top} == {("AB", 1, None), ("EF", 4, 2)}


def test_rank_matches_pandas_and_survives_a_hot_value(spark):
    values = [5.0] * 40 + [1.0, -2.0, 7.5, None, 0.0, -2.0]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    got = {r.id: r.p for r in average_rank_pct(df, "v", "p").collect()}
    want = pd.Series(values, dtype=float).rank(pct=True)
    assert all(math.isclose(got[i], want[i]) if want[i] == want[i] else got[i] is None for i in range(len(values)))


def test_latest_by_key_ignores_input_order(spark):
    rows = [("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", None, "n")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k string, n int, v string").repartition(3)
        assert {(r.k, r.v) for r in latest_by_key(df, ["k"], [F.col("n")]).collect()} == {("a", "z"), ("b", "n")}


def test_planner_takes_newest_day_first(spark):
    universe = spark.createDataFrame([("ELSA", 0), ("OMED", 1), ("MARK", 2)], "ticker string, position int")
    d14, d13 = dt.date(2026, 8, 14), dt.date(2026, 8, 13)
    wanted = spark.createDataFrame([(d13,), (d14,)], "trade_date date")
    have = spark.createDataFrame([("ELSA", d14), ("OMED", d13)], "ticker string, trade_date date")
    got = [tuple(r) for r in planning.missing_ticker_days(universe, wanted, have, 4).collect()]
    assert got == [("OMED", d14), ("MARK", d14), ("ELSA", d13), ("MARK", d13)]


def test_weekdays_fill_in_where_there_is_no_flow(spark):
    none = spark.createDataFrame([], "trade_date date")
    got = sorted(r[0] for r in planning.candidate_trade_dates(none, "2026-08-16", 3).collect())
    assert got == [dt.date(2026, 8, 12), dt.date(2026, 8, 13), dt.date(2026, 8, 14)]


def test_net_side_lots_become_shares(spark):
    text = '{"data":{"results":[{"broker":{"code":"yp"},"side":"BUY","lot":12345,"value":10,"avg":2},{"code":"AK","side":"HOLD","lot":1},{"code":"NI","side":"sell","lot":1,"symbol":"OTHER"}]}}'
    df = spark.createDataFrame([("ELSA", dt.date(2026, 8, 14), text), ("ELSA", dt.date(2026, 8, 14), "no json")], "ticker string, trade_date date, payload string")
    rows = payloads.net_side_broker(df).collect()
    assert [(r.broker_code, r.buy_volume, r.sell_volume) for r in rows] == [("YP", 1234500.0, 0.0)]


def test_chart_arrays(spark):
    text = '{"chart":{"result":[{"timestamp":[1767312000,1767315600,1767398400],"indicators":{"quote":[{"open":[1,2,3],"high":[1,2,3],"low":[1,2,3],"close":[1.0,2.0,null],"volume":[5,6]}]}}]}}'
    rows = payloads.chart_bars(spark.createDataFrame([("X", text)], "ticker string, payload string")).collect()
    assert [(r.date, r.close, r.volume) for r in rows] == [(dt.date(2026, 1, 2), 2.0, 6.0)]


@pytest.mark.parametrize("case", ["complete", "missing", "split"])
def test_outcomes(spark, case):
    closes = [100.0 + i for i in range(90)]
    opens = [c - 0.5 for c in closes]
    if case == "split":
        opens[13] = closes[12] * 0.5
        closes = closes[:13] + [c * 0.5 for c in closes[13:]]
    bars = bar_frame(spark, closes, opens=opens)
    signal_day = days(90)[10]
    if case == "missing":
        bars = bars.where(F.col("date") != F.lit(signal_day))
    signals = spark.createDataFrame([("r", "AAA", signal_day)], "run_id string, ticker string, as_of_date date")
    row = outcomes.compute_signal_outcomes(signals, bars).collect()[0]
    if case == "complete":
        assert row.evaluation_status == "COMPLETE" and row.entry_close == 110.0
        assert math.isclose(row.return_5d, 100 * (115 / 110 - 1)) and math.isclose(row.return_20d, 100 * (130 / 110 - 1))
    elif case == "missing":
        assert row.evaluation_status == "PENDING" and row.entry_close is None and row.evaluated_through is None
    else:
        assert row.evaluation_status == "EXCLUDED" and row.return_5d is None
        assert row.evaluation_note == outcomes.SPLIT_NOTE


def broker_frame(spark, day_list, verified=True, sides=("buy", "sell"), reverse_last=0):
    rows = []
    for i, d in enumerate(day_list):
        flip = i >= len(day_list) - reverse_last
        for codes, side in ((("YP", "BK", "AK"), "buy"), (("NI", "PD", "CC"), "sell")):
            if side not in sides:
                continue
            for code, scale in zip(codes, (1.0, 0.7, 0.5)):
                buys = (side == "buy") != flip
                value, volume = 1e9 * scale * (1 if not flip else 2.4), 1e7 * scale
                rows.append(
                    ("AAA", d, code, value if buys else 0.0, 0.0 if buys else value, volume if buys else 0.0, 0.0 if buys else volume, 100.0, 100.0, verified)
                )
    return spark.createDataFrame(
        rows,
        "ticker string, trade_date date, broker_code string, buy_value double, sell_value double, buy_volume double, sell_volume double, buy_avg double, sell_avg double, source_verified boolean",
    )


def test_broker_cohort(spark):
    bars = bar_frame(spark, rising())
    row = K.compute_broker_features(broker_frame(spark, days(100)[-60:]), B.bar_profile(bars)).collect()[0]
    assert row.coverage_pct == 100.0 and row.broker_balance_error_pct < 1e-9
    assert row.persistence_20d == 1.0 and row.broker_cohort_stability == 1.0
    assert row.top_accumulating_brokers == ["YP", "BK", "AK"] and row.accumulation_score > 65


def scan(spark, broker):
    bars = bar_frame(spark, rising())
    return scan_universe(bars.select("ticker").distinct(), bars, broker).collect()[0]


def test_scan_gates(spark):
    full = days(100)[-60:]
    direct = scan(spark, broker_frame(spark, full))
    assert direct.evidence_tier == "BROKER_DIRECT" and direct.diagnostics.broker_alpha_applied
    bare = scan(spark, None)
    pending = scan(spark, broker_frame(spark, full, verified=False))
    assert pending.evidence_tier == "PRICE_PROXY" and "verified_source=0.0%" in pending.guardrail_reason
    # Broker rows that fail the gate must not move any score.
    for name in ("score", "phase", "action", "retail_exhaustion_score", "price_flow_divergence_score", "distribution_risk"):
        assert pending[name] == bare[name]
    turned = scan(spark, broker_frame(spark, full, reverse_last=5))
    assert turned.distribution_risk >= 65 and turned.phase == "DISTRIBUTION"


def test_flat_price_keeps_no_trade_levels(spark):
    flat = spark.createDataFrame(
        [("AAA", d, 78.0, 78.0, 78.0, 78.0, 1000.0) for d in days(100)],
        "ticker string, date date, open double, high double, low double, close double, volume double",
    )
    row = price.add_structure(B.bar_profile(flat)).collect()[0]
    assert not row.execution_geometry_valid and row.entry_low is None and row.smc_execution_score <= 25
    assert row.ema20 == 78.0 and row.ema50 == 78.0


@pytest.mark.parametrize("n,at,ago,recent", [(100, 80, 19, True), (130, 50, 79, False)])
def test_split_recency(spark, n, at, ago, recent):
    prices = [100.0] * at + [50.0] * (n - at)
    row = price.add_quality(B.bar_profile(bar_frame(spark, prices, opens=prices))).collect()[0]
    assert row.split_like_event_detected and row.split_like_bars_ago == ago
    assert row.split_like_event_recent is recent and row.split_like_factor == 0.5


def test_one_source_per_ticker_day(spark):
    d = dt.date(2026, 8, 14)
    rows = [("A", d, "X1", "S1", True), ("A", d, "X2", "S1", True), ("A", d, "X1", "S2", False), ("B", d, "X1", "S2", False)]
    df = spark.createDataFrame(rows, "ticker string, trade_date date, broker_code string, source string, source_verified boolean")
    picked = {(r.ticker, r.source) for r in evidence.select_broker_evidence(df).collect()}
    assert picked == {("A", "S1"), ("B", "S2")}
