"""The query catalogue: every operator over the whole tables, with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook import config as C
from tidebook.functions.frames import one_row, staged, staged_together
from tidebook.functions.scalars import moment
from tidebook.operators import bars as B
from tidebook.operators import broker as K
from tidebook.operators import caches, constraints, evidence, foreign, funnel, normalize, outcomes, planning, price, runs
from tidebook.operators import participants as P
from tidebook.operators import scan as S
from tidebook.plans.oracle_views import even
from tidebook.plans.shape import oracle_query, shaped
from tidebook.sources import files, payloads
from tidebook.sources import sinks
from tidebook.sources import tables as T
from tidebook.streaming import trades as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

NOW = "2024-01-20 12:00:00"
AS_OF = "2001-06-30"


def query(spec: str, oracle: str | None = None):
    """Registers a query under its function name; ``oracle`` is the SQL body to compare with."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, root: str) -> DataFrame:
            return shaped(fn(spark, root), spec)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLE[fn.__name__] = oracle_query(oracle, spec)
        return fn

    return register


# ---- participant flow ----------------------------------------------------------------

FLOW = "ticker trade_date participant buy_volume:4 buy_value:4 sell_volume:4 sell_value:4 net_volume:4 net_value:4 buy_avg:6 sell_avg:6"


def _raw_trades(spark: SparkSession, root: str) -> DataFrame:
    """Trades under the header of a trade-detail file."""
    return T.trades(spark, root).select(
        F.col("trade_date").cast("string").alias("TradingDate"),
        F.concat(F.lit(" "), F.lower("ticker"), F.lit(".JK ")).alias("Asset"),
        F.col("participant_buy").alias("Participant_Buy"),
        F.col("participant_sell").alias("Participant_Sell"),
        F.col("volume").cast("string").alias("Volume"),
        F.col("value").cast("string").alias("Value"),
    )


def _flow(spark: SparkSession, root: str) -> DataFrame:
    return P.aggregate_trades(T.trades(spark, root))


@query(FLOW, "SELECT * FROM flow")
def participant_flow(spark, root):
    return _flow(spark, root)


@query(FLOW + " participant_flow_version", "SELECT *, '1.0.0' AS participant_flow_version FROM flow")
def trade_detail_flow(spark, root):
    """Raw trade-detail text rows through the full normaliser."""
    return P.aggregate_trade_detail(_raw_trades(spark, root), "2001-01-01", T.universe(spark, root))


@query(
    "ticker trade_date participant side net_value:4 flow_rank:i net_rank:i sell_rank:i buy_avg:6 sell_avg:6",
    "SELECT * FROM top10",
)
def participant_top10(spark, root):
    return P.trim_top_participants(_flow(spark, root), 10)


@query(
    "ticker trade_date participant side net_value:4 flow_rank:i",
    "SELECT * FROM top10 WHERE flow_rank <= 3",
)
def participant_top3(spark, root):
    return P.top_participants(_flow(spark, root), 3)


SCORE_SQL = f"""
SELECT *, CASE WHEN participant_accumulation_score >= 70 THEN 'PARTICIPANT_ACCUMULATION' WHEN participant_accumulation_score <= 35 THEN 'PARTICIPANT_DISTRIBUTION'
          ELSE 'PARTICIPANT_MIXED' END AS participant_accumulation_state,
       {even('0.70 * participant_accumulation_score + 0.30 * coalesce(participant_net_score, 50.0)', 1)} AS participant_smart_money_confirmation_score
FROM (SELECT *, {even('least(100, greatest(0, 0.35 * coalesce(participant_net_score, 50.0) + 0.25 * participant_top3_buyer_persistence_20d_pct + 0.20 * coalesce(participant_buyer_concentration_pct, 0) + 0.20 * participant_buy_sell_dominance_score))', 1)} AS participant_accumulation_score
FROM (SELECT m.ticker, days AS participant_flow_observed_days, latest_date AS participant_flow_latest_date, coalesce(p.participant, '') AS participant_top_buyer_code,
    coalesce(l.participant, '') AS participant_latest_top_buyer_code, 100.0 * coalesce(p.hits, 0) / days AS participant_top3_buyer_persistence_20d_pct,
    b.top_net AS participant_top_buyer_net_value_20d, 100.0 * b.top_net / positive AS participant_buyer_concentration_pct,
    least(100.0, 50.0 + 15.0 * CASE WHEN negative > 0 THEN positive / negative WHEN positive > 0 THEN 5.0 ELSE 0.0 END) AS participant_buy_sell_dominance_score,
    l.buy_avg AS participant_latest_top_buyer_buy_avg, least(100.0, 100.0 * days / 20) AS participant_flow_coverage_pct,
    CASE WHEN b.top_net IS NULL THEN NULL WHEN count(b.top_net) OVER () >= 3 THEN 100.0 * (rank() OVER (ORDER BY b.top_net) + (count(*) OVER (PARTITION BY b.top_net) - 1) / 2.0) / count(b.top_net) OVER () ELSE 50.0 END AS participant_net_score
  FROM (SELECT ticker, count(DISTINCT trade_date) AS days, max(trade_date) AS latest_date, sum(CASE WHEN net_value > 0 THEN net_value ELSE 0 END) AS positive,
               sum(CASE WHEN net_value < 0 THEN -net_value ELSE 0 END) AS negative FROM recent GROUP BY ticker) m
  LEFT JOIN (SELECT * FROM (SELECT ticker, participant, count(*) AS hits, row_number() OVER (PARTITION BY ticker ORDER BY count(*) DESC, participant) AS place
             FROM recent WHERE side = 'TOP_NET_BUYER' AND flow_rank <= 3 GROUP BY ticker, participant) WHERE place = 1) p ON p.ticker = m.ticker
  LEFT JOIN (SELECT ticker, max(net) AS top_net FROM (SELECT ticker, participant, sum(net_value) AS net FROM recent WHERE side = 'TOP_NET_BUYER' GROUP BY ticker, participant) GROUP BY ticker) b ON b.ticker = m.ticker
  LEFT JOIN (SELECT ticker, participant, buy_avg FROM recent WHERE dr = 1 AND side = 'TOP_NET_BUYER' AND flow_rank = 1) l ON l.ticker = m.ticker))""".replace(
    "FROM recent", "FROM (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY trade_date DESC) AS dr FROM top10) WHERE dr <= 20)"
)


@query(
    "ticker participant_flow_observed_days:i participant_flow_latest_date participant_top_buyer_code participant_latest_top_buyer_code"
    " participant_top3_buyer_persistence_20d_pct:6 participant_top_buyer_net_value_20d:4 participant_buyer_concentration_pct:6"
    " participant_buy_sell_dominance_score:6 participant_latest_top_buyer_buy_avg:4 participant_flow_coverage_pct:6 participant_net_score:6"
    " participant_accumulation_score:4 participant_smart_money_confirmation_score:4 participant_accumulation_state",
    SCORE_SQL,
)
def participant_scores(spark, root):
    history = staged(P.top_participants(_flow(spark, root), 10), "participant-history")
    return P.score_participant_history(history, T.universe(spark, root))


@query(
    "ticker trade_date broker_code market_type buy_value:4 sell_value:4 buy_volume:4 sell_volume:4 buy_avg:6 sell_avg:6 source source_verified provenance_state",
    f"""SELECT ticker, trade_date, participant AS broker_code, 'RG' AS market_type, buy_value, sell_value, buy_volume, sell_volume, buy_avg, sell_avg,
        '{C.TRADE_DETAIL_FLOW}' AS source, TRUE AS source_verified, '{C.TRADE_DETAIL_STATE}' AS provenance_state FROM flow""",
)
def participant_broker_rows(spark, root):
    return P.participant_to_broker(_flow(spark, root))


@query(
    "ticker trade_date broker_code source buy_value:4 sell_value:4",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, trade_date, broker_code ORDER BY pr DESC) AS place FROM (
          SELECT ticker, trade_date, broker_code, '{C.OFFICIAL_BROKER_SUMMARY}' AS source, sum(buy_value) AS buy_value, sum(sell_value) AS sell_value, 1 AS pr FROM broker WHERE source = 'DIRECT' GROUP BY ALL
          UNION ALL SELECT ticker, trade_date, participant, '{C.TRADE_DETAIL_FLOW}', buy_value, sell_value, 0 FROM flow)) WHERE place = 1""",
)
def broker_merge_priority(spark, root):
    keys = ["ticker", "trade_date", "broker_code"]
    direct = T.broker_flows(spark, root).where(F.col("source") == "DIRECT").groupBy(*keys).agg(
        F.sum("buy_value").alias("buy_value"), F.sum("sell_value").alias("sell_value")
    )
    direct = direct.withColumn("source", F.lit(C.OFFICIAL_BROKER_SUMMARY))
    public = P.participant_to_broker(_flow(spark, root)).select(*keys, "buy_value", "sell_value", "source")
    return P.merge_prefer_direct(direct, public)


# ---- evidence selection --------------------------------------------------------------

CHOICE_SQL = """
SELECT ticker, trade_date, source, verified_pct, brokers FROM (SELECT *, row_number() OVER (PARTITION BY ticker, trade_date ORDER BY verified_pct DESC, CASE source WHEN 'DIRECT' THEN 40 WHEN 'VENDOR' THEN 30 ELSE 0 END DESC, brokers DESC, source DESC) AS place
  FROM (SELECT ticker, trade_date, source, 100.0 * avg(CASE WHEN source_verified THEN 1 ELSE 0 END) AS verified_pct, count(DISTINCT broker_code) AS brokers FROM broker GROUP BY ALL)) WHERE place = 1"""
VIEW_PRIORITY = {"DIRECT": 40, "VENDOR": 30}


@query("ticker trade_date source verified_pct:6 brokers:i", CHOICE_SQL)
def broker_source_choice(spark, root):
    return evidence.broker_source_choice(T.broker_flows(spark, root), VIEW_PRIORITY)


@query(
    "ticker trade_date broker_code source source_verified buy_value:4 sell_value:4",
    f"SELECT b.* FROM broker b JOIN ({CHOICE_SQL}) c ON c.ticker = b.ticker AND c.trade_date = b.trade_date AND c.source = b.source",
)
def broker_source_select(spark, root):
    return evidence.select_broker_evidence(staged(T.broker_flows(spark, root), "broker"), VIEW_PRIORITY)


@query("source ticker_days:i", f"SELECT source, count(*) AS ticker_days FROM ({CHOICE_SQL}) GROUP BY source")
def broker_source_counts(spark, root):
    return evidence.source_day_counts(evidence.broker_source_choice(T.broker_flows(spark, root), VIEW_PRIORITY))


@query("ticker source coverage_pct:6", "SELECT * FROM foreign_choice")
def foreign_source_choice(spark, root):
    return evidence.foreign_source_choice(T.universe(spark, root), T.foreign_flows(spark, root), T.bars(spark, root))


@query(
    "ticker trade_date foreign_evidence_source flow_unit foreign_buy:4 foreign_sell:4 volume:4",
    "SELECT *, source AS foreign_evidence_source, 'SHARES' AS flow_unit FROM foreign_evidence",
)
def foreign_source_select(spark, root):
    return evidence.prepare_foreign_evidence(T.universe(spark, root), T.foreign_flows(spark, root), T.bars(spark, root))


@query(
    "official_selected_tickers:i vendor_selected_tickers:i other_selected_tickers:i foreign_unavailable_tickers:i median_selected_coverage_pct:6",
    """SELECT count(CASE WHEN source = 'IDX_OFFICIAL_STOCK_SUMMARY' THEN 1 END) AS official_selected_tickers, count(CASE WHEN source = 'ZAPI_IDX_FOREIGN_FLOW' THEN 1 END) AS vendor_selected_tickers,
       0 AS other_selected_tickers, count(CASE WHEN source IS NULL THEN 1 END) AS foreign_unavailable_tickers, median(coverage_pct) AS median_selected_coverage_pct FROM foreign_choice""",
)
def foreign_source_stats(spark, root):
    return evidence.foreign_choice_stats(foreign_source_choice(spark, root))


@query(
    "ticker trade_date source foreign_net:4",
    """SELECT f.* FROM foreign_flows f JOIN (
         SELECT u.ticker, CASE WHEN bool_or(f.source = 'ZAPI_IDX_FOREIGN_FLOW') THEN 'ZAPI_IDX_FOREIGN_FLOW' ELSE 'IDX_OFFICIAL_STOCK_SUMMARY' END AS source
         FROM universe u JOIN foreign_flows f ON f.ticker = u.ticker JOIN pos p ON p.ticker = f.ticker AND p.date = f.trade_date AND p.rn <= 20 GROUP BY u.ticker) c
       ON c.ticker = f.ticker AND c.source = f.source""",
)
def foreign_vendor_first(spark, root):
    flows = T.foreign_flows(spark, root)
    vendor = flows.where(F.col("source") == C.VENDOR_FOREIGN_FLOW)
    official = flows.where(F.col("source") == C.OFFICIAL_STOCK_SUMMARY)
    return evidence.vendor_first_foreign(T.universe(spark, root), vendor, official, T.bars(spark, root))


def _evidence(spark: SparkSession, root: str) -> DataFrame:
    return evidence.prepare_foreign_evidence(T.universe(spark, root), T.foreign_flows(spark, root), T.bars(spark, root))


@query(
    "ticker foreign_institutional_score:6 foreign_evidence_coverage_pct:6 official_foreign_coverage_pct:6 foreign_evidence_source foreign_net_5d:4"
    " foreign_net_20d:4 foreign_persistence_20d:6 foreign_intensity_20d:6",
    "SELECT * FROM foreign_features",
)
def foreign_features(spark, root):
    return foreign.compute_foreign_features(staged(_evidence(spark, root), "foreign"), B.bar_profile(T.bars(spark, root)))


@query(
    "ticker trade_date source market_type foreign_buy:4 foreign_sell:4 foreign_net:4 volume:4 flow_unit source_verified provenance_state",
    f"""SELECT *, 'ALL' AS market_type, 'SHARES' AS flow_unit, TRUE AS source_verified, '{C.VENDOR_FOREIGN_STATE}' AS provenance_state
        FROM foreign_flows WHERE source = '{C.VENDOR_FOREIGN_FLOW}'""",
)
def vendor_foreign_normalize(spark, root):
    """Every vendor row arrives twice, first with a wrong net; the later one stays and its net is recomputed."""
    flows = T.foreign_flows(spark, root)
    early = flows.withColumns({"foreign_net": F.lit(-1.0), "arrived": F.lit(1), "volume": F.col("volume") * 2})
    return normalize.normalize_vendor_foreign(early.unionByName(flows.withColumn("arrived", F.lit(2))), "arrived")


# ---- broker model --------------------------------------------------------------------

BROKER_SPEC = (
    "ticker broker_days:i distinct_brokers:i coverage_pct:6 accumulation_score:6 accumulation_quality_score:6 operator_dominance_score:6"
    " supply_concentration_score:6 estimated_smart_money_cost:4 premium_to_cost_pct:6 cost_basis_score:4 cost_position distribution_risk:6"
    " top_accumulating_brokers top_distributing_brokers net_value_5d:2 net_value_20d:2 net_value_60d:2 persistence_5d:6 persistence_20d:6 persistence_60d:6"
    " broker_cohort_stability:6 broker_hhi:6 net_conversion_ratio:6 reversal_ratio_5d:6 broker_balance_error_pct:6 broker_verified_source_pct:6"
)


@query(BROKER_SPEC, "SELECT * FROM broker_f")
def broker_features(spark, root):
    out = K.compute_broker_features(staged(T.broker_flows(spark, root), "broker"), B.bar_profile(T.bars(spark, root)))
    names = ("top_accumulating_brokers", "top_distributing_brokers")
    return out.withColumns({n: F.array_join(n, ",") for n in names})


WINDOW_SQL = """
SELECT ticker, broker_code, sum(CASE WHEN dr <= 5 THEN net_value ELSE 0 END) AS net_5, sum(CASE WHEN dr <= 20 THEN net_value ELSE 0 END) AS net_20,
       sum(CASE WHEN dr <= 60 THEN net_value ELSE 0 END) AS net_60, sum(CASE WHEN dr <= 20 THEN buy_value ELSE 0 END) AS buy_20,
       sum(CASE WHEN dr <= 20 THEN sell_value ELSE 0 END) AS sell_20, count(DISTINCT CASE WHEN dr <= 20 THEN trade_date END) AS days_20
FROM (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY trade_date DESC) AS dr FROM broker) GROUP BY ticker, broker_code"""


@query("ticker broker_code net_5:4 net_20:4 net_60:4 buy_20:4 sell_20:4 days_20:i", WINDOW_SQL)
def broker_windows(spark, root):
    return K.broker_windows(T.broker_flows(spark, root))


@query(
    "ticker broker_code buyer_rank_20:i seller_rank_20:i in_20",
    f"""SELECT *, CASE WHEN net_20 > 0 THEN row_number() OVER (PARTITION BY ticker ORDER BY CASE WHEN net_20 > 0 THEN net_20 END DESC NULLS LAST, broker_code) END AS buyer_rank_20,
        CASE WHEN net_20 < 0 THEN row_number() OVER (PARTITION BY ticker ORDER BY CASE WHEN net_20 < 0 THEN net_20 END NULLS LAST, broker_code) END AS seller_rank_20,
        coalesce(buyer_rank_20 <= 5, FALSE) AS in_20 FROM ({WINDOW_SQL})""",
)
def broker_cohort(spark, root):
    return K.broker_cohort(K.broker_windows(T.broker_flows(spark, root)))


@query(
    "ticker verified_source_pct:6 verified_row_pct:6",
    """SELECT ticker, CASE WHEN ticker LIKE '%3' OR ticker LIKE '%4' THEN 0 ELSE 100.0 * sum(CASE WHEN source_verified THEN gross_value ELSE 0 END) / sum(gross_value) END AS verified_source_pct,
       CASE WHEN ticker LIKE '%3' THEN 0 ELSE 100.0 * avg(CASE WHEN source_verified THEN 1.0 ELSE 0.0 END) END AS verified_row_pct FROM broker GROUP BY ticker""",
)
def broker_verified_pct(spark, root):
    """Some tickers have no verified row, some no amounts at all."""
    none, empty = F.col("ticker").like("%3"), F.col("ticker").like("%4")
    rows = T.broker_flows(spark, root).withColumn("source_verified", F.col("source_verified") & ~none)
    return K.verified_source_pct(rows.withColumns({c: F.when(~empty, F.col(c)) for c in ("buy_value", "sell_value")}))


@query(
    "ticker broker_days:i broker_ready",
    "SELECT u.ticker, count(DISTINCT b.trade_date) AS broker_days, count(DISTINCT b.trade_date) >= 1300 AS broker_ready FROM universe u LEFT JOIN broker b ON b.ticker = u.ticker GROUP BY u.ticker",
)
def broker_coverage(spark, root):
    return K.broker_database_coverage(T.universe(spark, root), T.broker_flows(spark, root), 1300)


@query(
    "rows:i tickers:i days:i verified_tickers:i freshest",
    """SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, count(DISTINCT trade_date) AS days, count(DISTINCT CASE WHEN source_verified THEN ticker END) AS verified_tickers,
       max(trade_date) AS freshest FROM broker""",
)
def data_stats(spark, root):
    return evidence.data_stats(T.broker_flows(spark, root))


def _lenient(spark: SparkSession, root: str) -> DataFrame:
    """Broker rows under untidy headers and texts."""
    b = T.broker_flows(spark, root)
    return b.select(
        F.concat(F.lit(" "), F.lower("ticker"), F.lit(".jk")).alias(" Ticker "),
        F.col("trade_date").cast("string").alias("Trade_Date"),
        F.lower("broker_code").alias("BROKER_CODE"),
        *[F.col(c).cast("string").alias(c.upper()) for c in normalize.BROKER_NUMBERS[:4]],
        F.lit("n/a").alias("Buy_Avg"),
        F.col("sell_avg").cast("string").alias("Sell_Avg"),
        "source",
    )


@query(
    "ticker trade_date broker_code source market_type buy_value:4 sell_value:4 net_value:4 net_volume:4 gross_value:4 buy_avg:4 sell_avg:6",
    "SELECT ticker, trade_date, broker_code, source, 'REGULAR' AS market_type, buy_value, sell_value, net_value, net_volume, gross_value, CAST(NULL AS DOUBLE) AS buy_avg, sell_avg FROM broker",
)
def broker_normalize(spark, root):
    return normalize.normalize_broker_summary(_lenient(spark, root))


# ---- bars and price features ---------------------------------------------------------

BAR_SPEC = "ticker date open:4 high:4 low:4 close:4 volume:4 traded_value:4"


@query(BAR_SPEC, "SELECT * FROM bars")
def bars_daily(spark, root):
    return T.bars(spark, root)


@query("ticker date open:4 high:4 low:4 close:4 volume:4", "SELECT * FROM bars")
def price_normalize(spark, root):
    """Raw bars under provider headers, an early wrong copy of each day and rows without a date."""
    raw = T.bars(spark, root).select(
        F.concat(F.lower("ticker"), F.lit(".JK")).alias("Ticker"),
        F.date_format("date", "yyyy-MM-dd'T'07:00:00'Z'").alias("Timestamp"),
        *[F.col(c).cast("string").alias(c.title()) for c in ("open", "high", "low", "close", "volume")],
        (F.col("close") / 2).alias("Adj Close"),
        F.lit(2).alias("arrived"),
    )
    early = raw.withColumns({"Close": F.lit("1"), "arrived": F.lit(1)})
    bad = raw.withColumns({"Timestamp": F.lit("not a day"), "arrived": F.lit(3)})
    return normalize.normalize_price_frame(raw.unionByName(early).unionByName(bad), "arrived")


@query(
    "ticker trade_date open:4 high:4 low:4 close:4 volume:4",
    "SELECT *, date AS trade_date FROM pos WHERE rn <= 120",
)
def bars_last_n(spark, root):
    return B.price_cache(T.daily_prices(spark, root), 120, T.universe(spark, root))


@query(
    "ticker trade_date place:i open:4 high:4 low:4 close:4 volume:4",
    """SELECT ticker, date AS trade_date, count(*) OVER (PARTITION BY ticker) - rn AS place, open, high, low, close, volume FROM pos WHERE rn <= 1000""",
)
def bars_nested(spark, root):
    nested = B.bars_nested(T.daily_prices(spark, root), 1000, T.universe(spark, root))
    return nested.select("ticker", F.posexplode("payload").alias("place", "b")).select(
        "ticker", "place", *[f"b.{c}" for c in ("trade_date", "open", "high", "low", "close", "volume")]
    )


@query(
    "ticker trade_date place:i open:4 high:4 low:4 close:4 volume:4",
    "SELECT ticker, strftime(date, '%Y-%m-%d') AS trade_date, least(450, count(*) OVER (PARTITION BY ticker)) - rn AS place, open, high, low, close, volume FROM pos WHERE rn <= 450",
)
def bars_json(spark, root):
    texts = B.bars_json(T.daily_prices(spark, root), 450, T.universe(spark, root))
    fields = ("ticker", "trade_date", "open", "high", "low", "close", "volume")
    kind = ", ".join(f"{c} {'string' if c in ('ticker', 'trade_date') else 'double'}" for c in fields)
    read = texts.select(F.posexplode(F.from_json("payload", f"array<struct<{kind}>>")).alias("place", "b"))
    return read.select("place", *[f"b.{c}" for c in fields])


PRICE_FLOW_SPEC = "ticker " + " ".join(
    f"{c}:{2 if c == 'avg_traded_value_20d' else 6}" for c in price.PRICE_FLOW_COLUMNS
)


@query(PRICE_FLOW_SPEC, "SELECT * FROM price_flow")
def price_flow_features(spark, root):
    return price.add_price_flow(B.bar_profile(T.bars(spark, root)))


@query(
    "ticker smc_execution_score:6 bos choch liquidity_sweep fvg_low:4 fvg_high:4 entry_low:4 entry_high:4 invalidation:4 tp1:4 tp2:4 ema20:4 ema50:4 execution_geometry_valid",
    "SELECT * FROM structure",
)
def smc_levels(spark, root):
    return price.add_structure(B.bar_profile(T.bars(spark, root)))


QUALITY_SPEC = (
    "ticker price_data_quality_score:6 price_staleness_days:i zero_volume_ratio_20d:6 unchanged_close_ratio_20d:6 ohlc_geometry_error_ratio:6"
    " split_like_event_detected split_like_event_recent split_like_event_date split_like_factor:6 split_like_bars_ago:i"
)


def _quality(spark: SparkSession, root: str, rough: bool) -> DataFrame:
    bars = T.bars(spark, root, rough)
    newest = bars.agg(F.max("date").alias("d"))
    return price.add_quality(B.bar_profile(bars).withColumn("_ref", newest.scalar()), "_ref")


@query(QUALITY_SPEC, "SELECT * FROM quality")
def price_quality(spark, root):
    return _quality(spark, root, False)


@query(QUALITY_SPEC, "SELECT * FROM quality_rough")
def split_events(spark, root):
    return _quality(spark, root, True)


@query(
    "market_regime_score:6 market_regime_label breadth_20d:6 breadth_60d:6 median_return_20d:6 median_return_60d:6 reference_date coverage_count:i",
    "SELECT * FROM context",
)
def market_context(spark, root):
    return price.market_context(B.bar_profile(T.bars(spark, root)))


@query(
    "ticker market_sector_score:6 market_regime_score:6 market_regime_label market_breadth_20d:6 market_breadth_60d:6 universe_median_return_20d:6"
    " universe_median_return_60d:6 relative_strength_20d_pct:6 relative_strength_60d_pct:6 market_context_coverage:i market_reference_date",
    "SELECT * FROM market",
)
def relative_strength(spark, root):
    bars = T.bars(spark, root)
    return price.add_market(B.bar_profile(bars), one_row(price.market_context(B.bar_profile(bars))))


# ---- scan and funnel -----------------------------------------------------------------

RESULT_SPEC = (
    "ticker as_of_date score:6 phase action evidence_tier evidence_coverage_pct:2 accumulation_score:2 operator_dominance_score:2 cost_basis_score:2"
    " retail_exhaustion_score:2 foreign_institutional_score:2 supply_concentration_score:2 price_flow_divergence_score:2 market_context_score:2"
    " smc_execution_score:2 risk_liquidity_score:2 price_data_quality_score:2 distribution_risk:2 estimated_smart_money_cost:3 premium_to_cost_pct:2"
    " entry_low:2 entry_high:2 invalidation:2 tp1:2 tp2:2 real_money_state guardrail_reason"
)


def _result_sql(scan: str) -> str:
    return f"""SELECT ticker, last_date AS as_of_date, score, phase, action, evidence_tier, coverage_pct AS evidence_coverage_pct, eff_acc AS accumulation_score,
      eff_dom AS operator_dominance_score, eff_cost AS cost_basis_score, retail_exhaustion_score, {even('foreign_institutional_score', 2)} AS foreign_institutional_score,
      eff_sup AS supply_concentration_score, price_flow_divergence_score, market_sector_score AS market_context_score, smc_execution_score, risk_liquidity_score,
      price_data_quality_score, eff_dist AS distribution_risk, CASE WHEN direct THEN {even('estimated_smart_money_cost', 4)} END AS estimated_smart_money_cost,
      CASE WHEN direct THEN premium_to_cost_pct END AS premium_to_cost_pct, entry_low, entry_high, invalidation, tp1, tp2, real_money_state, guardrail_reason FROM {scan}"""


def _scan(spark: SparkSession, root: str, broker: str | None) -> DataFrame:
    """The bars, read by the evidence choice and by the scan, are stored once, as a job would; so are
    the sums that broker rows and foreign flow are both made of."""
    legs, bars = staged_together({"legs": T.trade_legs(spark, root), "bars": T.bars(spark, root)})
    rows = None if broker is None else T.broker_flows(spark, root, all_verified=broker == "verified", legs=legs)
    names = T.universe(spark, root)
    flow = evidence.prepare_foreign_evidence(names, staged(T.foreign_flows(spark, root, legs), "foreign"), bars)
    return S.scan_universe(names, bars, rows, flow)


@query(RESULT_SPEC, _result_sql("scan_full"))
def scan_verified_broker(spark, root):
    """Scan with fully verified broker rows, so that direct evidence counts."""
    return _scan(spark, root, "verified")


@query(RESULT_SPEC, _result_sql("scan_part"))
def scan_partly_verified(spark, root):
    """Scan whose broker rows fail the verification gate and must not count."""
    return _scan(spark, root, "part")


@query(RESULT_SPEC, _result_sql("scan_proxy"))
def scan_proxy_only(spark, root):
    return _scan(spark, root, None)


@query("ticker direct_broker", "SELECT ticker, direct AS direct_broker FROM scan_full")
def direct_gate(spark, root):
    return _scan(spark, root, "verified").select("ticker", F.col("diagnostics.broker_alpha_applied").alias("direct_broker"))


@query(
    "ticker error",
    "SELECT u.ticker, u.ticker || ': insufficient price history (' || count(b.date) || ' bars)' AS error FROM universe u LEFT JOIN bars b ON b.ticker = u.ticker GROUP BY u.ticker HAVING count(b.date) < 1400",
)
def scan_errors(spark, root):
    return S.scan_errors(T.universe(spark, root), T.bars(spark, root), C.ScanConfig(minimum_price_bars=1400))


def _funnel(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First pass, finalists and verified finalists; shared inputs are stored once, as a job would."""
    legs, bars = staged_together({"legs": T.trade_legs(spark, root), "bars": T.bars(spark, root)})
    flow, names = staged(T.foreign_flows(spark, root, legs), "foreign"), T.universe(spark, root)
    flow = staged(evidence.prepare_foreign_evidence(names, flow, bars), "evidence")
    first = S.scan_universe(names, bars, None, flow)
    finalists = staged(funnel.select_guarded_top5(first), "finalists")
    second = funnel.verify_guarded_top5(finalists, bars, T.broker_flows(spark, root, all_verified=True, legs=legs), flow)
    return first, finalists, second


@query("ticker guarded_rank:i guarded_score:2 evidence_tier phase", "SELECT * FROM finalists")
def finalists_top5(spark, root):
    return funnel.select_guarded_top5(_scan(spark, root, None))


@query(
    "ticker guarded_rank:i broker_rank:i broker_verification_status score:6 phase action evidence_tier real_money_state guardrail_reason",
    "SELECT * FROM verified",
)
def finalists_verified(spark, root):
    return _funnel(spark, root)[2]


MERGED_SPEC = "ticker score:6 phase action evidence_tier real_money_state guardrail_reason estimated_smart_money_cost:3 premium_to_cost_pct:2 distribution_risk:2"


@query(
    MERGED_SPEC,
    f"SELECT * REPLACE ({even('estimated_smart_money_cost', 4)} AS estimated_smart_money_cost) FROM merged",
)
def finalists_merged(spark, root):
    first, _, second = _funnel(spark, root)
    return funnel.merge_verified_finalists(first, second)


@query(
    "ticker guarded_rank:i guarded_score:2 broker_verification_status broker_rank:i",
    "SELECT * FROM merged WHERE guarded_rank IS NOT NULL",
)
def funnel_views(spark, root):
    first, _, second = _funnel(spark, root)
    return funnel.recover_funnel_views(funnel.merge_verified_finalists(first, second))[1]


@query(
    "ticker evidence_tier bandar_price_est:3 bandar_vs_price_pct:2 bandar_cost_position broker_verification_status",
    f"""SELECT ticker, evidence_tier, {even('estimated_smart_money_cost', 4)} AS bandar_price_est, premium_to_cost_pct AS bandar_vs_price_pct,
        CASE WHEN evidence_tier = 'BROKER_DIRECT' THEN cost_position ELSE 'UNVERIFIED' END AS bandar_cost_position, broker_verification_status FROM merged""",
)
def results_decorated(spark, root):
    first, _, second = _funnel(spark, root)
    return funnel.decorate(funnel.merge_verified_finalists(first, second))


@query(
    "ticker broker_rank:i score:6",
    "SELECT * FROM verified WHERE broker_verification_status = 'BROKER_VERIFIED' AND evidence_tier = 'BROKER_DIRECT' AND real_money_state = 'ELIGIBLE'",
)
def production_lane(spark, root):
    return funnel.production_lane(_funnel(spark, root)[2])


@query(
    "ticker final_score:2 accumulation_score:2 smc_execution_score:2 price_data_quality_score:2 run_id",
    "SELECT ticker, score AS final_score, eff_acc AS accumulation_score, smc_execution_score, price_data_quality_score, 'R1' AS run_id FROM scan_proxy",
)
def persisted_results(spark, root):
    stored = runs.result_records(_scan(spark, root, None), "R1")
    return runs.persisted_results(stored, "R1")


# ---- outcomes ------------------------------------------------------------------------

OUTCOME_SPEC = (
    "run_id ticker as_of_date entry_close:4 return_5d:6 return_20d:6 return_60d:6 mfe_20d:6 mae_20d:6 evaluated_through evaluation_status evaluation_note"
)


@query(OUTCOME_SPEC, "SELECT * FROM outcomes")
def outcomes_forward(spark, root):
    bars = T.bars(spark, root)
    return outcomes.compute_signal_outcomes(T.signals(spark, root), bars)


@query(OUTCOME_SPEC, "SELECT * FROM outcomes_rough")
def outcomes_excluded(spark, root):
    bars = T.bars(spark, root, rough=True)
    return outcomes.compute_signal_outcomes(T.signals(spark, root, rough=True), bars)


def _stored_outcomes(spark: SparkSession, root: str, rough: bool = False) -> DataFrame:
    """Signals as stored rows: most open, some closed, some on a day without a bar."""
    number = F.substring("run_id", 2, 9).cast("int")
    return T.signals(spark, root, rough).select(
        "run_id",
        "ticker",
        F.when(number % 5 == 0, F.date_add("as_of_date", 4000)).otherwise(F.col("as_of_date")).alias("as_of_date"),
        F.when(number % 3 == 0, F.lit("COMPLETE")).otherwise(F.lit("PENDING")).alias("evaluation_status"),
        F.lit(None).cast("date").alias("evaluated_through"),
    )


@query(
    OUTCOME_SPEC + " stamped",
    """SELECT *, evaluation_status <> 'PENDING' AS stamped FROM outcomes WHERE CAST(substr(run_id, 2) AS INT) % 3 <> 0 AND CAST(substr(run_id, 2) AS INT) % 5 <> 0""",
)
def outcome_updates(spark, root):
    now = F.lit(NOW).cast("timestamp_ntz")
    updates = outcomes.refresh_signal_outcomes(_stored_outcomes(spark, root), T.daily_prices(spark, root), now)
    return updates.withColumn("stamped", F.col("evaluated_at").isNotNull())


@query(
    "checked:i updated:i complete:i excluded:i",
    """SELECT (SELECT count(*) FROM signals WHERE CAST(substr(run_id, 2) AS INT) % 3 <> 0) AS checked, count(*) AS updated, count(CASE WHEN evaluation_status = 'COMPLETE' THEN 1 END) AS complete, count(CASE WHEN evaluation_status = 'EXCLUDED' THEN 1 END) AS excluded
       FROM outcomes WHERE CAST(substr(run_id, 2) AS INT) % 3 <> 0 AND CAST(substr(run_id, 2) AS INT) % 5 <> 0""",
)
def outcome_refresh_stats(spark, root):
    stored, universe = _stored_outcomes(spark, root), T.universe(spark, root)
    updates = outcomes.refresh_pending(stored, universe, T.daily_prices(spark, root))
    return outcomes.refresh_stats(updates, outcomes.pending_rows(stored, universe))


@query(
    "run_id ticker as_of_date phase evidence_tier final_score:2 entry_close:4 evaluated_through evaluation_status",
    """SELECT 'R9' AS run_id, s.ticker, s.last_date AS as_of_date, s.phase, s.evidence_tier, s.score AS final_score, b.close AS entry_close, b.date AS evaluated_through, 'PENDING' AS evaluation_status
       FROM scan_proxy s JOIN bars b ON b.ticker = s.ticker AND b.date = s.last_date""",
)
def outcome_seed(spark, root):
    return outcomes.seed_signal_outcomes(_scan(spark, root, None), "R9", T.bars(spark, root))


# ---- constraints and cache sync ------------------------------------------------------

BOOK_URL = "https://data.example.org/day"
# Every participant's row; on every third day of a month buyers report half as much again.
BOOK_ROWS = f"""SELECT * REPLACE (CASE WHEN day(trade_date) % 3 = 0 THEN buy_value * 1.5 ELSE buy_value END AS buy_value), participant AS broker_code,
  'RG' AS market_type, '{C.VENDOR_EXACT_DAY}' AS source FROM flow"""
BOOK_SQL = """SELECT ticker, trade_date, count(DISTINCT broker_code) AS brokers, sum(buy_value) AS buy_value, sum(sell_value) AS sell_value,
  100 * abs(sum(buy_value) - sum(sell_value)) / greatest((sum(buy_value) + sum(sell_value)) / 2, 1) AS balance_error_pct"""


def _book(spark: SparkSession, root: str) -> DataFrame:
    """All broker rows: on every third day the book does not close, three brokers lack provenance."""
    code = F.col("broker_code")
    return _flow(spark, root).withColumnRenamed("participant", "broker_code").withColumns(
        {
            "buy_value": F.when(F.dayofmonth("trade_date") % 3 == 0, F.col("buy_value") * 1.5).otherwise(F.col("buy_value")),
            "market_type": F.lit("RG"),
            "source": F.lit(C.VENDOR_EXACT_DAY),
            "source_verified": F.lit(True),
            "source_url": F.when(code == "N4", F.lit("https://other.example.org")).when(code != "N5", F.lit(BOOK_URL)),
            "provenance_state": F.when(F.col("broker_code") == "N3", F.lit("OTHER")).otherwise(F.lit(C.EXACT_DAY_STATE)),
        }
    )


@query(
    "ticker trade_date brokers:i buy_value:4 sell_value:4 balance_error_pct:6",
    f"SELECT * FROM ({BOOK_SQL} FROM ({BOOK_ROWS}) GROUP BY ticker, trade_date) WHERE brokers < 2 OR buy_value <= 0 OR sell_value <= 0 OR balance_error_pct > 10",
)
def closed_book_violations(spark, root):
    return constraints.closed_book_violations(_book(spark, root))


@query(
    "ticker trade_date broker_code buy_value:4 sell_value:4",
    f"""SELECT t.* FROM ({BOOK_ROWS}) t JOIN (SELECT * FROM ({BOOK_SQL} FROM ({BOOK_ROWS}) GROUP BY ticker, trade_date) WHERE brokers >= 2 AND buy_value > 0 AND sell_value > 0 AND balance_error_pct <= 10) v
        ON v.ticker = t.ticker AND v.trade_date = t.trade_date""",
)
def closed_book_accepted(spark, root):
    return constraints.split_closed_book(_book(spark, root))[0]


@query("ticker trade_date broker_code", f"SELECT * FROM ({BOOK_ROWS}) WHERE broker_code IN ('N3', 'N4', 'N5')")
def provenance_violations(spark, root):
    return constraints.split_provenance(_book(spark, root), BOOK_URL)[1]


@query(
    "ticker trade_date broker_code market_type source buy_value:4 sell_value:4 buy_volume:4 sell_volume:4",
    f"""SELECT t.* FROM ({BOOK_ROWS}) t JOIN (SELECT * FROM ({BOOK_SQL} FROM ({BOOK_ROWS}) WHERE broker_code NOT IN ('N3', 'N4', 'N5') AND trade_date BETWEEN DATE '{AS_OF}' - 180 AND DATE '{AS_OF}' GROUP BY ticker, trade_date)
          WHERE brokers >= 2 AND buy_value > 0 AND sell_value > 0 AND balance_error_pct <= 10) v ON v.ticker = t.ticker AND v.trade_date = t.trade_date
        WHERE t.broker_code NOT IN ('N3', 'N4', 'N5') AND t.trade_date BETWEEN DATE '{AS_OF}' - 180 AND DATE '{AS_OF}'""",
)
def broker_cache_sync(spark, root):
    book = _book(spark, root)
    names = [f.split()[0] for f in constraints.BROKER_ROW.split(", ")]
    texts = book.select(F.to_json(F.struct(*[F.col(n) for n in names])).alias("value"))
    return constraints.sync_broker_cache(staged(texts, "broker-cache"), AS_OF, BOOK_URL)


# ---- caches and planning -------------------------------------------------------------


def _tiers(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Three tiers of different depth: recent bars only, a part of the tickers, everything."""
    bars = T.bars(spark, root)
    return {
        "cache": bars.where(F.col("date") >= "2001-07-01"),
        "seed": bars.where((F.col("date") >= "2001-01-01") & F.col("ticker").like("%1%")),
        "fresh": bars,
    }


TIER_SQL = """
SELECT u.ticker, t.tier, t.bars FROM universe u LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY place) AS pick FROM (
  SELECT ticker, 0 AS place, 'cache' AS tier, count(*) AS bars FROM bars WHERE date >= DATE '2001-07-01' GROUP BY ticker
  UNION ALL SELECT ticker, 1, 'seed', count(*) FROM bars WHERE date >= DATE '2001-01-01' AND ticker LIKE '%1%' GROUP BY ticker
  UNION ALL SELECT ticker, 2, 'fresh', count(*) FROM bars GROUP BY ticker) WHERE bars >= 80) t ON t.ticker = u.ticker AND t.pick = 1"""


@query("ticker tier bars:i", TIER_SQL)
def tier_choice(spark, root):
    return caches.tier_choice(T.universe(spark, root), _tiers(spark, root))


@query("tier tickers:i bars:i", f"SELECT coalesce(tier, 'unavailable') AS tier, count(*) AS tickers, coalesce(sum(bars), 0) AS bars FROM ({TIER_SQL}) GROUP BY 1")
def tier_stats(spark, root):
    return caches.tier_stats(caches.tier_choice(T.universe(spark, root), _tiers(spark, root)))


@query(
    "ticker date close:4 tier",
    f"""SELECT b.ticker, b.date, b.close, c.tier FROM bars b JOIN ({TIER_SQL}) c ON c.ticker = b.ticker
        WHERE (c.tier = 'cache' AND b.date >= DATE '2001-07-01') OR (c.tier = 'seed' AND b.date >= DATE '2001-01-01') OR c.tier = 'fresh'""",
)
def tier_coalesce(spark, root):
    return caches.coalesce_tiers(T.universe(spark, root), _tiers(spark, root))


@query(
    "ticker bars:i accepted latest",
    "SELECT u.ticker, count(b.date) AS bars, count(b.date) >= 1400 AS accepted, max(b.date) AS latest FROM universe u LEFT JOIN bars b ON b.ticker = u.ticker GROUP BY u.ticker",
)
def seed_gate(spark, root):
    return caches.seed_gate(T.universe(spark, root), T.bars(spark, root), 1400)


@query(
    "universe_count:i valid_tickers:i latest_trade_date valid_ratio:6 passed",
    """SELECT count(*) AS universe_count, count(CASE WHEN n >= 1400 THEN 1 END) AS valid_tickers, max(CASE WHEN n >= 1400 THEN latest END) AS latest_trade_date,
       valid_tickers / universe_count AS valid_ratio, valid_tickers / universe_count >= 0.9 AS passed FROM (SELECT u.ticker, count(b.date) AS n, max(b.date) AS latest FROM universe u LEFT JOIN bars b ON b.ticker = u.ticker GROUP BY u.ticker)""",
)
def seed_meta(spark, root):
    return caches.seed_meta(caches.seed_gate(T.universe(spark, root), T.bars(spark, root), 1400))


@query(
    "ticker trade_date participant buy_value:4",
    """SELECT ticker, trade_date, participant, CASE WHEN trade_date >= DATE '2001-06-25' THEN buy_value * 2 ELSE buy_value END AS buy_value
       FROM flow WHERE trade_date >= DATE '2001-05-16'""",
)
def cache_merge(spark, root):
    """A cache up to the end date meets corrected rows of its last days; older than 45 days drops out."""
    flow = _flow(spark, root).select("ticker", "trade_date", "participant", "buy_value")
    fresh = flow.where(F.col("trade_date") >= "2001-06-25").withColumn("buy_value", F.col("buy_value") * 2)
    return caches.merge_cache(flow, fresh, ["ticker", "trade_date", "participant"], AS_OF, 45)


@query(
    "ticker trade_date broker_code source_verified",
    "SELECT ticker, trade_date, participant AS broker_code, TRUE AS source_verified FROM flow WHERE trade_date >= DATE '2001-06-30' - 120",
)
def recent_reader(spark, root):
    rows = _flow(spark, root).withColumnRenamed("participant", "broker_code")
    return caches.load_recent(rows, T.universe(spark, root), 120, AS_OF, default_verified=True)


@query("trade_date rows:i", "SELECT trade_date, count(*) AS rows FROM flow WHERE trade_date >= DATE '2001-06-30' - 150 GROUP BY trade_date")
def retention(spark, root):
    kept = caches.prune(_flow(spark, root), AS_OF, caches.RETENTION_DAYS["broker"])
    return kept.groupBy("trade_date").agg(F.count(F.lit(1)).alias("rows"))


@query("ticker date close:4", "SELECT ticker, date, close FROM bars WHERE date >= DATE '2001-06-30' - 182")
def period_window(spark, root):
    return planning.within_period(T.bars(spark, root), "6mo", AS_OF)


@query(
    "ticker trade_date",
    """SELECT u.ticker, d.trade_date FROM universe u, (SELECT DISTINCT trade_date FROM flow ORDER BY trade_date DESC LIMIT 20) d
       WHERE NOT EXISTS (SELECT 1 FROM flow f WHERE f.ticker = u.ticker AND f.trade_date = d.trade_date AND f.participant = 'N3') ORDER BY d.trade_date DESC, u.position LIMIT 100""",
)
def missing_days(spark, root):
    """The first 100 ticker-days of the newest 20 sessions on which one participant has no row."""
    flow = _flow(spark, root)
    days = planning.candidate_trade_dates(flow, AS_OF, 20)
    return planning.missing_ticker_days(T.universe(spark, root), days, flow.where(F.col("participant") == "N3"), 100)


@query("trade_date", "SELECT DISTINCT trade_date FROM trades ORDER BY trade_date DESC LIMIT 20")
def trading_dates(spark, root):
    return planning.candidate_trade_dates(T.trades(spark, root), AS_OF, 20)


@query(
    "tickers:i universe_signature",
    "SELECT count(*) AS tickers, substr(sha256(string_agg(ticker, chr(10) ORDER BY position)), 1, 16) AS universe_signature FROM universe",
)
def universe_signature(spark, root):
    rows = T.table(spark, root, "part").select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("Ticker"), "p_partkey")
    return normalize.universe_signature(normalize.parse_universe(rows, "p_partkey"))


@query(
    "provider dataset ticker status rows_accepted:i freshness_date",
    """SELECT 'CHART' AS provider, 'OHLCV_DAILY' AS dataset, u.ticker, CASE WHEN count(b.date) >= 80 THEN 'COMPLETED' ELSE 'INSUFFICIENT' END AS status, count(b.date) AS rows_accepted,
       max(b.date) AS freshness_date FROM universe u LEFT JOIN bars b ON b.ticker = u.ticker GROUP BY u.ticker""",
)
def ingestion_audit(spark, root):
    return sinks.audit_rows(T.bars(spark, root), T.universe(spark, root), "CHART", "OHLCV_DAILY")


# ---- runs ----------------------------------------------------------------------------


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


RUN_SPEC = "id:i status error_count:i completed_at current_ticker"


@query(
    RUN_SPEC + " reaped stale_failure_reason stale_max_age_minutes",
    f"""SELECT id, CASE WHEN hit THEN 'FAILED' ELSE status END AS status, CASE WHEN hit THEN 1 ELSE error_count END AS error_count,
        CASE WHEN hit THEN TIMESTAMP '{NOW}' END AS completed_at, CASE WHEN NOT hit THEN current_ticker END AS current_ticker, hit AS reaped,
        CASE WHEN hit THEN 'SERVER_CRON_STALE_HEARTBEAT' END AS stale_failure_reason, CASE WHEN hit THEN '45' END AS stale_max_age_minutes
        FROM (SELECT *, status = 'RUNNING' AND coalesce(heartbeat_at, started_at) < TIMESTAMP '{NOW}' - INTERVAL 45 MINUTE AS hit FROM runs)""",
)
def stale_runs(spark, root):
    out = runs.reap_stale_runs(T.runs(spark, root), _now())
    return out.withColumns({n: F.col("config")[n] for n in ("stale_failure_reason", "stale_max_age_minutes")})


@query(
    "id:i status reaped",
    f"""SELECT id, CASE WHEN hit THEN 'FAILED' ELSE status END AS status, hit AS reaped FROM (SELECT *, status = 'RUNNING' AND coalesce(heartbeat_at, started_at) < TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE AS hit FROM runs)""",
)
def stale_managed_runs(spark, root):
    return runs.mark_stale_managed_runs(T.runs(spark, root), _now(), 30)


@query(
    "id:i status completed_at current_ticker superseded",
    f"""SELECT r.id, CASE WHEN hit THEN 'FAILED' ELSE r.status END AS status, CASE WHEN hit THEN TIMESTAMP '{NOW}' END AS completed_at,
        CASE WHEN NOT hit THEN current_ticker END AS current_ticker, hit AS superseded
        FROM (SELECT r.*, coalesce(k.place > 1, FALSE) AS hit FROM runs r LEFT JOIN (
          SELECT id, row_number() OVER (PARTITION BY universe_signature ORDER BY heartbeat_at DESC NULLS LAST, started_at DESC, id DESC) AS place
          FROM runs WHERE status = 'RUNNING' AND universe_signature <> '') k ON k.id = r.id) r""",
)
def duplicate_runs(spark, root):
    return runs.resolve_duplicate_runs(T.runs(spark, root), _now())


@query(
    "id:i status repaired completed_at heartbeat_at",
    f"""SELECT id, CASE WHEN hit THEN 'FAILED' ELSE status END AS status, hit AS repaired, CASE WHEN hit THEN TIMESTAMP '{NOW}' END AS completed_at,
        CASE WHEN hit THEN coalesce(heartbeat_at, TIMESTAMP '{NOW}') ELSE heartbeat_at END AS heartbeat_at
        FROM (SELECT *, (status = 'COMPLETED' AND processed_count = 0) OR (status = 'RUNNING' AND version = '0.1.2') AS hit FROM runs)""",
)
def repaired_runs(spark, root):
    return runs.repair_run_states(T.runs(spark, root), _now())


@query(
    "id:i started_at", "SELECT id, started_at FROM runs ORDER BY started_at DESC, id DESC LIMIT 20"
)
def recent_runs(spark, root):
    return runs.recent_runs(T.runs(spark, root))


def _telemetry_results(spark: SparkSession, root: str) -> DataFrame:
    """Signals as stored results with an evidence source by run number."""
    number = F.substring("run_id", 2, 9).cast("int")
    return T.signals(spark, root).select(
        "run_id",
        "ticker",
        "as_of_date",
        F.when(number % 2 == 0, F.lit(C.OFFICIAL_STOCK_SUMMARY)).otherwise(F.lit(C.VENDOR_FOREIGN_FLOW)).alias("foreign_evidence_source"),
        F.when(F.col("ticker").like("%2%"), F.lit(0.0)).otherwise(F.lit(85.0)).alias("foreign_evidence_coverage_pct"),
    )


TELEMETRY_SQL = """SELECT s.run_id, count(DISTINCT CASE WHEN s.ticker NOT LIKE '%2%' THEN s.ticker END) AS foreign_evidence_tickers, max(d.days) AS foreign_evidence_days,
       CASE WHEN CAST(substr(s.run_id, 2) AS INT) % 2 = 0 THEN nullif(count(DISTINCT CASE WHEN s.ticker NOT LIKE '%2%' THEN s.ticker END), 0) END AS official,
       CASE WHEN CAST(substr(s.run_id, 2) AS INT) % 2 = 1 THEN nullif(count(DISTINCT CASE WHEN s.ticker NOT LIKE '%2%' THEN s.ticker END), 0) END AS vendor
       FROM signals s LEFT JOIN (
         SELECT x.run_id, count(DISTINCT f.trade_date) AS days FROM signals x JOIN (SELECT run_id, max(as_of_date) AS as_of FROM signals GROUP BY run_id) m ON m.run_id = x.run_id
         JOIN foreign_flows f ON f.ticker = x.ticker AND f.trade_date BETWEEN m.as_of - 45 AND m.as_of GROUP BY x.run_id) d ON d.run_id = s.run_id GROUP BY s.run_id"""


@query("run_id foreign_evidence_tickers:i foreign_evidence_days:i official:i vendor:i", TELEMETRY_SQL)
def evidence_telemetry(spark, root):
    flows = T.foreign_flows(spark, root)
    out = runs.evidence_telemetry(
        _telemetry_results(spark, root),
        flows.where(F.col("source") == C.VENDOR_FOREIGN_FLOW),
        flows.where(F.col("source") == C.OFFICIAL_STOCK_SUMMARY),
    )
    sources = F.col("foreign_evidence_sources")
    return out.withColumns({"official": sources[C.OFFICIAL_STOCK_SUMMARY], "vendor": sources[C.VENDOR_FOREIGN_FLOW]})


# ---- JSON payloads -------------------------------------------------------------------


def _listed(df: DataFrame, keys: list[str], item: Column) -> DataFrame:
    """One list of items per key; a day has one item per ticker or participant."""
    return df.groupBy(*keys).agg(F.collect_list(item).alias("items"))


def _stock_items() -> Column:
    return F.struct(
        F.concat("ticker", F.lit(".JK")).alias("StockCode"),
        F.when(F.dayofmonth("trade_date") % 2 == 0, F.date_format("trade_date", "yyyy-MM-dd'T'00:00:00")).otherwise(F.lit("")).alias("Date"),
        F.col("foreign_buy").alias("ForeignBuy"),
        F.col("foreign_sell").cast("string").alias("ForeignSell"),
        F.col("volume").alias("Volume"),
        F.lit("n/a").alias("Value"),
    )


STOCK_SPEC = "ticker trade_date foreign_buy:4 foreign_sell:4 foreign_net:4 volume:4 traded_value:4 frequency:4 source"


@query(
    STOCK_SPEC,
    f"SELECT ticker, trade_date, foreign_buy, foreign_sell, foreign_net, volume, 0.0 AS traded_value, 0.0 AS frequency, source FROM foreign_flows WHERE source = '{C.OFFICIAL_STOCK_SUMMARY}'",
)
def json_official_stock_summary(spark, root):
    flows = T.foreign_flows(spark, root).where(F.col("source") == C.OFFICIAL_STOCK_SUMMARY)
    packed = _listed(flows, ["trade_date"], _stock_items())
    return payloads.official_stock_summary(packed.select("trade_date", F.to_json(F.struct(F.col("items").alias("data"))).alias("payload")))


@query(
    STOCK_SPEC,
    f"SELECT ticker, trade_date, foreign_buy, foreign_sell, foreign_net, volume, 0.0 AS traded_value, 0.0 AS frequency, '{C.VENDOR_STOCK_SUMMARY}' AS source FROM foreign_flows WHERE source = '{C.VENDOR_FOREIGN_FLOW}'",
)
def json_vendor_stock_summary(spark, root):
    flows = T.foreign_flows(spark, root).where(F.col("source") == C.VENDOR_FOREIGN_FLOW)
    packed = _listed(flows, ["trade_date"], _stock_items())
    inner = F.struct(F.lit("stock").alias("dataset"), F.col("items").alias("data"))
    body = F.to_json(F.struct(inner.alias("data"), F.lit("p").alias("project")))
    return payloads.vendor_stock_summary(packed.select("trade_date", body.alias("payload")), T.universe(spark, root))


def _vendor_payloads(spark: SparkSession, root: str) -> DataFrame:
    flows = T.foreign_flows(spark, root).where(F.col("source") == C.VENDOR_FOREIGN_FLOW)
    item = F.struct(
        F.lower("ticker").alias("code"),
        F.col("foreign_buy").alias("foreignBuyShares"),
        F.col("foreign_sell").alias("foreignSellShares"),
        F.when(F.col("ticker").like("%1%"), F.lit(7.0)).alias("netForeignShares"),
        F.col("volume"),
    )
    packed = _listed(flows, ["trade_date"], item)
    unit = F.when(F.dayofmonth("trade_date") == 10, F.lit("lots")).otherwise(F.lit("Shares"))
    inner = F.struct(F.col("trade_date").cast("string").alias("date"), unit.alias("unit"), F.lit(1).alias("total"), F.col("items").alias("data"))
    return packed.select(F.lit("1999-01-01").cast("date").alias("trade_date"), F.to_json(F.struct(inner.alias("data"))).alias("payload"))


@query(
    "ticker trade_date foreign_buy:4 foreign_sell:4 foreign_net:4 volume:4 source",
    f"""SELECT * REPLACE (CASE WHEN ticker LIKE '%1%' THEN 7.0 ELSE foreign_net END AS foreign_net) FROM foreign_flows
        WHERE source = '{C.VENDOR_FOREIGN_FLOW}' AND day(trade_date) <> 10""",
)
def json_vendor_foreign_flow(spark, root):
    return payloads.vendor_foreign_flow(_vendor_payloads(spark, root), T.universe(spark, root))


@query("day", f"SELECT DISTINCT strftime(trade_date, '%Y-%m-%d') AS day FROM foreign_flows WHERE source = '{C.VENDOR_FOREIGN_FLOW}' AND day(trade_date) = 10")
def json_unit_quarantine(spark, root):
    bad = payloads.split_by_unit(_vendor_payloads(spark, root))[1]
    return bad.select(F.get_json_object("payload", "$.data.date").alias("day"))


@query(
    "ticker trade_date broker_code broker_name buy_value:4 sell_value:4 buy_volume:4 sell_volume:4 source source_verified",
    f"""SELECT ticker, trade_date, participant AS broker_code, 'Firm ' || participant AS broker_name, buy_value, sell_value, buy_volume, sell_volume, '{C.OFFICIAL_BROKER_SUMMARY}' AS source,
        TRUE AS source_verified FROM flow WHERE participant <> 'N5'""",
)
def json_official_broker_summary(spark, root):
    """Aliased fields; the rows of one participant name another ticker and must go."""
    odd = F.col("participant").like("%1%")
    item = F.struct(
        F.when(F.col("participant") == "N5", F.lit("OTHER")).otherwise(F.col("ticker")).alias("StockCode"),
        F.when(odd, F.col("participant")).alias("IDFirm"),
        F.when(~odd, F.lower("participant")).alias("brokerCode"),
        F.concat(F.lit("Firm "), F.col("participant")).alias("FirmName"),
        F.when(odd, F.col("buy_value")).alias("BuyValue"),
        F.when(~odd, F.col("buy_value")).alias("buy"),
        F.col("sell_value").alias("SellValue"),
        F.col("buy_volume").alias("buyQty"),
        F.col("sell_volume").cast("string").alias("sellVolume"),
    )
    packed = _listed(_flow(spark, root), ["ticker", "trade_date"], item)
    body = F.to_json(F.struct(F.struct(F.col("items").alias("results")).alias("data")))
    return payloads.official_broker_summary(packed.select("ticker", "trade_date", body.alias("payload")))


@query(
    "trade_date broker_code broker_name volume:4 value:4 source",
    f"SELECT trade_date, participant AS broker_code, 'Firm' AS broker_name, sum(buy_volume + sell_volume) AS volume, sum(buy_value + sell_value) AS value, '{C.OFFICIAL_MARKET_SUMMARY}' AS source FROM flow GROUP BY ALL",
)
def json_market_broker_totals(spark, root):
    totals = _flow(spark, root).groupBy("trade_date", "participant").agg(
        F.sum(F.col("buy_volume") + F.col("sell_volume")).alias("Volume"), F.sum(F.col("buy_value") + F.col("sell_value")).alias("Value")
    )
    packed = _listed(totals, ["trade_date"], F.struct(F.col("participant").alias("IDFirm"), F.lit("Firm").alias("FirmName"), "Volume", "Value"))
    return payloads.market_broker_totals(packed.select("trade_date", F.to_json(F.struct(F.col("items").alias("data"))).alias("payload")))


@query(
    "ticker trade_date broker_code buy_value:4 sell_value:4 buy_volume:4 sell_volume:4 market_type source provenance_state",
    f"""SELECT ticker, trade_date, participant AS broker_code, buy_value, 0.0 AS sell_value, buy_volume, sell_volume, 'RG' AS market_type, '{C.VENDOR_EXACT_DAY}' AS source,
        '{C.EXACT_DAY_STATE}' AS provenance_state FROM flow WHERE (buy_value > 0 OR sell_volume > 0) AND day(trade_date) <> 1""",
)
def json_exact_day_broker(spark, root):
    """Negative sell values count as zero; answers without success yield nothing."""
    item = F.struct(F.lower("participant").alias("code"), "buy_value", (-F.col("sell_value")).alias("sell_value"), "buy_volume", "sell_volume")
    packed = _listed(_flow(spark, root), ["ticker", "trade_date"], item)
    body = F.to_json(F.struct((F.dayofmonth("trade_date") != 1).alias("success"), F.col("items").alias("data")))
    return payloads.exact_day_broker(packed.select("ticker", "trade_date", body.alias("payload")))


@query(
    "ticker trade_date broker_code buy_value:4 sell_value:4 buy_volume:4 sell_volume:4 source provenance_state",
    f"""SELECT ticker, trade_date, participant AS broker_code, CASE WHEN net_value > 0 THEN net_value ELSE 0 END AS buy_value, CASE WHEN net_value < 0 THEN -net_value ELSE 0 END AS sell_value,
        CASE WHEN net_value > 0 THEN 100 * abs(net_volume) ELSE 0 END AS buy_volume, CASE WHEN net_value < 0 THEN 100 * abs(net_volume) ELSE 0 END AS sell_volume, '{C.VENDOR_NET_SIDE}' AS source,
        'VERIFIED_VENDOR_API_NET_SIDE_ALL' AS provenance_state FROM flow WHERE net_value <> 0""",
)
def json_net_side_broker(spark, root):
    item = F.struct(
        F.struct(F.col("participant").alias("code")).alias("broker"),
        F.when(F.col("net_value") > 0, F.lit("buy")).when(F.col("net_value") < 0, F.lit("SELL")).otherwise(F.lit("")).alias("side"),
        F.abs("net_volume").alias("lot"),
        F.abs("net_value").alias("value"),
    )
    packed = _listed(_flow(spark, root), ["ticker", "trade_date"], item)
    body = F.to_json(F.struct(F.struct(F.col("items").alias("results")).alias("data")))
    return payloads.net_side_broker(packed.select("ticker", "trade_date", body.alias("payload")))


@query("ticker date open:4 high:4 low:4 close:4 volume:4", "SELECT * FROM bars")
def json_chart(spark, root):
    """Bars as parallel arrays per ticker and back; a ticker has one element per trading day."""
    bar = F.struct(F.unix_seconds(F.col("date").cast("timestamp")).alias("ts"), "open", "high", "low", "close", "volume")
    packed = T.bars(spark, root).groupBy("ticker").agg(F.array_sort(F.collect_list(bar)).alias("b"))
    quote = F.struct(*[F.col(f"b.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])
    result = F.struct(F.col("b.ts").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    body = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")))
    return payloads.chart_bars(packed.select("ticker", body.alias("payload")))


@query("ticker date close:4 volume:4", "SELECT ticker, date, close, volume FROM bars")
def wide_to_long(spark, root):
    """One wide column per ticker and field, unfolded to long rows again."""
    names = sorted(r.ticker for r in T.universe(spark, root).collect())  # they become column names
    wide = T.bars(spark, root).groupBy("date").agg(
        *[F.max(F.when(F.col("ticker") == n, F.col(c))).alias(f"{n}.JK:{c.title()}") for n in names for c in ("close", "volume")]
    )
    return payloads.wide_bars(wide).where(F.col("close").isNotNull())


# ---- finalist evidence, stream -------------------------------------------------------


@query(
    "ticker trade_date broker_code source buy_value:4",
    f"""SELECT f.ticker, f.trade_date, f.participant AS broker_code, '{C.VENDOR_EXACT_DAY}' AS source, CASE WHEN f.trade_date >= DATE '2001-06-01' THEN f.buy_value * 2 ELSE f.buy_value END AS buy_value
        FROM flow f JOIN finalists x ON x.ticker = f.ticker""",
)
def finalist_broker(spark, root):
    """Stored rows of all finalists; the bundled rows of later months replace theirs."""
    rows = _flow(spark, root).withColumnRenamed("participant", "broker_code")
    rows = rows.withColumns({"source": F.lit(C.VENDOR_EXACT_DAY), "market_type": F.lit("RG"), "source_verified": F.lit(True)})
    bundled = rows.where(F.col("trade_date") >= "2001-06-01").withColumn("buy_value", F.col("buy_value") * 2)
    finalists = staged(funnel.select_guarded_top5(_scan(spark, root, None)).select("ticker"), "finalists")
    return evidence.assemble_finalist_broker(finalists, rows, bundled)


def _home(spark: SparkSession, name: str) -> str:
    """A new folder beside the staged tables."""
    return staged(spark.range(1), name).inputFiles()[0].rsplit("/", 1)[0]


@query(FLOW, "SELECT * FROM flow")
def stream_trade_days(spark, root):
    """The trades as a stream of four files, one a batch, that cut every day; read back from the table."""
    lineitem, home = T.table(spark, root, "lineitem"), _home(spark, "stream")
    lineitem.repartition(4).write.parquet(f"{home}/in")
    raw = stream.trade_stream(spark, f"{home}/in", lineitem.schema, files_per_batch=1)
    job = stream.ingest_trade_days(raw, f"{home}/table", f"{home}/checkpoint", prepare=lambda batch: T.trades(spark, root, batch))
    job.awaitTermination()
    return stream.flow_table(spark, f"{home}/table")


@query(
    OUTCOME_SPEC + " stamped",
    "SELECT *, evaluation_status <> 'PENDING' AS stamped FROM outcomes WHERE CAST(substr(run_id, 2) AS INT) % 3 <> 0 AND CAST(substr(run_id, 2) AS INT) % 5 <> 0",
)
def outcome_refresh_rows(spark, root):
    """The rows behind the refresh counts."""
    updates = outcomes.refresh_pending(_stored_outcomes(spark, root), T.universe(spark, root), T.daily_prices(spark, root))
    return updates.withColumn("stamped", F.col("evaluated_at").isNotNull())


# ---- missing data --------------------------------------------------------------------


@query(
    "ticker participant_flow_coverage_pct:4 participant_accumulation_state_known participant_flow_source",
    f"""SELECT u.ticker, CASE WHEN d.days IS NULL THEN 0 ELSE least(100, 5.0 * d.days) END AS participant_flow_coverage_pct, d.days IS NOT NULL AS participant_accumulation_state_known,
        CASE WHEN d.days IS NOT NULL THEN '{C.TRADE_DETAIL_FLOW}' END AS participant_flow_source
        FROM (SELECT ticker FROM universe UNION ALL SELECT 'NOHISTORY') u LEFT JOIN (SELECT ticker, count(DISTINCT trade_date) AS days FROM flow WHERE net_value <> 0 GROUP BY ticker) d ON d.ticker = u.ticker""",
)
def participant_no_data(spark, root):
    """A ticker without any flow gets NO_DATA, coverage 0 and no source."""
    universe = T.universe(spark, root).select("ticker").union(spark.createDataFrame([("NOHISTORY",)], "ticker string"))
    scored = P.score_participant_history(P.top_participants(_flow(spark, root), 10), universe)
    return scored.withColumn("participant_accumulation_state_known", F.col("participant_accumulation_state") != "NO_DATA")


@query(
    "ticker trade_date source brokers:i",
    """SELECT ticker, trade_date, 'USER_IMPORT' AS source, count(DISTINCT participant) AS brokers FROM flow GROUP BY ticker, trade_date""",
)
def broker_source_missing(spark, root):
    """Rows without a source are one source of their own, not lost."""
    rows = _flow(spark, root).withColumnRenamed("participant", "broker_code").withColumn("source", F.lit(None).cast("string"))
    chosen = evidence.select_broker_evidence(rows)
    return chosen.groupBy("ticker", "trade_date", "source").agg(F.count_distinct("broker_code").alias("brokers"))


@query(
    "ticker stage bars:i",
    "SELECT u.ticker, 'BROKER_VERIFY' AS stage, count(b.date) AS bars FROM (SELECT ticker FROM universe UNION ALL SELECT 'NOHISTORY') u LEFT JOIN bars b ON b.ticker = u.ticker GROUP BY u.ticker HAVING count(b.date) < 1520",
)
def verification_errors(spark, root):
    """Finalists whose history is too short to verify are named, not dropped."""
    finalists = T.universe(spark, root).select("ticker").union(spark.createDataFrame([("NOHISTORY",)], "ticker string"))
    return funnel.verification_errors(finalists, T.bars(spark, root), C.ScanConfig(minimum_price_bars=1520))


@query(
    "id:i moment",
    "SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment FROM events",
)
def timestamps_parsed(spark, root):
    """Texts with an offset, with a Z and without a zone (which means UTC) name the same moment."""
    rows = T.table(spark, root, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp_ntz")).alias("ts"))
    there = F.col("ts") + F.expr("INTERVAL 7 HOURS")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    text = text.when(F.col("event_id") % 3 == 1, F.concat(F.date_format(there, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+07:00")))
    text = text.otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return rows.select(F.col("event_id").alias("id"), F.date_format(moment(text), "yyyy-MM-dd HH:mm:ss").alias("moment"))


# ---- files and sinks -----------------------------------------------------------------


@query(
    "ticker trade_date broker_code buy_value:4 sell_value:4 net_value:4 source market_type",
    "SELECT ticker, trade_date, participant AS broker_code, buy_value, sell_value, net_value, 'USER_IMPORT' AS source, 'REGULAR' AS market_type FROM flow",
)
def file_broker_csv(spark, root):
    """Broker rows written as CSV under untidy headers and read by the reader of user files."""
    home = _home(spark, "broker-csv")
    rows = _flow(spark, root).select(
        F.concat(F.lit(" "), F.lower("ticker"), F.lit(".JK")).alias(" Ticker"), F.col("trade_date").alias("Trade Date"), F.lower("participant").alias("Broker Code"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c.replace("_", " ").title()) for c in ("buy_value", "sell_value", "buy_volume", "sell_volume", "buy_avg", "sell_avg")],
    )
    sinks.export_csv(rows, f"{home}/csv")
    return files.read_broker_csv(spark, f"{home}/csv")


@query(
    FLOW,
    "SELECT * FROM flow",
)
def file_trade_detail(spark, root):
    """All trades as a file with bars between its fields."""
    home = _home(spark, "trade-detail")
    _raw_trades(spark, root).write.option("header", True).option("sep", "|").csv(f"{home}/csv")
    return P.aggregate_trade_detail(files.read_trade_detail_csv(spark, f"{home}/csv"), AS_OF)


@query(
    "ticker date open:4 high:4 low:4 close:4 volume:4",
    "SELECT b.* FROM bars b JOIN (SELECT ticker FROM bars GROUP BY ticker HAVING count(*) >= 80) e ON e.ticker = b.ticker",
)
def file_price_seed(spark, root):
    """Every day twice in the file, a larger price first: the last row of a day stays."""
    home = _home(spark, "price-seed")
    copies = F.explode(F.array(F.lit(2.0), F.lit(1.0)))
    rows = T.bars(spark, root).withColumn("k", copies).withColumns({c: F.col(c) * F.col("k") for c in ("open", "high", "low", "close")})
    rows = rows.repartition("ticker").sortWithinPartitions("ticker", "date", F.col("k").desc())
    rows.select("ticker", "date", "open", "high", "low", "close", "volume").write.option("header", True).option("compression", "gzip").csv(f"{home}/csv")
    return files.read_price_seed(spark, f"{home}/csv")


@query("ticker", "SELECT ticker FROM universe")
def file_universe_and_targets(spark, root):
    """The universe as CSV and as a target list; both readers must agree."""
    home, names = _home(spark, "universe"), T.universe(spark, root).orderBy("position")
    names.select(F.concat("ticker", F.lit(".jk")).alias("Ticker")).coalesce(1).write.option("header", True).csv(f"{home}/csv")
    listed = F.to_json(F.struct(F.array_sort(F.collect_list("ticker")).alias("tickers")))
    names.agg(listed.alias("value")).coalesce(1).write.text(f"{home}/json")
    return files.read_universe_csv(spark, f"{home}/csv").select("ticker").intersect(files.read_targets(spark, f"{home}/json").select("ticker"))


@query(
    "ticker trade_date participant buy_value:4",
    "SELECT ticker, trade_date, participant, CASE WHEN day(trade_date) % 2 = 0 THEN buy_value + 1 ELSE buy_value END AS buy_value FROM flow",
)
def upsert_merge(spark, root):
    """Corrected rows of every second day over a held table."""
    home = _home(spark, "upsert")
    flow = _flow(spark, root).select("ticker", "trade_date", "participant", "buy_value").withColumn("trade_month", stream.month_number("trade_date"))
    keys = ("ticker", "trade_date", "participant", "trade_month")
    sinks.upsert(flow, f"{home}/table", keys, "trade_month")
    sinks.upsert(flow.where("day(trade_date) % 2 = 0").withColumn("buy_value", F.col("buy_value") + 1), f"{home}/table", keys, "trade_month")
    return files.read_table(spark, f"{home}/table")


@query(
    "ticker bars:i known:i",
    "SELECT ticker, count(*) AS bars, count(*) FILTER (WHERE volume > 0) AS known FROM bars GROUP BY ticker",
)
def strict_json_rows(spark, root):
    """Nested NaN becomes null in the text."""
    rows = T.bars(spark, root).select("ticker", F.struct(F.when(F.col("volume") > 0, F.col("close")).otherwise(F.lit(float("nan"))).alias("close")).alias("components"))
    home = _home(spark, "strict-json")
    sinks.strict_json(rows).write.text(f"{home}/json")
    read = spark.read.schema("ticker string, components struct<close: double>").json(f"{home}/json")
    return read.groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"), F.count("components.close").alias("known"))


@query("ticker rows:i", "SELECT ticker, 2 AS rows FROM universe")
def audit_appended(spark, root):
    """Two audits of the same tickers lie in the table side by side."""
    home = _home(spark, "audit")
    rows = sinks.audit_rows(T.bars(spark, root), T.universe(spark, root), "CHART", "OHLCV_DAILY")
    sinks.append_audit(rows, f"{home}/table")
    sinks.append_audit(rows, f"{home}/table")
    return spark.read.parquet(f"{home}/table").groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))


@query(
    FLOW,
    "SELECT * FROM flow WHERE trade_date >= DATE '2001-06-30' - 45",
)
def stream_retention(spark, root):
    """What stays of the streamed table 45 days before a day."""
    lineitem, home = T.table(spark, root, "lineitem"), _home(spark, "retention")
    raw = stream.trade_stream(spark, f"{root}/lineitem*.parquet", lineitem.schema)
    stream.ingest_trade_days(raw, f"{home}/table", f"{home}/checkpoint", prepare=lambda batch: T.trades(spark, root, batch)).awaitTermination()
    return stream.retained(spark, f"{home}/table", AS_OF, 45)


from tidebook.plans import store_queries, stream_queries  # noqa: E402, F401  they register their queries
