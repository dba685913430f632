"""The scan: bars, broker rows and foreign flow to one scored row per ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.config import ScanConfig
from tidebook.functions.frames import one_row, staged
from tidebook.functions.text import rounded, with_texts, zero_default
from tidebook.operators.bars import bar_profile
from tidebook.operators.broker import add_broker_features, broker_state
from tidebook.operators.foreign import add_foreign_features, foreign_state
from tidebook.operators.price import (
    add_market,
    add_price_flow,
    add_quality,
    add_structure,
    market_context,
)
from tidebook.operators.scoring import add_action, add_effective, add_guard, add_phase, add_score, direct_gate

MARKET_COLUMNS = (
    "market_sector_score",
    "market_regime_score",
    "market_regime_label",
    "market_breadth_20d",
    "market_breadth_60d",
    "relative_strength_20d_pct",
    "relative_strength_60d_pct",
    "market_context_basis",
    "market_context_coverage",
)
DIAGNOSTICS = (
    "broker_days",
    "distinct_brokers",
    "broker_verified_source_pct",
    "net_value_5d",
    "net_value_20d",
    "net_value_60d",
    "persistence_5d",
    "persistence_20d",
    "persistence_60d",
    "accumulation_quality_score",
    "broker_cohort_stability",
    "broker_hhi",
    "net_conversion_ratio",
    "reversal_ratio_5d",
    "broker_balance_error_pct",
    "cost_position",
    "foreign_evidence_coverage_pct",
    "foreign_evidence_source",
    "official_foreign_coverage_pct",
    "foreign_institutional_score",
    "foreign_net_5d",
    "foreign_net_20d",
    "foreign_persistence_20d",
    "foreign_intensity_20d",
    "market_regime_score",
    "market_regime_label",
    "market_breadth_20d",
    "market_breadth_60d",
    "relative_strength_20d_pct",
    "relative_strength_60d_pct",
    "market_context_basis",
    "market_context_coverage",
    "price_data_quality_score",
    "price_staleness_days",
    "zero_volume_ratio_20d",
    "unchanged_close_ratio_20d",
    "ohlc_geometry_error_ratio",
    "split_like_event_detected",
    "split_like_event_recent",
    "split_like_event_date",
    "split_like_factor",
    "split_like_bars_ago",
    "proxy_accumulation_score",
    "proxy_absorption_score",
    "proxy_supply_tightness_score",
    "proxy_distribution_risk",
    "proxy_cmf20",
    "proxy_obv_slope_norm20",
    "top_accumulating_brokers",
    "top_distributing_brokers",
    "bos",
    "choch",
    "liquidity_sweep",
    "fvg_low",
    "fvg_high",
    "execution_geometry_valid",
)
EMPTY_BROKER = "ticker string, trade_date date, broker_code string, buy_value double, sell_value double, buy_volume double, sell_volume double, buy_avg double, sell_avg double, source_verified boolean"
EMPTY_FOREIGN = "ticker string, trade_date date, foreign_buy double, foreign_sell double, volume double, source string"


def scan_inputs(bars: DataFrame, broker: DataFrame | None, flow: DataFrame | None, config: ScanConfig) -> DataFrame:
    """Bars, broker and flow states side by side; broker and flow rows are read for sums and for days.

    All three are already aggregated on ticker, so the joins reuse that layout.
    """
    spark = bars.sparkSession
    broker = spark.createDataFrame([], EMPTY_BROKER) if broker is None else broker
    flow = spark.createDataFrame([], EMPTY_FOREIGN) if flow is None else flow
    return (
        bar_profile(bars)
        .join(broker_state(broker, config), "ticker", "left")
        .join(foreign_state(flow), "ticker", "left")
    )


def score_rows(rows: DataFrame, config: ScanConfig, reference: str) -> DataFrame:
    """Features to result columns. ``rows`` also carries the market columns."""
    rows = add_foreign_features(add_broker_features(rows, config))
    rows = add_quality(add_structure(rows), reference)
    rows = with_texts(rows, {"direct_broker": direct_gate(config)})
    rows = add_effective(add_price_flow(rows, counts="direct_broker"))
    return add_guard(add_action(add_phase(add_score(rows, config))), config)


def publish(rows: DataFrame, *also: str) -> DataFrame:
    """The 29-field result row with rounded scores, ``score`` with the exact one, and the columns in ``also``."""
    two = {
        "final_score": "score",
        "evidence_coverage_pct": "coverage_pct",
        "accumulation_score": "effective_accumulation",
        "operator_dominance_score": "effective_dominance",
        "cost_basis_score": "effective_cost_basis",
        "retail_exhaustion_score": "retail_exhaustion_score",
        "foreign_institutional_score": zero_default("foreign_institutional_score", 50.0),
        "supply_concentration_score": "effective_supply",
        "price_flow_divergence_score": "price_flow_divergence_score",
        "market_context_score": zero_default("market_sector_score", 50.0),
        "smc_execution_score": "smc_execution_score",
        "risk_liquidity_score": "risk_liquidity_score",
        "price_data_quality_score": "price_data_quality_score",
        "distribution_risk": "effective_distribution",
        "premium_to_cost_pct": "CASE WHEN direct_broker THEN premium_to_cost_pct END",
        **{c: c for c in ("entry_low", "entry_high", "invalidation", "tp1", "tp2")},
    }
    cost = f"CASE WHEN direct_broker THEN {rounded('estimated_smart_money_cost', 4)} END"
    diagnostics = ", ".join(f"'{c}', {c}" for c in DIAGNOSTICS)
    return rows.selectExpr(
        "ticker",
        "last_date AS as_of_date",
        "phase",
        "action",
        "evidence_tier",
        *[f"{rounded(text, 2)} AS {name}" for name, text in two.items()],
        f"{cost} AS estimated_smart_money_cost",
        "real_money_state",
        "guardrail_reason",
        f"named_struct('broker_alpha_applied', direct_broker, {diagnostics}) AS diagnostics",
        "score",
        *also,
    )


def scan_universe(
    universe: DataFrame,
    bars: DataFrame,
    broker: DataFrame | None = None,
    flow: DataFrame | None = None,
    config: ScanConfig | None = None,
    context: DataFrame | None = None,
) -> DataFrame:
    """Scored rows of every universe ticker with enough bars.

    ``context`` is the one-row market context; by default it is taken from the
    bars of the whole universe. Two small tables, one row per ticker each, are
    written to the checkpoint folder on the way: the per-ticker sums, so that
    bars are read once for both context and scores and the long score
    projection is not planned anew after every shuffle; and the results, so
    that a filter on a score is not unfolded through that projection.
    """
    config = config or ScanConfig()
    bars = bars.join(universe.select("ticker").distinct(), "ticker", "left_semi")
    rows = staged(scan_inputs(bars, broker, flow, config), "scan-inputs")
    context = market_context(rows) if context is None else context
    rows = add_market(rows, one_row(context)).where(F.col("bars") >= config.minimum_price_bars)
    return staged(publish(score_rows(rows, config, "market_reference_date")), "scan-results")


def scan_errors(universe: DataFrame, bars: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """Universe tickers without enough bars, as rows rather than exceptions."""
    config = config or ScanConfig()
    counts = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"))
    n = F.coalesce("bars", F.lit(0))
    return (
        universe.select("ticker")
        .distinct()
        .join(counts, "ticker", "left")
        .where(n < config.minimum_price_bars)
        .select(
            "ticker",
            F.concat("ticker", F.lit(": insufficient price history ("), n.cast("string"), F.lit(" bars)")).alias("error"),
        )
    )


def in_result_order(results: DataFrame) -> DataFrame:
    return results.orderBy("real_money_state", F.col("final_score").desc(), "ticker")

