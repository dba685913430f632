"""Broker cohort model: who accumulates, how steadily, at what cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.config import ScanConfig
from tidebook.functions.days import day_bits, day_sets, days_held
from tidebook.functions.scalars import between, lenient_bool, ratio, sum0
from tidebook.functions.text import agg_texts, held, score, sigmoid, with_texts

WINDOWS = (5, 20, 60)

BROKER_COLUMNS = (
    "broker_days",
    "coverage_pct",
    "accumulation_score",
    "accumulation_quality_score",
    "operator_dominance_score",
    "supply_concentration_score",
    "estimated_smart_money_cost",
    "premium_to_cost_pct",
    "cost_basis_score",
    "cost_position",
    "distribution_risk",
    "top_accumulating_brokers",
    "top_distributing_brokers",
    "net_value_5d",
    "net_value_20d",
    "net_value_60d",
    "persistence_5d",
    "persistence_20d",
    "persistence_60d",
    "broker_cohort_stability",
    "broker_hhi",
    "net_conversion_ratio",
    "reversal_ratio_5d",
    "broker_balance_error_pct",
)


def _positive(name: str) -> Column:
    return F.greatest(F.coalesce(name, F.lit(0.0)), F.lit(0.0))


def broker_days_table(broker: DataFrame) -> DataFrame:
    """Broker rows folded to one per (ticker, day, broker); map-side combined."""
    net_volume = F.coalesce("buy_volume", F.lit(0.0)) - F.coalesce("sell_volume", F.lit(0.0))
    priced = (net_volume > 0) & (F.col("buy_avg") > 0)
    gross = _positive("buy_value") + _positive("sell_value")
    verified = lenient_bool(F.col("source_verified")) if "source_verified" in broker.columns else F.lit(False)
    return broker.groupBy("ticker", "trade_date", "broker_code").agg(
        sum0(F.col("buy_value")).alias("buy_value"),
        sum0(F.col("sell_value")).alias("sell_value"),
        sum0(F.coalesce("buy_value", F.lit(0.0)) - F.coalesce("sell_value", F.lit(0.0))).alias("net_value"),
        sum0(F.when(priced, net_volume * F.col("buy_avg"))).alias("cost_value"),
        sum0(F.when(priced, net_volume)).alias("cost_volume"),
        F.sum(gross).alias("gross"),
        sum0(F.when(verified, gross)).alias("verified_gross"),
    )


def broker_windows(broker: DataFrame) -> DataFrame:
    """One row per (ticker, broker) with its sums over the last 5, 20 and 60 broker days.

    After the daily fold a ticker has at most one row per broker code and
    trading day, which bounds the day window; the exchange by ticker made for
    it serves every later step of the model.
    """
    newest = Window.partitionBy("ticker").orderBy(F.col("trade_date").desc())
    daily = broker_days_table(broker).withColumn("day_rank", F.dense_rank().over(newest))
    sums: dict[str, str] = {}
    for w in WINDOWS:
        sums[f"net_{w}"] = f"coalesce(sum(CASE WHEN day_rank <= {w} THEN net_value END), 0D)"
        sums[f"up_days_{w}"] = f"count(CASE WHEN day_rank <= {w} AND net_value > 0 THEN 1 END)"
        sums[f"days_{w}"] = f"count(CASE WHEN day_rank <= {w} THEN 1 END)"
    for name, w in (("buy", 20), ("sell", 20), ("cost", 60)):
        columns = ("cost_value", "cost_volume") if name == "cost" else (f"{name}_value",)
        for c in columns:
            out = f"{c}_{w}" if name == "cost" else f"{name}_{w}"
            sums[out] = f"coalesce(sum(CASE WHEN day_rank <= {w} THEN {c} END), 0D)"
    sums |= {
        "gross": "sum(gross)",
        "verified_gross": "sum(verified_gross)",
        "oldest_day_rank": "max(day_rank)",
    }
    return daily.groupBy("ticker", "broker_code").agg(*agg_texts(sums))


def broker_cohort(windows: DataFrame, cohort_size: int = 5) -> DataFrame:
    """Adds the rank of each broker among net buyers per window and net sellers over 20 days."""

    def rank(order: Column) -> Column:
        return F.row_number().over(Window.partitionBy("ticker").orderBy(order, "broker_code"))

    ranked = windows
    for w in WINDOWS:
        place = rank(F.when(F.col(f"net_{w}") > 0, F.col(f"net_{w}")).desc_nulls_last())
        ranked = ranked.withColumn(f"buyer_rank_{w}", F.when(F.col(f"net_{w}") > 0, place))
    place = rank(F.when(F.col("net_20") < 0, F.col("net_20")).asc_nulls_last())
    ranked = ranked.withColumn("seller_rank_20", F.when(F.col("net_20") < 0, place))
    for w in WINDOWS:
        ranked = ranked.withColumn(f"in_{w}", F.coalesce(F.col(f"buyer_rank_{w}") <= cohort_size, F.lit(False)))
    return ranked


def broker_state(broker: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """One row per ticker with all sums of the model, no price needed yet.

    The set of its days is a bitmap made from the rows as they come, one per task and ticker at
    most in the exchange; stage rows that are costly to make, as they are read twice.
    """
    config = config or ScanConfig()
    rows = broker_cohort(broker_windows(broker), config.cohort_size)

    def codes(rank: str) -> str:
        kept = f"CASE WHEN {rank} <= {config.cohort_size} THEN named_struct('rank', {rank}, 'code', broker_code) END"
        return f"array_sort(collect_list({kept})).code"

    def over(flag: str, value: str) -> str:
        return f"coalesce(sum(CASE WHEN {flag} THEN {value} END), 0D)"

    sums = {
        "broker_days": "max(oldest_day_rank)",
        "distinct_brokers": "count(1)",
        "gross_all": "sum(gross)",
        "verified_gross_all": "sum(verified_gross)",
        "positive_20": over("net_20 > 0", "net_20"),
        "positive_sq_20": over("net_20 > 0", "net_20 * net_20"),
        "buy_20": "sum(buy_20)",
        "sell_20": "sum(sell_20)",
        "members_20": "count(CASE WHEN in_20 THEN 1 END)",
        "members_60": "count(CASE WHEN in_60 THEN 1 END)",
        "shared_5_20": "count(CASE WHEN in_20 AND in_5 THEN 1 END)",
        "shared_20_60": "count(CASE WHEN in_20 AND in_60 THEN 1 END)",
        "cost_value_60": over("in_20", "cost_value_60"),
        "cost_volume_60": over("in_20", "cost_volume_60"),
        "reversed_5": over("in_20 AND net_5 < 0", "least(-net_5, net_20)"),
        "top_accumulating_brokers": codes("buyer_rank_20"),
        "top_distributing_brokers": codes("seller_rank_20"),
    }
    for w in WINDOWS:
        sums[f"net_value_{w}d"] = over(f"in_{w}", f"net_{w}")
        weighted = over(f"in_{w}", f"net_{w} * up_days_{w} / days_{w}")
        sums[f"persistence_{w}d"] = f"coalesce(try_divide({weighted}, {over(f'in_{w}', f'net_{w}')}), 0D)"
    days = day_sets(day_bits(broker, ["ticker"], "trade_date"), ["ticker"], "broker_day_set")
    return rows.groupBy("ticker").agg(*agg_texts(sums)).join(days, "ticker", "left")


def add_broker_features(state: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """Scores from ``broker_state`` joined to ``bar_profile`` on ticker.

    Needs ``price_days`` and ``last_close`` beside the state columns. Rows
    whose state is null (no broker rows) take the fixed empty values.
    """
    # All weights, scales, cost bands and empty defaults below.
    config = config or ScanConfig()
    turnover = "greatest((buy_20 + sell_20) / 2, 1D)"
    s = with_texts(
        state,
        {
            "has_broker": "broker_days IS NOT NULL",
            "coverage_pct": "CASE WHEN broker_days IS NOT NULL AND size(price_days) > 0"
            f" THEN 100D * {days_held('broker_day_set', 'price_days')} / size(price_days) ELSE 0D END",
            "_conc": "CASE WHEN positive_20 > 0 THEN net_value_20d / positive_20 ELSE 0D END",
            "net_conversion_ratio": f"coalesce(positive_20 / {turnover}, 0D)",
            "_edge": f"net_value_20d / {turnover} - 0.08D",
            "broker_hhi": "CASE WHEN positive_20 > 0 THEN positive_sq_20 / (positive_20 * positive_20) ELSE 0D END",
            "_overlap_5": "shared_5_20 / greatest(members_20, 1)",
            "_overlap_60": "CASE WHEN members_60 > 0 THEN shared_20_60 / greatest(members_20, 1) END",
            "estimated_smart_money_cost": "try_divide(cost_value_60, cost_volume_60)",
            "reversal_ratio_5d": "coalesce(reversed_5 / greatest(net_value_20d, 1D), 0D)",
            "broker_balance_error_pct": "CASE WHEN broker_days IS NOT NULL"
            f" THEN 100D * abs(buy_20 - sell_20) / {turnover} ELSE 100D END",
            "_verified": "try_divide(100D * verified_gross_all, gross_all)",
            **{f"persistence_{w}d": f"coalesce(persistence_{w}d, 0D)" for w in WINDOWS},
            **{f"net_value_{w}d": f"coalesce(net_value_{w}d, 0D)" for w in WINDOWS},
        },
    )
    s = with_texts(
        s,
        {
            "broker_verified_source_pct": f"CASE WHEN _verified IS NULL THEN 0D ELSE {held('_verified')} END",
            "_intensity": sigmoid("_edge", 0.05),
            "_stability": "0.6D * _overlap_5 + 0.4D * coalesce(_overlap_60, _overlap_5)",
            "premium_to_cost_pct": "100D * (try_divide(last_close, estimated_smart_money_cost) - 1)",
            "_conc_score": held("100D * _conc"),
            "_hhi_score": held("100D * sqrt(greatest(broker_hhi, 0D))"),
        },
    )
    s = with_texts(
        s,
        {
            "broker_cohort_stability": f"CASE WHEN _stability IS NULL THEN 0D ELSE {held('_stability', 0.0, 1.0)} END",
            "_extension": "CASE WHEN premium_to_cost_pct IS NULL THEN 0D"
            f" ELSE {held('(premium_to_cost_pct - 20) / 30D', 0.0, 1.0)} END",
        },
    )
    s = with_texts(
        s,
        {
            "_quality": score(
                "(34 * persistence_20d + 0.24D * _intensity + 18 * broker_cohort_stability + 0.14D * _conc_score"
                f" + 0.10D * {held('100D * least(net_conversion_ratio / 0.35D, 1D)')})"
            )
        },
    )
    bands = [
        (-5.0, 95.0, "UNDER_COST"),
        (5.0, 92.0, "NEAR_COST"),
        (15.0, 82.0, "HEALTHY_MARKUP"),
        (30.0, 62.0, "MARKUP"),
        (config.max_premium_pct, 45.0, "EXTENDED"),
    ]
    points = " ".join(f"WHEN premium_to_cost_pct <= {limit}D THEN {value}D" for limit, value, _ in bands)
    labels = " ".join(f"WHEN premium_to_cost_pct <= {limit}D THEN '{label}'" for limit, _, label in bands)

    def given(text: str, default: str) -> str:
        return f"CASE WHEN has_broker THEN {text} ELSE {default} END"

    s = with_texts(
        s,
        {
            "accumulation_quality_score": given("_quality", "0D"),
            "accumulation_score": given(score("(0.58D * _quality + 22 * persistence_20d + 0.20D * _intensity)"), "0D"),
            "operator_dominance_score": given(
                score("(0.45D * _conc_score + 0.30D * _hhi_score + 25 * broker_cohort_stability)"), "0D"
            ),
            "supply_concentration_score": given(score("(0.60D * _conc_score + 0.40D * _hhi_score)"), "0D"),
            "cost_basis_score": given(f"CASE WHEN premium_to_cost_pct IS NULL THEN 35D {points} ELSE 20D END", "0D"),
            "cost_position": given(
                f"CASE WHEN premium_to_cost_pct IS NULL THEN 'UNKNOWN' {labels} ELSE 'OVEREXTENDED' END", "'UNKNOWN'"
            ),
            "distribution_risk": given(
                score("(62 * reversal_ratio_5d + 23 * _extension + 15 * (1 - broker_cohort_stability))"), "50D"
            ),
            "broker_days": "coalesce(broker_days, 0)",
            "distinct_brokers": "coalesce(distinct_brokers, 0)",
            "top_accumulating_brokers": "coalesce(top_accumulating_brokers, array())",
            "top_distributing_brokers": "coalesce(top_distributing_brokers, array())",
        },
    )
    return s.drop("broker_day_set", *[c for c in s.columns if c.startswith("_")])


def compute_broker_features(broker: DataFrame, profile: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """Broker features per ticker of ``profile`` (the frame made by ``bar_profile``)."""
    joined = profile.select("ticker", "price_days", "last_close").join(broker_state(broker, config), "ticker", "left")
    return add_broker_features(joined, config)


def verified_source_pct(broker: DataFrame) -> DataFrame:
    """Share of gross value that carries verified provenance, per ticker."""
    gross = _positive("buy_value") + _positive("sell_value")
    verified = lenient_bool(F.col("source_verified"))
    return broker.groupBy("ticker").agg(
        F.coalesce(
            between(ratio(F.lit(100.0) * sum0(F.when(verified, gross)), F.sum(gross)), 0.0, 100.0), F.lit(0.0)
        ).alias("verified_source_pct"),
        (F.lit(100.0) * F.avg(verified.cast("double"))).alias("verified_row_pct"),
    )


def broker_database_coverage(universe: DataFrame, broker: DataFrame, lookback_days: int = 20) -> DataFrame:
    days = broker.groupBy("ticker").agg(F.count_distinct("trade_date").alias("broker_days"))
    count = F.coalesce("broker_days", F.lit(0))
    return universe.select("ticker").join(days, "ticker", "left").select(
        "ticker", count.alias("broker_days"), (count >= lookback_days).alias("broker_ready")
    )
