"""Per-ticker price features, each a projection of ``bar_profile``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tidebook.functions.text import agg_texts, clip, held, known, score, sigmoid, with_texts, zero_default

PRICE_FLOW_COLUMNS = (
    "retail_exhaustion_score",
    "price_flow_divergence_score",
    "risk_liquidity_score",
    "price_return_20d",
    "realized_vol_20d",
    "avg_traded_value_20d",
    "proxy_accumulation_score",
    "proxy_absorption_score",
    "proxy_supply_tightness_score",
    "proxy_distribution_risk",
    "proxy_cmf20",
    "proxy_obv_slope_norm20",
    "proxy_up_value_ratio20",
    "proxy_close_acceptance20",
    "proxy_absorption_ratio20",
)
STRUCTURE_COLUMNS = (
    "smc_execution_score",
    "bos",
    "choch",
    "liquidity_sweep",
    "fvg_low",
    "fvg_high",
    "entry_low",
    "entry_high",
    "invalidation",
    "tp1",
    "tp2",
    "ema20",
    "ema50",
    "execution_geometry_valid",
)
QUALITY_COLUMNS = (
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
)


def add_price_flow(profile: DataFrame, counts: str = "FALSE") -> DataFrame:
    """Money-flow and volatility features.

    ``counts`` is the condition under which the broker columns
    accumulation_score and persistence_20d may enter; elsewhere the price
    proxy stands in for them.
    """
    # All weights, scales and thresholds below.
    direct = counts != "FALSE"
    accumulation = f"CASE WHEN {counts} THEN accumulation_score ELSE _proxy_acc END" if direct else "_proxy_acc"
    persistence = f"CASE WHEN {counts} THEN persistence_20d ELSE 0D END" if direct else "0D"
    staged = with_texts(
        profile,
        {
            "_vol20": "CASE WHEN vol20_n >= 10 THEN vol20_raw END",
            "_vol60": "CASE WHEN vol60_n >= 20 THEN vol60_raw WHEN vol20_n >= 10 THEN vol20_raw END",
            "_p20": "try_divide(last_close, close_20) - 1",
            "_cmf": "coalesce(try_divide(money_flow_20, shares_20), 0D)",
            "_obv": "coalesce(try_divide(obv_slope_20, shares_20 / 20), 0D)",
            "_up": "CASE WHEN value_20 > 0 THEN up_value_20 / value_20 ELSE 0.5D END",
            "_adv": "value_20 / 20",
            "_enough": "bars >= 20",
        },
    )
    staged = with_texts(
        staged,
        {
            "_squeeze": f"CASE WHEN {known('_vol20')} AND {known('_vol60')} AND _vol60 > 0"
            f" THEN {held('1 - _vol20 / _vol60', -1.0, 1.0)} ELSE 0.5D END",
            "_liquid": sigmoid("(log10(greatest(_adv, 1D)) - 8.3D)", 0.7),
            "_calm": f"CASE WHEN {known('_vol20')} THEN {held('100 - 1200 * greatest(_vol20 - 0.02D, 0D)')} ELSE 50D END",
            "_cmf_score": sigmoid("_cmf", 0.08),
            "_obv_score": sigmoid("_obv", 0.25),
        },
    )
    staged = with_texts(
        staged,
        {
            "_tight": "greatest(_squeeze, 0D)",
            "_absorption": score("(35 + 180 * absorption_20 + 20 * greatest(_squeeze, 0D))"),
        },
    )
    staged = with_texts(
        staged,
        {
            "_proxy_acc": score(
                f"(0.30D * _cmf_score + 0.24D * _obv_score + 0.20D * {clip('_up * 100')}"
                f" + 0.14D * {clip('acceptance_20 * 100')} + 0.12D * _absorption)"
            ),
        },
    )

    def given(text: str, default: str) -> str:
        return f"CASE WHEN _enough THEN {text} ELSE {default} END"

    features = {
        "retail_exhaustion_score": given(
            score(
                f"(45 * {clip('1 - abs(_p20) / 0.12D', 0.0, 1.0)} + 25 * _tight + 20 * {persistence} + _absorption / 10)"
            ),
            "30D",
        ),
        "price_flow_divergence_score": given(score(f"(50 + 0.45D * ({accumulation} - 50) - 150 * _p20)"), "30D"),
        "risk_liquidity_score": given(score("(0.6D * _liquid + 0.4D * _calm)"), "30D"),
        "price_return_20d": given("_p20 * 100", "NULL"),
        "realized_vol_20d": given("_vol20", "NULL"),
        "avg_traded_value_20d": given("_adv", "NULL"),
        "proxy_accumulation_score": given("_proxy_acc", "30D"),
        "proxy_absorption_score": given("_absorption", "30D"),
        "proxy_supply_tightness_score": given(
            score("(40 * _tight + 35 * acceptance_20 + 100 * absorption_20)"), "30D"
        ),
        "proxy_distribution_risk": given(
            score(
                "(50 + 40 * greatest(-_cmf, 0D) + 22 * greatest(-_obv, 0D) + 100 * greatest(-_p20 - 0.08D, 0D)"
                " - 25 * absorption_20)"
            ),
            "50D",
        ),
        "proxy_cmf20": given("_cmf", "NULL"),
        "proxy_obv_slope_norm20": given("_obv", "NULL"),
        "proxy_up_value_ratio20": given("_up", "NULL"),
        "proxy_close_acceptance20": given("acceptance_20", "NULL"),
        "proxy_absorption_ratio20": given("absorption_20", "NULL"),
    }
    return with_texts(staged, features).drop(*[c for c in staged.columns if c.startswith("_")])


def add_structure(profile: DataFrame) -> DataFrame:
    """Break of structure, change of character, sweep, gap and trade levels."""
    # Score steps, the 1.08 / 0.75 gap bounds, ATR multiples, targets.
    staged = with_texts(
        profile,
        {
            "_enough": "bars >= 30",
            "_atr": "coalesce(CASE WHEN atr14_n >= 7 THEN atr14_raw END, last_close * 0.03D)",
            "_trend": "ema20_gap >= ema50_gap",
            "_before": "ema20_gap_6 >= ema50_gap_6",
            "_usable": "coalesce(fvg_low IS NOT NULL AND fvg_high <= last_close * 1.08D AND fvg_low >= last_close * 0.75D, FALSE)",
        },
    )
    staged = with_texts(
        staged,
        {
            "bos": "coalesce(_enough AND last_close > prev20_high, FALSE)",
            "choch": "coalesce(_enough AND _trend AND NOT _before, FALSE)",
            "liquidity_sweep": "coalesce(_enough AND last_low < prev5_low AND last_close > prev5_low, FALSE)",
            "ema20": "CASE WHEN _enough THEN last_close + ema20_gap END",
            "ema50": "CASE WHEN _enough THEN last_close + ema50_gap END",
            "_low": "CASE WHEN _usable THEN fvg_low ELSE last_close - 0.35D * _atr END",
            "_high": "CASE WHEN _usable THEN fvg_high ELSE last_close + 0.15D * _atr END",
            "fvg_low": "CASE WHEN _enough THEN fvg_low END",
            "fvg_high": "CASE WHEN _enough THEN fvg_high END",
        },
    )
    staged = with_texts(
        staged,
        {
            "_mid": "(_low + _high) / 2",
            "_stop": "least(prev5_low, _low - 0.8D * _atr)",
            "_score": "35D + 20 * int(_trend) + 20 * int(liquidity_sweep) + 15 * int(choch) + 10 * int(bos)"
            " + CASE WHEN fvg_low IS NOT NULL THEN 5 ELSE 0 END",
        },
    )
    staged = with_texts(staged, {"_risk": "greatest(_mid - _stop, _atr * 0.5D)"})
    staged = with_texts(staged, {"_tp1": "_mid + 2.0D * _risk", "_tp2": "_mid + 3.2D * _risk"})
    staged = with_texts(
        staged,
        {
            "execution_geometry_valid": "coalesce(_enough AND prev5_low IS NOT NULL AND _risk > 0 AND _high > _low AND _stop < _low AND _tp1 > _high"
            " AND _tp2 > _tp1, FALSE)",
        },
    )
    levels = {"entry_low": "_low", "entry_high": "_high", "invalidation": "_stop", "tp1": "_tp1", "tp2": "_tp2"}
    out = with_texts(
        staged,
        {
            **{name: f"CASE WHEN execution_geometry_valid THEN {text} END" for name, text in levels.items()},
            "smc_execution_score": f"CASE WHEN execution_geometry_valid THEN {held('_score')}"
            f" WHEN _enough THEN least({held('_score')}, 25D) ELSE 25D END",
        },
    )
    return out.drop(*[c for c in staged.columns if c.startswith("_")])


def add_quality(profile: DataFrame, reference: str = "last_date") -> DataFrame:
    """Staleness in calendar days, bar defects, recent split-like event, 0..100 score.

    ``reference`` is the SQL text of the day staleness is measured to. A row
    without bars (``bars`` null, from a universe join) takes the worst values.
    """
    # Penalties and tolerances of the score, the 60-bar recovery.
    found = "split_rn IS NOT NULL AND bars >= 3"
    staged = with_texts(
        profile,
        {
            "_some": "coalesce(bars, 0) > 0",
            "price_staleness_days": "CASE WHEN coalesce(bars, 0) > 0"
            f" THEN greatest(datediff(coalesce({reference}, last_date), last_date), 0) ELSE 999 END",
            "zero_volume_ratio_20d": "coalesce(zero_volume_20, 1D)",
            "unchanged_close_ratio_20d": "CASE WHEN bars >= 2 THEN unchanged_20 ELSE 1D END",
            "ohlc_geometry_error_ratio": "coalesce(bad_geometry_60, 1D)",
            "split_like_event_detected": f"coalesce({found}, FALSE)",
            "split_like_event_date": f"CASE WHEN {found} THEN split_date END",
            "split_like_factor": f"CASE WHEN {found} THEN split_factor END",
            "split_like_bars_ago": f"CASE WHEN {found} THEN split_rn - 1 END",
            "split_like_event_recent": f"coalesce({found} AND split_rn - 1 < 60, FALSE)",
        },
    )
    total = (
        "100 - least(55D, 10D * price_staleness_days) - greatest(0D, zero_volume_ratio_20d - 0.20D) * 45"
        " - greatest(0D, unchanged_close_ratio_20d - 0.45D) * 35 - least(35D, ohlc_geometry_error_ratio * 100)"
        f" - CASE WHEN split_like_event_recent THEN 30 * (1 - {held('split_like_bars_ago / 60D', 0.0, 1.0)}) ELSE 0D END"
    )
    staged = with_texts(staged, {"_total": total})
    return with_texts(staged, {"price_data_quality_score": f"CASE WHEN _some THEN {clip('_total')} ELSE 0D END"}).drop("_some", "_total")


# 20- and 60-session returns; null without enough bars or a positive base.
RETURNS = {
    "r20": "CASE WHEN bars > 20 AND close_21 > 0 THEN last_close / close_21 - 1 END",
    "r60": "CASE WHEN bars > 60 AND close_61 > 0 THEN last_close / close_61 - 1 END",
}


def market_context(profile: DataFrame) -> DataFrame:
    """One row: breadth, median returns, regime score and label, reference date."""
    # Weights 0.35/0.20/0.27/0.18, scales 0.055/0.11, labels at 65/55/45/35.
    stats = with_texts(profile, RETURNS).agg(
        *agg_texts(
            {
                "breadth_20d": "coalesce(avg(double(r20 > 0)), 0.5D)",
                "breadth_60d": "coalesce(avg(double(r60 > 0)), 0.5D)",
                "median_return_20d": "coalesce(median(r20), 0D)",
                "median_return_60d": "coalesce(median(r60), 0D)",
                "reference_date": "max(last_date)",
                "coverage_count": "greatest(count(r20), count(r60))",
            }
        )
    )
    total = (
        f"35 * breadth_20d + 20 * breadth_60d + 0.27D * {sigmoid('median_return_20d', 0.055)}"
        f" + 0.18D * {sigmoid('median_return_60d', 0.11)}"
    )
    stats = with_texts(stats, {"_total": total})
    scored = with_texts(stats, {"market_regime_score": f"CASE WHEN coverage_count > 0 THEN {clip('_total')} ELSE 50D END"})
    return with_texts(
        scored.drop("_total"),
        {
            "market_regime_label": "CASE WHEN coverage_count = 0 THEN 'UNKNOWN' WHEN market_regime_score >= 65 THEN 'RISK_ON'"
            " WHEN market_regime_score >= 55 THEN 'CONSTRUCTIVE' WHEN market_regime_score >= 45 THEN 'NEUTRAL'"
            " WHEN market_regime_score >= 35 THEN 'DEFENSIVE' ELSE 'RISK_OFF' END"
        },
    )


def add_market(profile: DataFrame, context: Column) -> DataFrame:
    """Relative strength of each ticker against the one-row ``context`` struct."""
    # Weights 0.55/0.30/0.15, scales 0.06/0.12.
    rows = with_texts(profile, RETURNS).withColumn("_ctx", context)
    rows = with_texts(
        rows,
        {
            "_rel20": "coalesce(r20 - _ctx.median_return_20d, 0D)",
            "_rel60": "coalesce(r60 - _ctx.median_return_60d, 0D)",
            "market_regime_score": zero_default("_ctx.market_regime_score", 50.0),
        },
    )
    total = f"0.55D * market_regime_score + 0.30D * {sigmoid('_rel20', 0.06)} + 0.15D * {sigmoid('_rel60', 0.12)}"
    return with_texts(
        rows,
        {
            "market_sector_score": held(total),
            "market_regime_label": "coalesce(_ctx.market_regime_label, 'UNKNOWN')",
            "market_breadth_20d": zero_default("_ctx.breadth_20d", 0.5),
            "market_breadth_60d": zero_default("_ctx.breadth_60d", 0.5),
            "universe_median_return_20d": "_ctx.median_return_20d * 100",
            "universe_median_return_60d": "_ctx.median_return_60d * 100",
            "relative_strength_20d_pct": "_rel20 * 100",
            "relative_strength_60d_pct": "_rel60 * 100",
            "market_context_basis": "'UNIVERSE_BREADTH_RELATIVE_STRENGTH'",
            "market_context_coverage": "coalesce(_ctx.coverage_count, 0)",
            "market_reference_date": "_ctx.reference_date",
        },
    ).drop("_ctx", "_rel20", "_rel60", "r20", "r60")
