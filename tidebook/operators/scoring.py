"""Evidence gate, blended score, phase, action and the decision guard."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidebook.config import ScanConfig
from tidebook.functions.text import clip, fixed, held, with_texts, zero_default

DIRECT, PROXY = "BROKER_DIRECT", "PRICE_PROXY"


def direct_gate(config: ScanConfig) -> str:
    """True where broker rows are complete, balanced, verified and fresh enough to count."""
    return (
        f"has_broker AND coverage_pct >= {config.direct_min_coverage_pct}D AND broker_days >= {config.minimum_broker_days}"
        f" AND distinct_brokers >= {config.direct_min_brokers}"
        f" AND broker_balance_error_pct <= {config.direct_max_balance_error_pct}D"
        f" AND broker_verified_source_pct >= {config.direct_min_verified_pct}D"
        f" AND price_data_quality_score >= {config.guard_min_price_quality}D"
        f" AND price_staleness_days <= {config.max_price_staleness_days} AND NOT split_like_event_recent"
    )


def add_effective(df: DataFrame) -> DataFrame:
    """The broker-based measure for direct rows, its price proxy for all others."""
    pairs = {
        "effective_accumulation": ("accumulation_score", "proxy_accumulation_score"),
        "effective_dominance": ("operator_dominance_score", "proxy_absorption_score"),
        "effective_supply": ("supply_concentration_score", "proxy_supply_tightness_score"),
        "effective_cost_basis": ("cost_basis_score", "50D"),
        "effective_distribution": ("distribution_risk", "proxy_distribution_risk"),
        "evidence_tier": (f"'{DIRECT}'", f"'{PROXY}'"),
    }
    return with_texts(df, {k: f"CASE WHEN direct_broker THEN {d} ELSE {p} END" for k, (d, p) in pairs.items()})


def add_score(df: DataFrame, config: ScanConfig) -> DataFrame:
    """Weighted blend, distribution and quality haircuts, stability bonus or proxy shrink."""
    # Proxy caps 82/75/75, haircuts 0.22 above 55 and 0.18 below 80,
    # bonus factors 0.04 and 4 within +-3, shrink 0.88 around 50.
    w = config.weights

    def capped(direct: str, proxy: str, cap: float) -> str:
        return f"CASE WHEN direct_broker THEN {direct} ELSE least({cap}D, {zero_default(proxy, 30.0)}) END"

    parts = [
        (capped("accumulation_score", "proxy_accumulation_score", 82.0), w.accumulation),
        (capped("operator_dominance_score", "proxy_absorption_score", 75.0), w.operator_dominance),
        ("effective_cost_basis", w.cost_basis),
        ("retail_exhaustion_score", w.retail_exhaustion),
        (zero_default("foreign_institutional_score", 50.0), w.foreign_institutional),
        (capped("supply_concentration_score", "proxy_supply_tightness_score", 75.0), w.supply_concentration),
        ("price_flow_divergence_score", w.price_flow_divergence),
        (zero_default("market_sector_score", 50.0), w.market_sector),
        ("smc_execution_score", w.smc_execution),
        ("risk_liquidity_score", w.risk_liquidity),
    ]
    blend = " + ".join(f"{text} * {weight}D" for text, weight in parts)
    risk = zero_default("effective_distribution", 50.0)
    staged = with_texts(
        df,
        {
            "_blend": f"{blend} - greatest(0D, {risk} - 55) * 0.22D"
            " - greatest(0D, 80 - price_data_quality_score) * 0.18D",
            "_bonus": held(
                f"({zero_default('accumulation_quality_score', 50.0)} - 50) * 0.04D + (broker_cohort_stability - 0.5D) * 4",
                -3.0,
                3.0,
            ),
        },
    )
    total = "CASE WHEN direct_broker THEN _blend + _bonus ELSE 50 + 0.88D * (_blend - 50) END"
    staged = with_texts(staged, {"_total": total})
    return with_texts(staged, {"score": clip("_total")}).drop("_blend", "_bonus", "_total")


def add_phase(df: DataFrame) -> DataFrame:
    # The thresholds below.
    staged = with_texts(
        df,
        {
            "_acc": "effective_accumulation",
            "_quality": "CASE WHEN accumulation_quality_score = 0 THEN effective_accumulation ELSE accumulation_quality_score END",
            "_premium": "coalesce(premium_to_cost_pct, double('-Infinity'))",
            "_ret": "coalesce(price_return_20d, 0D)",
        },
    )
    return with_texts(
        staged,
        {
            "phase": f"CASE WHEN {zero_default('effective_distribution', 50.0)} >= 65 THEN 'DISTRIBUTION'"
            " WHEN direct_broker AND _acc >= 72 AND _quality >= 68 AND broker_cohort_stability >= 0.45D"
            " AND _premium <= 12 AND _ret <= 12 THEN 'ACCUMULATION'"
            " WHEN direct_broker AND _acc >= 62 AND _quality >= 58 AND _premium <= 25 AND _ret > 0 AND _ret <= 22 THEN 'EARLY_MARKUP'"
            " WHEN direct_broker AND _acc >= 48 AND _ret > 8 THEN 'MARKUP'"
            " WHEN direct_broker AND _acc < 32 AND _ret < -8 THEN 'MARKDOWN'"
            " WHEN direct_broker THEN 'NEUTRAL'"
            " WHEN _acc >= 70 AND _ret <= 12 THEN 'ACCUMULATION' WHEN _acc >= 60 AND _ret > 0 THEN 'EARLY_MARKUP'"
            " WHEN _acc >= 45 AND _ret > 8 THEN 'MARKUP' WHEN _acc < 35 AND _ret < -8 THEN 'MARKDOWN' ELSE 'NEUTRAL' END"
        },
    ).drop("_acc", "_quality", "_premium", "_ret")


def add_action(df: DataFrame) -> DataFrame:
    # Risk 75, score floors 75, 72, 70.
    return with_texts(
        df,
        {
            "action": "CASE WHEN phase = 'DISTRIBUTION' OR effective_distribution >= 75 THEN 'REDUCE_AVOID'"
            " WHEN NOT direct_broker THEN 'RESEARCH_ONLY' WHEN phase = 'ACCUMULATION' AND score >= 75 THEN 'BUY_ON_WEAKNESS'"
            " WHEN phase = 'EARLY_MARKUP' AND score >= 72 THEN 'BUY_RETEST'"
            " WHEN phase = 'MARKUP' AND score >= 70 THEN 'HOLD_DO_NOT_CHASE' ELSE 'WATCHLIST' END"
        },
    )


def add_guard(df: DataFrame, config: ScanConfig) -> DataFrame:
    """``real_money_state`` with its reasons, then the price-quality overrides."""
    # Message texts, risk 70, score floor 65.
    cover, quality = config.guard_min_coverage_pct, config.guard_min_price_quality
    days, stale = config.minimum_broker_days, config.max_price_staleness_days
    base = [
        ("NOT direct_broker", "'direct broker evidence unavailable'"),
        (
            f"coverage_pct < {cover}D",
            f"concat('broker evidence coverage ', {fixed('coverage_pct', 1)}, '% < {cover:.0f}%')",
        ),
        (f"broker_days < {days}", f"concat('broker history ', broker_days, 'd < {days}d')"),
        ("effective_distribution >= 70", f"concat('distribution risk high (', {fixed('effective_distribution', 1)}, ')')"),
        ("score < 65", f"concat('score ', {fixed('score', 1)}, ' below decision floor')"),
    ]
    integrity = (
        f"concat('broker evidence integrity gate failed: coverage=', {fixed('coverage_pct', 0)}, '%, days=', broker_days,"
        f" ', brokers=', distinct_brokers, ', balance_error=', {fixed('broker_balance_error_pct', 1)},"
        f" '%, verified_source=', {fixed('broker_verified_source_pct', 1)}, '%')"
    )
    defects = [
        (
            f"price_data_quality_score < {quality}D",
            f"concat('price data quality ', {fixed('price_data_quality_score', 1)}, ' < {quality:.0f}')",
        ),
        (f"price_staleness_days > {stale}", f"concat('price stale ', price_staleness_days, 'd > {stale}d')"),
        (
            "split_like_event_recent",
            "concat('split/corporate-action-like gap detected on ', coalesce(string(split_like_event_date), 'unknown date'),"
            " '; post-event bars=', coalesce(string(split_like_bars_ago), 'None'))",
        ),
    ]

    def texts(rules: list[tuple[str, str]]) -> str:
        return ", ".join(f"CASE WHEN {test} THEN {text} END" for test, text in rules)

    staged = with_texts(
        df,
        {
            "_base": f"concat_ws('; ', {texts(base)})",
            "_defect": " OR ".join(f"({test})" for test, _ in defects),
        },
    )
    passed = "'direct evidence and minimum quality gates passed'"
    return with_texts(
        staged,
        {
            "real_money_state": "CASE WHEN _base = '' AND NOT _defect THEN 'ELIGIBLE' ELSE 'GUARDED' END",
            "guardrail_reason": f"concat_ws('; ', CASE WHEN _base = '' THEN {passed} ELSE _base END,"
            f" CASE WHEN NOT direct_broker AND has_broker THEN {integrity} END, {texts(defects)})",
            "action": "CASE WHEN _defect AND phase <> 'DISTRIBUTION'"
            " THEN CASE WHEN direct_broker THEN 'WATCHLIST' ELSE 'RESEARCH_ONLY' END ELSE action END",
        },
    ).drop("_base", "_defect")
