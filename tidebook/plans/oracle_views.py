"""Common table expressions of the SQL oracle, written for an ANSI SQL engine.

They restate the data views and the features independently of the Spark
operators: means are folded recursively, slopes are regressions, forward
returns are range joins, where the operators use closed forms or windows.
"""

from __future__ import annotations


def finite(x: str) -> str:
    return f"({x} IS NOT NULL AND NOT isnan({x}) AND NOT isinf({x}))"


def clip(x: str, low: float = 0.0, high: float = 100.0) -> str:
    return f"least({high}, greatest({low}, {x}))"


def score(x: str) -> str:
    return f"CASE WHEN {finite(f'({x})')} THEN {clip(f'({x})')} ELSE 50.0 END"


def sigmoid(x: str, scale: float) -> str:
    return f"CASE WHEN {finite(f'({x})')} THEN 100.0 / (1.0 + exp(-{clip(f'(({x}) / {scale})', -12.0, 12.0)})) ELSE 50.0 END"


def zero_default(x: str, default: float) -> str:
    return f"(CASE WHEN {x} IS NULL OR {x} = 0 THEN {default} ELSE {x} END)"


def even(x: str, digits: int) -> str:
    scale = 10**digits
    return f"(round_even(CAST(({x}) AS DOUBLE) * {scale}, 0) / {scale})"


def text(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', CAST({even(x, digits)} AS DOUBLE))"


NEAREST = (
    "CASE WHEN r <= 0.15 THEN 0.1 WHEN r <= 0.225 THEN 0.2 WHEN r <= (0.25 + 1.0 / 3) / 2 THEN 0.25"
    " WHEN r <= (1.0 / 3 + 0.5) / 2 THEN CAST(1 AS DOUBLE) / 3 WHEN r <= 1.25 THEN 0.5 WHEN r <= 2.5 THEN 2.0 WHEN r <= 3.5 THEN 3.0"
    " WHEN r <= 4.5 THEN 4.0 WHEN r <= 7.5 THEN 5.0 ELSE 10.0 END"
)


def _bars(price: str) -> str:
    return f"""
SELECT ticker, date, first(price ORDER BY k) AS open, max(price) AS high, min(price) AS low,
       last(price ORDER BY k) AS close, sum(qty) AS volume, sum(price * qty) AS traded_value
FROM (SELECT upper(replace(p_brand, '#', '')) AS ticker, CAST(l_shipdate AS DATE) AS date,
             round({price} * 1000.0) AS price, l_quantity AS qty,
             row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k
      FROM lineitem JOIN part ON l_partkey = p_partkey)
GROUP BY ticker, date"""


def _broker(verified: str) -> str:
    return f"""
SELECT ticker, trade_date, participant AS broker_code, source, verified AS source_verified,
       sum(bv) AS buy_volume, sum(bx) AS buy_value, sum(sv) AS sell_volume, sum(sx) AS sell_value,
       sum(bv) - sum(sv) AS net_volume, sum(bx) - sum(sx) AS net_value, sum(bx) + sum(sx) AS gross_value,
       sum(bx) / nullif(sum(bv), 0) AS buy_avg, sum(sx) / nullif(sum(sv), 0) AS sell_avg, 'RG' AS market_type
FROM (SELECT ticker, trade_date, participant, bv, bx, sv, sx, {verified} AS verified,
             CASE WHEN line_status = 'F' THEN 'DIRECT' ELSE 'VENDOR' END AS source FROM legs)
GROUP BY ALL"""


def _positions(bars: str) -> str:
    return f"""
SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn,
       row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos,
       count(*) OVER (PARTITION BY ticker) AS n,
       lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev_close,
       lag(high, 2) OVER (PARTITION BY ticker ORDER BY date) AS high_2_back
FROM {bars}"""


def _quality(positions: str, reference: str) -> str:
    return f"""
SELECT s.*, CAST(100.0 - least(55.0, 10.0 * price_staleness_days) - greatest(0, zero_volume_ratio_20d - 0.20) * 45
       - greatest(0, unchanged_close_ratio_20d - 0.45) * 35 - least(35.0, ohlc_geometry_error_ratio * 100)
       - CASE WHEN split_like_event_recent THEN 30 * (1 - {clip('split_like_bars_ago / 60.0', 0.0, 1.0)}) ELSE 0 END AS DOUBLE) AS raw_quality,
       {clip('raw_quality')} AS price_data_quality_score
FROM (
  SELECT b.ticker, greatest(date_diff('day', last_date, {reference}), 0) AS price_staleness_days,
         zero AS zero_volume_ratio_20d, unchanged AS unchanged_close_ratio_20d, bad AS ohlc_geometry_error_ratio,
         e.ticker IS NOT NULL AS split_like_event_detected, coalesce(bars_ago < 60, FALSE) AS split_like_event_recent,
         e.date AS split_like_event_date, factor AS split_like_factor, bars_ago AS split_like_bars_ago
  FROM (SELECT ticker, max(date) AS last_date,
               avg(CASE WHEN rn <= 20 THEN CASE WHEN volume <= 0 THEN 1.0 ELSE 0.0 END END) AS zero,
               sum(CASE WHEN rn < 20 AND close = prev_close THEN 1.0 ELSE 0.0 END) / sum(CASE WHEN rn <= 20 THEN 1 END) AS unchanged,
               avg(CASE WHEN rn <= 60 THEN CASE WHEN high < greatest(open, close) OR low > least(open, close) OR high < low OR close <= 0
                                                 THEN 1.0 ELSE 0.0 END END) AS bad
        FROM {positions} GROUP BY ticker) b
  LEFT JOIN (SELECT ticker, date, factor, rn - 1 AS bars_ago
             FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY rn) AS hit
                   FROM (SELECT *, {NEAREST} AS factor FROM (SELECT *, open / nullif(prev_close, 0) AS r FROM {positions} WHERE rn < 120))
                   WHERE abs(r - 1) >= 0.35 AND abs(r - factor) / factor <= 0.06 AND abs(close / nullif(open, 0) - 1) <= 0.25)
             WHERE hit = 1) e ON e.ticker = b.ticker) s"""


def _ema(length: int) -> str:
    a = 2.0 / (length + 1)
    return f"list_reduce(closes, lambda m, x: m * {1 - a} + x * {a})"


def _ema_before(length: int) -> str:
    a = 2.0 / (length + 1)
    return f"list_reduce(closes[1:len(closes) - 5], lambda m, x: m * {1 - a} + x * {a})"


def _outcomes(signals: str, bars: str) -> str:
    return f"""
SELECT s.run_id, s.ticker, s.as_of_date, entry_close,
       CASE WHEN NOT gap THEN 100.0 * (c5 / entry_close - 1) END AS return_5d,
       CASE WHEN NOT gap THEN 100.0 * (c20 / entry_close - 1) END AS return_20d,
       CASE WHEN NOT gap THEN 100.0 * (c60 / entry_close - 1) END AS return_60d,
       CASE WHEN NOT gap THEN 100.0 * (h20 / entry_close - 1) END AS mfe_20d,
       CASE WHEN NOT gap THEN 100.0 * (l20 / entry_close - 1) END AS mae_20d,
       evaluated_through,
       CASE WHEN entry_close IS NULL THEN 'PENDING' WHEN gap THEN 'EXCLUDED' WHEN c60 IS NOT NULL THEN 'COMPLETE'
            WHEN c5 IS NOT NULL OR c20 IS NOT NULL THEN 'PARTIAL' ELSE 'PENDING' END AS evaluation_status,
       CASE WHEN gap THEN 'CORPORATE_ACTION_LIKE_GAP_IN_FORWARD_WINDOW' END AS evaluation_note
FROM {signals} s LEFT JOIN (
  SELECT run_id, ticker, max(CASE WHEN rn = 1 THEN close END) AS entry_close, max(CASE WHEN rn = 6 THEN close END) AS c5,
         max(CASE WHEN rn = 21 THEN close END) AS c20, max(CASE WHEN rn = 61 THEN close END) AS c60,
         max(CASE WHEN rn BETWEEN 2 AND 21 THEN high END) AS h20, min(CASE WHEN rn BETWEEN 2 AND 21 THEN low END) AS l20,
         bool_or(rn BETWEEN 2 AND 61 AND prev > 0 AND open > 0 AND abs(open / prev - 1) >= 0.35 AND abs(close / open - 1) <= 0.25
                 AND least(abs(open / prev - 0.1) / 0.1, abs(open / prev - 0.2) / 0.2, abs(open / prev - 0.25) / 0.25,
                           abs(open / prev - 1.0 / 3) / (1.0 / 3), abs(open / prev - 0.5) / 0.5, abs(open / prev - 2) / 2,
                           abs(open / prev - 3) / 3, abs(open / prev - 4) / 4, abs(open / prev - 5) / 5, abs(open / prev - 10) / 10) <= 0.06) AS gap,
         max(date) AS evaluated_through
  FROM (SELECT x.run_id, b.*, row_number() OVER (PARTITION BY x.run_id, x.ticker ORDER BY b.date) AS rn,
               lag(b.close) OVER (PARTITION BY x.run_id, x.ticker ORDER BY b.date) AS prev
        FROM {signals} x JOIN {bars} b ON b.ticker = x.ticker AND b.date >= x.as_of_date
        WHERE EXISTS (SELECT 1 FROM {bars} e WHERE e.ticker = x.ticker AND e.date = x.as_of_date))
  GROUP BY run_id, ticker) a ON a.run_id = s.run_id AND a.ticker = s.ticker"""


def _scores(broker: str, context: str = "") -> str:
    """Score columns from the joined feature row ``f``."""
    acc = "CASE WHEN direct THEN accumulation_score ELSE proxy_accumulation_score END"
    return f"""
SELECT *, CASE WHEN direct THEN 'BROKER_DIRECT' ELSE 'PRICE_PROXY' END AS evidence_tier, {acc} AS eff_acc,
       CASE WHEN direct THEN operator_dominance_score ELSE proxy_absorption_score END AS eff_dom,
       CASE WHEN direct THEN supply_concentration_score ELSE proxy_supply_tightness_score END AS eff_sup,
       CASE WHEN direct THEN cost_basis_score ELSE 50.0 END AS eff_cost,
       CASE WHEN direct THEN distribution_risk ELSE proxy_distribution_risk END AS eff_dist
FROM {broker}"""


BROKER_EMPTY = {
    "broker_days": "0",
    "distinct_brokers": "0",
    "coverage_pct": "0.0",
    "accumulation_score": "0.0",
    "accumulation_quality_score": "0.0",
    "operator_dominance_score": "0.0",
    "supply_concentration_score": "0.0",
    "cost_basis_score": "0.0",
    "cost_position": "'UNKNOWN'",
    "distribution_risk": "50.0",
    "net_value_5d": "0.0",
    "net_value_20d": "0.0",
    "net_value_60d": "0.0",
    "persistence_5d": "0.0",
    "persistence_20d": "0.0",
    "persistence_60d": "0.0",
    "broker_cohort_stability": "0.0",
    "broker_hhi": "0.0",
    "net_conversion_ratio": "0.0",
    "reversal_ratio_5d": "0.0",
    "broker_balance_error_pct": "100.0",
    "broker_verified_source_pct": "0.0",
}


def _broker_features(rows: str, bars_pos: str) -> str:
    windows = ", ".join(
        f"sum(CASE WHEN dr <= {w} THEN net_value ELSE 0 END) AS net_{w}, "
        f"count(DISTINCT CASE WHEN dr <= {w} THEN trade_date END) AS days_{w}"
        for w in (5, 20, 60)
    )
    ranks = ", ".join(
        f"row_number() OVER (PARTITION BY ticker ORDER BY CASE WHEN net_{w} > 0 THEN net_{w} END DESC NULLS LAST, broker_code) AS rk_{w}"
        for w in (5, 20, 60)
    )
    flags = ", ".join(f"(net_{w} > 0 AND rk_{w} <= 5) AS in_{w}" for w in (5, 20, 60))
    pers = ", ".join(
        f"coalesce(sum(CASE WHEN in_{w} THEN net_{w} * up_{w} / days_{w} END) / nullif(sum(CASE WHEN in_{w} THEN net_{w} END), 0), 0) AS persistence_{w}d,"
        f" coalesce(sum(CASE WHEN in_{w} THEN net_{w} END), 0) AS net_value_{w}d"
        for w in (5, 20, 60)
    )
    return f"""
SELECT m.*,
  {score('0.58 * quality + 0.22 * 100 * persistence_20d + 0.20 * intensity')} AS accumulation_score, quality AS accumulation_quality_score,
  {score('0.45 * conc_s + 0.30 * hhi_s + 0.25 * 100 * broker_cohort_stability')} AS operator_dominance_score,
  {score('0.60 * conc_s + 0.40 * hhi_s')} AS supply_concentration_score,
  CASE WHEN premium_to_cost_pct IS NULL THEN 35.0 WHEN premium_to_cost_pct <= -5 THEN 95.0 WHEN premium_to_cost_pct <= 5 THEN 92.0
       WHEN premium_to_cost_pct <= 15 THEN 82.0 WHEN premium_to_cost_pct <= 30 THEN 62.0 WHEN premium_to_cost_pct <= 35 THEN 45.0 ELSE 20.0 END AS cost_basis_score,
  CASE WHEN premium_to_cost_pct IS NULL THEN 'UNKNOWN' WHEN premium_to_cost_pct <= -5 THEN 'UNDER_COST' WHEN premium_to_cost_pct <= 5 THEN 'NEAR_COST'
       WHEN premium_to_cost_pct <= 15 THEN 'HEALTHY_MARKUP' WHEN premium_to_cost_pct <= 30 THEN 'MARKUP' WHEN premium_to_cost_pct <= 35 THEN 'EXTENDED'
       ELSE 'OVEREXTENDED' END AS cost_position,
  {score(f"62.0 * reversal_ratio_5d + 23.0 * coalesce({clip('(premium_to_cost_pct - 20.0) / 30.0', 0.0, 1.0)}, 0) * CASE WHEN premium_to_cost_pct IS NULL THEN 0 ELSE 1 END + 15.0 * (1.0 - broker_cohort_stability)")} AS distribution_risk
FROM (
  SELECT k.*, {sigmoid('net_value_20d / greatest(turnover, 1.0) - 0.08', 0.05)} AS intensity,
    {score('100.0 * CASE WHEN pos_20 > 0 THEN net_value_20d / pos_20 ELSE 0 END')} AS conc_s, {score('100.0 * sqrt(broker_hhi)')} AS hhi_s,
    {clip('0.6 * over5 + 0.4 * coalesce(over60, over5)', 0.0, 1.0)} AS broker_cohort_stability,
    {score(f"0.34 * 100 * persistence_20d + 0.24 * intensity + 0.18 * 100 * broker_cohort_stability + 0.14 * conc_s + 0.10 * {clip('100.0 * least(net_conversion_ratio / 0.35, 1.0)')}")} AS quality,
    100.0 * (last_close / estimated_smart_money_cost - 1) AS premium_to_cost_pct
  FROM (
    SELECT g.*, px.last_close, 100.0 * coalesce(cov.hits, 0) / px.sessions AS coverage_pct, ad.broker_days, ad.broker_verified_source_pct,
      (buy_20 + sell_20) / 2 AS turnover, pos_20 / greatest((buy_20 + sell_20) / 2, 1.0) AS net_conversion_ratio,
      100.0 * abs(buy_20 - sell_20) / greatest((buy_20 + sell_20) / 2, 1.0) AS broker_balance_error_pct,
      CASE WHEN pos_20 > 0 THEN possq_20 / (pos_20 * pos_20) ELSE 0 END AS broker_hhi,
      shared_5_20 / greatest(members_20, 1) AS over5, CASE WHEN members_60 > 0 THEN shared_20_60 / greatest(members_20, 1) END AS over60,
      cost_v / nullif(cost_n, 0) AS estimated_smart_money_cost, reversed_5 / greatest(net_value_20d, 1.0) AS reversal_ratio_5d
    FROM (
      SELECT ticker, count(*) AS distinct_brokers, {pers},
        sum(buy_20) AS buy_20, sum(sell_20) AS sell_20, sum(CASE WHEN net_20 > 0 THEN net_20 ELSE 0 END) AS pos_20,
        sum(CASE WHEN net_20 > 0 THEN net_20 * net_20 ELSE 0 END) AS possq_20, count(CASE WHEN in_20 THEN 1 END) AS members_20,
        count(CASE WHEN in_60 THEN 1 END) AS members_60, count(CASE WHEN in_20 AND in_5 THEN 1 END) AS shared_5_20,
        count(CASE WHEN in_20 AND in_60 THEN 1 END) AS shared_20_60, coalesce(sum(CASE WHEN in_20 THEN cost_v END), 0) AS cost_v,
        coalesce(sum(CASE WHEN in_20 THEN cost_n END), 0) AS cost_n,
        sum(CASE WHEN in_20 AND net_5 < 0 THEN least(-net_5, net_20) ELSE 0 END) AS reversed_5,
        coalesce(string_agg(CASE WHEN in_20 THEN broker_code END, ',' ORDER BY rk_20), '') AS top_accumulating_brokers,
        coalesce(string_agg(CASE WHEN net_20 < 0 AND rs_20 <= 5 THEN broker_code END, ',' ORDER BY rs_20), '') AS top_distributing_brokers
      FROM (SELECT *, {flags} FROM (
        SELECT *, {ranks}, row_number() OVER (PARTITION BY ticker ORDER BY CASE WHEN net_20 < 0 THEN net_20 END NULLS LAST, broker_code) AS rs_20
        FROM (
          SELECT b.*, u.up_5, u.up_20, u.up_60 FROM (
            SELECT ticker, broker_code, {windows},
              sum(CASE WHEN dr <= 20 THEN buy_value ELSE 0 END) AS buy_20, sum(CASE WHEN dr <= 20 THEN sell_value ELSE 0 END) AS sell_20,
              sum(CASE WHEN dr <= 60 AND net_volume > 0 AND buy_avg > 0 THEN net_volume * buy_avg ELSE 0 END) AS cost_v,
              sum(CASE WHEN dr <= 60 AND net_volume > 0 AND buy_avg > 0 THEN net_volume ELSE 0 END) AS cost_n
            FROM (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY trade_date DESC) AS dr FROM {rows}) GROUP BY ticker, broker_code) b
          JOIN (SELECT ticker, broker_code, count(CASE WHEN dr <= 5 AND net > 0 THEN 1 END) AS up_5, count(CASE WHEN dr <= 20 AND net > 0 THEN 1 END) AS up_20,
                       count(CASE WHEN dr <= 60 AND net > 0 THEN 1 END) AS up_60
                FROM (SELECT ticker, broker_code, trade_date, net, dense_rank() OVER (PARTITION BY ticker ORDER BY trade_date DESC) AS dr
                      FROM (SELECT ticker, broker_code, trade_date, sum(net_value) AS net FROM {rows} GROUP BY ALL))
                GROUP BY ticker, broker_code) u ON u.ticker = b.ticker AND u.broker_code = b.broker_code)))
      GROUP BY ticker) g
    JOIN (SELECT ticker, max(CASE WHEN rn = 1 THEN close END) AS last_close, count(CASE WHEN rn <= 20 THEN 1 END) AS sessions FROM {bars_pos} GROUP BY ticker) px ON px.ticker = g.ticker
    JOIN (SELECT ticker, count(DISTINCT trade_date) AS broker_days,
                 100.0 * sum(CASE WHEN source_verified THEN gross_value ELSE 0 END) / sum(gross_value) AS broker_verified_source_pct
          FROM {rows} GROUP BY ticker) ad ON ad.ticker = g.ticker
    LEFT JOIN (SELECT p.ticker, count(DISTINCT p.date) AS hits FROM {bars_pos} p JOIN {rows} r ON r.ticker = p.ticker AND r.trade_date = p.date
               WHERE p.rn <= 20 GROUP BY p.ticker) cov ON cov.ticker = g.ticker) k) m"""


def _scan(features: str, keep_context: bool = True) -> str:
    """Score, phase, action and guard from one joined feature row per ticker."""
    return f"""
SELECT z.*,
  CASE WHEN base_reason = '' AND NOT defect THEN 'ELIGIBLE' ELSE 'GUARDED' END AS real_money_state,
  concat_ws('; ', CASE WHEN base_reason = '' THEN 'direct evidence and minimum quality gates passed' ELSE base_reason END,
    CASE WHEN NOT direct AND has_broker THEN 'broker evidence integrity gate failed: coverage=' || {text('coverage_pct', 0)} || '%, days=' || broker_days || ', brokers=' || distinct_brokers
         || ', balance_error=' || {text('broker_balance_error_pct', 1)} || '%, verified_source=' || {text('broker_verified_source_pct', 1)} || '%' END,
    CASE WHEN price_data_quality_score < 70 THEN 'price data quality ' || {text('price_data_quality_score', 1)} || ' < 70' END,
    CASE WHEN price_staleness_days > 3 THEN 'price stale ' || price_staleness_days || 'd > 3d' END,
    CASE WHEN split_like_event_recent THEN 'split/corporate-action-like gap detected on ' || strftime(split_like_event_date, '%Y-%m-%d') || '; post-event bars=' || split_like_bars_ago END
  ) AS guardrail_reason,
  CASE WHEN defect AND phase <> 'DISTRIBUTION' THEN CASE WHEN direct THEN 'WATCHLIST' ELSE 'RESEARCH_ONLY' END ELSE raw_action END AS action
FROM (
 SELECT y.*,
  CASE WHEN phase = 'DISTRIBUTION' OR eff_dist >= 75 THEN 'REDUCE_AVOID' WHEN NOT direct THEN 'RESEARCH_ONLY'
       WHEN phase = 'ACCUMULATION' AND score >= 75 THEN 'BUY_ON_WEAKNESS' WHEN phase = 'EARLY_MARKUP' AND score >= 72 THEN 'BUY_RETEST'
       WHEN phase = 'MARKUP' AND score >= 70 THEN 'HOLD_DO_NOT_CHASE' ELSE 'WATCHLIST' END AS raw_action,
  concat_ws('; ', CASE WHEN NOT direct THEN 'direct broker evidence unavailable' END,
    CASE WHEN coverage_pct < 80 THEN 'broker evidence coverage ' || {text('coverage_pct', 1)} || '% < 80%' END,
    CASE WHEN broker_days < 10 THEN 'broker history ' || broker_days || 'd < 10d' END,
    CASE WHEN eff_dist >= 70 THEN 'distribution risk high (' || {text('eff_dist', 1)} || ')' END,
    CASE WHEN score < 65 THEN 'score ' || {text('score', 1)} || ' below decision floor' END) AS base_reason,
  price_data_quality_score < 70 OR price_staleness_days > 3 OR split_like_event_recent AS defect
 FROM (
  SELECT x.*,
   {clip("CASE WHEN direct THEN blended + " + clip("(" + zero_default('accumulation_quality_score', 50.0) + " - 50) * 0.04 + (broker_cohort_stability - 0.5) * 4", -3.0, 3.0) + " ELSE 50.0 + 0.88 * (blended - 50.0) END")} AS score,
   CASE WHEN {zero_default('eff_dist', 50.0)} >= 65 THEN 'DISTRIBUTION'
     WHEN direct THEN CASE
       WHEN eff_acc >= 72 AND q >= 68 AND broker_cohort_stability >= 0.45 AND coalesce(premium_to_cost_pct, -1e9) <= 12 AND price_return_20d <= 12 THEN 'ACCUMULATION'
       WHEN eff_acc >= 62 AND q >= 58 AND coalesce(premium_to_cost_pct, -1e9) <= 25 AND price_return_20d > 0 AND price_return_20d <= 22 THEN 'EARLY_MARKUP'
       WHEN eff_acc >= 48 AND price_return_20d > 8 THEN 'MARKUP' WHEN eff_acc < 32 AND price_return_20d < -8 THEN 'MARKDOWN' ELSE 'NEUTRAL' END
     WHEN eff_acc >= 70 AND price_return_20d <= 12 THEN 'ACCUMULATION' WHEN eff_acc >= 60 AND price_return_20d > 0 THEN 'EARLY_MARKUP'
     WHEN eff_acc >= 45 AND price_return_20d > 8 THEN 'MARKUP' WHEN eff_acc < 35 AND price_return_20d < -8 THEN 'MARKDOWN' ELSE 'NEUTRAL' END AS phase
  FROM (
   SELECT w.*, CASE WHEN accumulation_quality_score = 0 THEN eff_acc ELSE accumulation_quality_score END AS q,
     CASE WHEN direct THEN accumulation_score ELSE least(82.0, {zero_default('proxy_accumulation_score', 30.0)}) END * 0.25
     + CASE WHEN direct THEN operator_dominance_score ELSE least(75.0, {zero_default('proxy_absorption_score', 30.0)}) END * 0.15
     + eff_cost * 0.10 + retail_exhaustion_score * 0.10 + {zero_default('foreign_institutional_score', 50.0)} * 0.10
     + CASE WHEN direct THEN supply_concentration_score ELSE least(75.0, {zero_default('proxy_supply_tightness_score', 30.0)}) END * 0.08
     + price_flow_divergence_score * 0.07 + {zero_default('market_sector_score', 50.0)} * 0.05 + smc_execution_score * 0.05 + risk_liquidity_score * 0.05
     - greatest(0.0, {zero_default('eff_dist', 50.0)} - 55) * 0.22 - greatest(0.0, 80 - price_data_quality_score) * 0.18 AS blended
   FROM ({_scores('(SELECT * FROM ' + features + ')')}) w) x) y) z"""


def _features(broker: str | None, quality: str, source: str = "foreign_features", names: str | None = None) -> str:
    """Joined feature row per ticker with at least 80 bars; broker counts only behind the gate."""
    if broker is None:
        cols = ", ".join(f"{v} AS {k}" for k, v in BROKER_EMPTY.items())
        gate = f"SELECT f.*, {cols}, NULL AS estimated_smart_money_cost, NULL AS premium_to_cost_pct, FALSE AS has_broker, FALSE AS direct"
        join = ""
    else:
        gate = (
            "SELECT f.*, b.* EXCLUDE (ticker), TRUE AS has_broker, coverage_pct >= 70 AND broker_days >= 10 AND distinct_brokers >= 6 AND broker_balance_error_pct <= 10"
            " AND broker_verified_source_pct >= 95 AND price_data_quality_score >= 70 AND price_staleness_days <= 3 AND NOT split_like_event_recent AS direct"
        )
        join = f"JOIN {broker} b ON b.ticker = f.ticker"
    where = f"AND ticker IN (SELECT ticker FROM {names})" if names else ""
    return f"""
SELECT g.* EXCLUDE (retail_exhaustion_score, price_flow_divergence_score),
  CASE WHEN direct THEN {score('retail_raw + 20.0 * persistence_20d')} ELSE retail_exhaustion_score END AS retail_exhaustion_score,
  CASE WHEN direct THEN {score('50.0 + 0.45 * (accumulation_score - 50.0) - 150.0 * p20')} ELSE price_flow_divergence_score END AS price_flow_divergence_score
FROM ({gate}
  FROM (SELECT p.*, s.* EXCLUDE (ticker), q.* EXCLUDE (ticker), m.* EXCLUDE (ticker), ff.* EXCLUDE (ticker), n.bars, n.last_date
        FROM price_flow p JOIN structure s USING (ticker) JOIN {quality} q USING (ticker) JOIN market m USING (ticker) JOIN {source} ff USING (ticker)
        JOIN (SELECT ticker, count(*) AS bars, max(date) AS last_date FROM bars GROUP BY ticker) n USING (ticker)
        WHERE n.bars >= 80 {where}) f {join}) g"""


CTES: dict[str, str] = {
    "trades": """
SELECT upper(replace(p_brand, '#', '')) AS ticker, CAST(l_shipdate AS DATE) AS trade_date, 'N' || c_nationkey AS participant_buy,
       'N' || s_nationkey AS participant_sell, l_quantity AS volume, round(p_retailprice * (1.0 - l_discount) * 1000.0) * l_quantity AS value,
       l_linestatus AS line_status, l_returnflag AS return_flag, c_nationkey, s_nationkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "legs": """
SELECT ticker, trade_date, participant_buy AS participant, volume AS bv, value AS bx, 0.0 AS sv, 0.0 AS sx, line_status, return_flag FROM trades
UNION ALL SELECT ticker, trade_date, participant_sell, 0.0, 0.0, volume, value, line_status, return_flag FROM trades""",
    "flow": """
SELECT ticker, trade_date, participant, sum(bv) AS buy_volume, sum(bx) AS buy_value, sum(sv) AS sell_volume, sum(sx) AS sell_value,
       sum(bv) - sum(sv) AS net_volume, sum(bx) - sum(sx) AS net_value, sum(bx) / nullif(sum(bv), 0) AS buy_avg, sum(sx) / nullif(sum(sv), 0) AS sell_avg
FROM legs GROUP BY ALL""",
    "top10": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, trade_date, side ORDER BY abs(net_value) DESC, participant) AS flow_rank
  FROM (SELECT *, CASE WHEN net_value > 0 THEN 'TOP_NET_BUYER' ELSE 'TOP_NET_SELLER' END AS side,
               CASE WHEN net_value < 0 THEN size_rank END AS sell_rank
        FROM (SELECT *, row_number() OVER (PARTITION BY ticker, trade_date ORDER BY net_value DESC, participant) AS net_rank,
                     row_number() OVER (PARTITION BY ticker, trade_date ORDER BY abs(net_value) DESC, participant) AS size_rank FROM flow)
        WHERE net_value <> 0)) WHERE flow_rank <= 10""",
    "bars": _bars("(p_retailprice * (1.0 - l_discount))"),
    "bars_rough": _bars("(l_extendedprice / l_quantity)"),
    "broker": _broker("return_flag <> 'R'"),
    "broker_v": _broker("TRUE"),
    "foreign_flows": """
SELECT ticker, trade_date, CASE WHEN line_status = 'F' THEN 'IDX_OFFICIAL_STOCK_SUMMARY' ELSE 'ZAPI_IDX_FOREIGN_FLOW' END AS source,
       coalesce(sum(CASE WHEN b.n_regionkey <> s.n_regionkey AND b.n_regionkey = 0 THEN volume END), 0.0) AS foreign_buy,
       coalesce(sum(CASE WHEN b.n_regionkey <> s.n_regionkey AND s.n_regionkey = 0 THEN volume END), 0.0) AS foreign_sell,
       sum(volume) AS volume, foreign_buy - foreign_sell AS foreign_net
FROM trades JOIN nation b ON b.n_nationkey = c_nationkey JOIN nation s ON s.n_nationkey = s_nationkey GROUP BY ticker, trade_date, 3""",
    "universe": "SELECT upper(replace(p_brand, '#', '')) AS ticker, min(p_partkey) AS position FROM part GROUP BY 1",
    "signals": "SELECT 'R' || n AS run_id, ticker, date AS as_of_date FROM (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM bars)",
    "signals_rough": "SELECT 'R' || n AS run_id, ticker, date AS as_of_date FROM (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM bars_rough)",
    "runs": """
SELECT event_id AS id, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'RUNNING' WHEN event_type = 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS status,
       CAST(floor(value) AS INTEGER) AS processed_count, 0 AS error_count, ts - INTERVAL 10 MINUTE AS started_at,
       CASE WHEN event_id % 7 <> 0 THEN ts END AS heartbeat_at, CAST(NULL AS TIMESTAMP) AS completed_at, 'T' || event_id AS current_ticker,
       CASE WHEN user_id % 5 = 0 THEN '' ELSE 'S' || user_id END AS universe_signature, CASE WHEN event_id % 11 = 0 THEN '0.1.2' ELSE '0.3.0' END AS version
FROM events""",
    "pos": _positions("bars"),
    "pos_rough": _positions("bars_rough"),
    "price_flow": f"""
SELECT ticker, retail_raw, p20,
  {score('retail_raw')} AS retail_exhaustion_score, {score('50.0 + 0.45 * (proxy_accumulation_score - 50.0) - 150.0 * p20')} AS price_flow_divergence_score,
  {score(f"0.6 * ({sigmoid('log10(greatest(adv, 1.0)) - 8.3', 0.7)}) + 0.4 * (CASE WHEN vol20 IS NULL THEN 50.0 ELSE {clip('100.0 - 1200.0 * greatest(vol20 - 0.02, 0.0)')} END)")} AS risk_liquidity_score,
  p20 * 100.0 AS price_return_20d, vol20 AS realized_vol_20d, adv AS avg_traded_value_20d, proxy_accumulation_score, abs_score AS proxy_absorption_score,
  {score('40.0 * tight + 35.0 * acceptance + 100.0 * absorption')} AS proxy_supply_tightness_score,
  {score('50.0 + 40.0 * greatest(-cmf, 0.0) + 22.0 * greatest(-obv, 0.0) + 100.0 * greatest(-p20 - 0.08, 0.0) - 25.0 * absorption')} AS proxy_distribution_risk,
  cmf AS proxy_cmf20, obv AS proxy_obv_slope_norm20, up AS proxy_up_value_ratio20, acceptance AS proxy_close_acceptance20, absorption AS proxy_absorption_ratio20
FROM (SELECT *, {score('0.30 * (' + sigmoid('cmf', 0.08) + ') + 0.24 * (' + sigmoid('obv', 0.25) + ') + 0.20 * (' + score('up * 100.0') + ') + 0.14 * (' + score('acceptance * 100.0') + ') + 0.12 * abs_score')} AS proxy_accumulation_score,
        45.0 * {clip('1.0 - abs(p20) / 0.12', 0.0, 1.0)} + 25.0 * tight + 10.0 * abs_score / 100.0 AS retail_raw
 FROM (SELECT *, greatest(squeeze, 0.0) AS tight, {score('35.0 + 180.0 * absorption + 20.0 * greatest(squeeze, 0.0)')} AS abs_score
 FROM (SELECT *, CASE WHEN vol20 IS NOT NULL AND vol60 > 0 THEN {clip('1.0 - vol20 / vol60', -1.0, 1.0)} ELSE 0.5 END AS squeeze
 FROM (SELECT ticker, max(CASE WHEN rn = 1 THEN close END) / max(CASE WHEN rn = 20 THEN close END) - 1 AS p20,
    CASE WHEN count(CASE WHEN rn <= 20 THEN ret END) >= 10 THEN stddev_pop(CASE WHEN rn <= 20 THEN ret END) END AS vol20,
    CASE WHEN count(CASE WHEN rn <= 60 THEN ret END) >= 20 THEN stddev_pop(CASE WHEN rn <= 60 THEN ret END) ELSE vol20 END AS vol60,
    coalesce(sum(CASE WHEN rn <= 20 THEN mfm * volume END) / nullif(sum(CASE WHEN rn <= 20 THEN volume END), 0), 0.0) AS cmf,
    coalesce(regr_slope(CASE WHEN rn <= 20 THEN obv END, CASE WHEN rn <= 20 THEN 20 - rn END) / nullif(avg(CASE WHEN rn <= 20 THEN volume END), 0), 0.0) AS obv,
    coalesce(sum(CASE WHEN rn <= 20 AND ret > 0 THEN close * volume ELSE 0 END) / nullif(sum(CASE WHEN rn <= 20 THEN close * volume END), 0), 0.5) AS up,
    avg(CASE WHEN rn <= 20 THEN CASE WHEN abs(ret) <= 0.02 AND volume >= 1.25 * greatest(mean20, 1.0) AND close_pos >= 0.55 THEN 1.0 ELSE 0.0 END END) AS absorption,
    avg(CASE WHEN rn <= 20 THEN close_pos END) AS acceptance, avg(CASE WHEN rn <= 20 THEN close * volume END) AS adv
 FROM (SELECT *, close / prev_close - 1 AS ret,
         sum(sign(coalesce(close / prev_close - 1, 0)) * volume) OVER (PARTITION BY ticker ORDER BY date) AS obv,
         coalesce((close - low) / nullif(high - low, 0), 0.5) AS close_pos, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0.0) AS mfm,
         avg(CASE WHEN rn <= 20 THEN volume END) OVER (PARTITION BY ticker) AS mean20 FROM pos)
 GROUP BY ticker))))""",
    "structure": f"""
SELECT ticker, bos, choch, liquidity_sweep, fvg_low, fvg_high, ema20, ema50, valid AS execution_geometry_valid,
  CASE WHEN valid THEN elow END AS entry_low, CASE WHEN valid THEN ehigh END AS entry_high, CASE WHEN valid THEN stop END AS invalidation,
  CASE WHEN valid THEN tp1 END AS tp1, CASE WHEN valid THEN tp2 END AS tp2, CASE WHEN valid THEN raw_score ELSE least(raw_score, 25.0) END AS smc_execution_score
FROM (SELECT *, mid + 2.0 * risk AS tp1, mid + 3.2 * risk AS tp2, risk > 0 AND ehigh > elow AND stop < elow AND tp1 > ehigh AND tp2 > tp1 AS valid,
        least(100.0, 35.0 + 20.0 * CAST(trend AS INT) + 20.0 * CAST(liquidity_sweep AS INT) + 15.0 * CAST(choch AS INT) + 10.0 * CAST(bos AS INT)
              + CASE WHEN fvg_low IS NOT NULL THEN 5.0 ELSE 0.0 END) AS raw_score
 FROM (SELECT *, (elow + ehigh) / 2 AS mid, least(prev5, elow - 0.8 * atr) AS stop, greatest((elow + ehigh) / 2 - least(prev5, elow - 0.8 * atr), 0.5 * atr) AS risk
  FROM (SELECT *, CASE WHEN fvg_high <= 1.08 * close AND fvg_low >= 0.75 * close THEN fvg_low ELSE close - 0.35 * atr END AS elow,
          CASE WHEN fvg_high <= 1.08 * close AND fvg_low >= 0.75 * close THEN fvg_high ELSE close + 0.15 * atr END AS ehigh,
          ema20 >= ema50 AS trend, ema20 >= ema50 AND NOT ema20_6 >= ema50_6 AS choch, close > prev20 AS bos, low < prev5 AND close > prev5 AS liquidity_sweep
   FROM (SELECT a.*, g.fvg_low, g.fvg_high, {_ema(20)} AS ema20, {_ema(50)} AS ema50, {_ema_before(20)} AS ema20_6, {_ema_before(50)} AS ema50_6
     FROM (SELECT ticker, max(CASE WHEN rn = 1 THEN close END) AS close, max(CASE WHEN rn = 1 THEN low END) AS low,
             avg(CASE WHEN rn <= 14 THEN greatest(abs(high - low), abs(high - prev_close), abs(low - prev_close)) END) AS atr,
             max(CASE WHEN rn BETWEEN 2 AND 21 THEN high END) AS prev20, min(CASE WHEN rn BETWEEN 2 AND 6 THEN low END) AS prev5, list(close ORDER BY date) AS closes
           FROM pos GROUP BY ticker HAVING count(*) >= 30) a
     LEFT JOIN (SELECT ticker, high_2_back AS fvg_low, low AS fvg_high
                FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY rn) AS hit FROM pos WHERE rn <= 15 AND low > high_2_back) WHERE hit = 1) g USING (ticker)))))""",
    "quality": _quality("pos", "(SELECT max(date) FROM bars)"),
    "quality_rough": _quality("pos_rough", "(SELECT max(date) FROM bars_rough)"),
    "returns": """
SELECT ticker, CASE WHEN max(n) > 20 THEN max(CASE WHEN rn = 1 THEN close END) / max(CASE WHEN rn = 21 THEN close END) - 1 END AS r20,
       CASE WHEN max(n) > 60 THEN max(CASE WHEN rn = 1 THEN close END) / max(CASE WHEN rn = 61 THEN close END) - 1 END AS r60 FROM pos GROUP BY ticker""",
    "context": f"""
SELECT *, {clip('35.0 * breadth_20d + 20.0 * breadth_60d + 0.27 * (' + sigmoid('median_return_20d', 0.055) + ') + 0.18 * (' + sigmoid('median_return_60d', 0.11) + ')')} AS market_regime_score,
  CASE WHEN market_regime_score >= 65 THEN 'RISK_ON' WHEN market_regime_score >= 55 THEN 'CONSTRUCTIVE' WHEN market_regime_score >= 45 THEN 'NEUTRAL'
       WHEN market_regime_score >= 35 THEN 'DEFENSIVE' ELSE 'RISK_OFF' END AS market_regime_label
FROM (SELECT avg(CASE WHEN r20 > 0 THEN 1.0 WHEN r20 IS NOT NULL THEN 0.0 END) AS breadth_20d, avg(CASE WHEN r60 > 0 THEN 1.0 WHEN r60 IS NOT NULL THEN 0.0 END) AS breadth_60d,
        median(r20) AS median_return_20d, median(r60) AS median_return_60d, (SELECT max(date) FROM bars) AS reference_date, greatest(count(r20), count(r60)) AS coverage_count FROM returns)""",
    "market": f"""
SELECT ticker, {clip('0.55 * market_regime_score + 0.30 * (' + sigmoid('rel20', 0.06) + ') + 0.15 * (' + sigmoid('rel60', 0.12) + ')')} AS market_sector_score,
  market_regime_score, market_regime_label, breadth_20d AS market_breadth_20d, breadth_60d AS market_breadth_60d, median_return_20d * 100 AS universe_median_return_20d,
  median_return_60d * 100 AS universe_median_return_60d, rel20 * 100 AS relative_strength_20d_pct, rel60 * 100 AS relative_strength_60d_pct,
  coverage_count AS market_context_coverage, reference_date AS market_reference_date
FROM (SELECT ticker, c.*, coalesce(r20 - median_return_20d, 0.0) AS rel20, coalesce(r60 - median_return_60d, 0.0) AS rel60 FROM returns CROSS JOIN context c)""",
    "foreign_choice": """
SELECT u.ticker, c.source, coalesce(c.coverage_pct, 0.0) AS coverage_pct FROM universe u LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY coverage_pct DESC, CASE source WHEN 'IDX_OFFICIAL_STOCK_SUMMARY' THEN 2 ELSE 1 END DESC, source DESC) AS place
  FROM (SELECT f.ticker, f.source, 100.0 * count(DISTINCT f.trade_date) / max(s.sessions) AS coverage_pct
        FROM foreign_flows f JOIN (SELECT ticker, date FROM pos WHERE rn <= 20) p ON p.ticker = f.ticker AND p.date = f.trade_date
        JOIN (SELECT ticker, count(*) AS sessions FROM pos WHERE rn <= 20 GROUP BY ticker) s ON s.ticker = f.ticker GROUP BY f.ticker, f.source)) c
  ON c.ticker = u.ticker AND c.place = 1""",
    "foreign_evidence": "SELECT f.* FROM foreign_flows f JOIN foreign_choice c ON c.ticker = f.ticker AND c.source = f.source",
    "foreign_features": f"""
SELECT ticker, 50.0 + {clip('foreign_evidence_coverage_pct / 80.0', 0.0, 1.0)} * ({score('0.58 * (' + sigmoid('foreign_intensity_20d', 0.035) + ') + 42.0 * foreign_persistence_20d')} - 50.0) AS foreign_institutional_score,
  foreign_evidence_coverage_pct, CASE WHEN foreign_evidence_source = 'IDX_OFFICIAL_STOCK_SUMMARY' THEN foreign_evidence_coverage_pct ELSE 0.0 END AS official_foreign_coverage_pct,
  foreign_evidence_source, foreign_net_5d, foreign_net_20d, foreign_persistence_20d, foreign_intensity_20d
FROM (SELECT d.ticker, max(d.source) AS foreign_evidence_source, 100.0 * count(CASE WHEN p.date IS NOT NULL THEN 1 END) / max(s.sessions) AS foreign_evidence_coverage_pct,
        sum(CASE WHEN k <= 5 THEN net ELSE 0 END) AS foreign_net_5d, sum(CASE WHEN k <= 20 THEN net ELSE 0 END) AS foreign_net_20d,
        avg(CASE WHEN k <= 20 THEN CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END END) AS foreign_persistence_20d,
        sum(CASE WHEN k <= 20 THEN net ELSE 0 END) / greatest(sum(CASE WHEN k <= 20 THEN volume ELSE 0 END), 1.0) AS foreign_intensity_20d
      FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) AS k
            FROM (SELECT ticker, trade_date, max(source) AS source, sum(foreign_buy) - sum(foreign_sell) AS net, sum(volume) AS volume FROM foreign_evidence GROUP BY ticker, trade_date)) d
      JOIN (SELECT ticker, count(*) AS sessions FROM pos WHERE rn <= 20 GROUP BY ticker) s ON s.ticker = d.ticker
      LEFT JOIN (SELECT ticker, date FROM pos WHERE rn <= 20) p ON p.ticker = d.ticker AND p.date = d.trade_date GROUP BY d.ticker)""",
    "broker_f": _broker_features("broker", "pos"),
    "broker_vf": _broker_features("broker_v", "pos"),
    "features_proxy": _features(None, "quality"),
    "features_part": _features("broker_f", "quality"),
    "features_full": _features("broker_vf", "quality"),
    "scan_proxy": _scan("features_proxy"),
    "scan_part": _scan("features_part"),
    "scan_full": _scan("features_full"),
    "finalists": """
SELECT *, row_number() OVER (ORDER BY f_score DESC, f_acc DESC, f_foreign DESC, f_smc DESC, ticker) AS guarded_rank, f_score AS guarded_score
FROM (SELECT *, round_even(score * 100, 0) / 100 AS f_score, round_even(eff_acc * 100, 0) / 100 AS f_acc,
             round_even(foreign_institutional_score * 100, 0) / 100 AS f_foreign, round_even(smc_execution_score * 100, 0) / 100 AS f_smc FROM scan_proxy)
WHERE round_even(eff_dist * 100, 0) / 100 < 70 AND round_even(price_data_quality_score * 100, 0) / 100 >= 70 AND price_staleness_days <= 3
  AND foreign_evidence_coverage_pct >= 70 AND phase <> 'DISTRIBUTION' AND action <> 'REDUCE_AVOID' AND evidence_tier = 'PRICE_PROXY'
QUALIFY guarded_rank <= 5""",
    "features_verify": _features("broker_vf", "quality", names="finalists").replace(
        "market m USING (ticker)",
        "(SELECT m0.* REPLACE (round_even(market_sector_score * 100, 0) / 100 AS market_sector_score) FROM market m0) m USING (ticker)",
    ),
    "scan_verify": _scan("features_verify"),
    "verified": """
SELECT *, row_number() OVER (ORDER BY CASE broker_verification_status WHEN 'BROKER_VERIFIED' THEN 0 WHEN 'BROKER_GUARDED' THEN 1 WHEN 'BROKER_PENDING' THEN 2 ELSE 3 END,
       round_even(score * 100, 0) DESC, round_even(eff_acc * 100, 0) DESC, guarded_rank, ticker) AS broker_rank
FROM (SELECT s.*, f.guarded_rank, f.guarded_score, CASE WHEN NOT s.direct THEN 'BROKER_PENDING'
        WHEN s.phase = 'DISTRIBUTION' OR s.action = 'REDUCE_AVOID' OR s.eff_dist >= 70 THEN 'BROKER_REJECT'
        WHEN s.real_money_state = 'ELIGIBLE' THEN 'BROKER_VERIFIED' ELSE 'BROKER_GUARDED' END AS broker_verification_status
      FROM scan_verify s JOIN finalists f USING (ticker))""",
    "merged": """
SELECT b.ticker, coalesce(v.score, b.score) AS score, CASE WHEN v.ticker IS NULL THEN b.phase ELSE v.phase END AS phase,
       CASE WHEN v.ticker IS NULL THEN b.action ELSE v.action END AS action, CASE WHEN v.ticker IS NULL THEN b.evidence_tier ELSE v.evidence_tier END AS evidence_tier,
       CASE WHEN v.ticker IS NULL THEN b.real_money_state ELSE v.real_money_state END AS real_money_state,
       CASE WHEN v.ticker IS NULL THEN b.guardrail_reason ELSE v.guardrail_reason END AS guardrail_reason,
       CASE WHEN v.direct THEN v.estimated_smart_money_cost END AS estimated_smart_money_cost, CASE WHEN v.direct THEN v.premium_to_cost_pct END AS premium_to_cost_pct,
       CASE WHEN v.ticker IS NULL THEN b.eff_dist ELSE v.eff_dist END AS distribution_risk, v.guarded_rank, v.guarded_score, v.broker_verification_status, v.cost_position,
       v.broker_rank
FROM scan_proxy b LEFT JOIN verified v ON v.ticker = b.ticker""",
    "outcomes": _outcomes("signals", "bars"),
    "outcomes_rough": _outcomes("signals_rough", "bars_rough"),
}
