"""All per-bar columns on one window, all per-ticker measures in one aggregate.

Bars hold one row per ticker and day, so a window over a ticker is bounded by
the trading calendar however large the tick data are. Every operator below
reads the frame made by ``bar_profile``; measures it does not use are pruned,
and the aggregate runs on the window's own exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.frames import first_by_key
from tidebook.functions.scalars import least_relative_split_error, ratio
from tidebook.functions.text import agg_texts, held, nearest_split_factor, with_texts


def newest_first() -> Window:
    return Window.partitionBy("ticker").orderBy(F.col("date").desc())


def with_positions(bars: DataFrame) -> DataFrame:
    """``rn`` counts from the newest bar (1); ``prev_*`` look at older bars."""
    w = newest_first()
    return bars.withColumns(
        {
            "rn": F.row_number().over(w),
            "prev_close": F.lead("close", 1).over(w),
            "high_2_back": F.lead("high", 2).over(w),
            "is_first": F.lead("date", 1).over(w).isNull(),
            "anchor": F.first("close").over(w),
        }
    )


def last_n_bars(bars: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` bars per ticker; every map task ships at most ``n`` of them."""
    if n < 1:
        raise ValueError("at least one bar must be asked for")
    return bars.withColumn("rn", F.row_number().over(newest_first())).where(F.col("rn") <= n).drop("rn")


def dedupe_days(prices: DataFrame) -> DataFrame:
    """One price row per ticker-day: newest ingestion, then first source name."""
    age = F.coalesce(-F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(2**63 - 1))
    return first_by_key(prices, ["ticker", "trade_date"], [age, F.col("source")])


def tail(n: int, value: str) -> str:
    return f"CASE WHEN rn <= {n} THEN {value} END"


def span(first: int, last: int, value: str) -> str:
    return f"CASE WHEN rn BETWEEN {first} AND {last} THEN {value} END"


def at(n: int, column: str) -> str:
    """The value ``n`` bars from the end, 1 being the newest."""
    return f"max(CASE WHEN rn = {n} THEN {column} END)"


def ema_gap(length: int, end: int) -> str:
    """Exponential mean of ``length`` at bar ``end`` from the newest, less the last close.

    The recursion started at the first close is a weighted sum, so it needs no
    ordered fold. Distances from the last close are averaged, which leaves an
    unchanged price at exactly zero.
    """
    alpha = 2.0 / (length + 1.0)
    weight = f"power({1.0 - alpha!r}D, rn - {end}) * CASE WHEN is_first THEN 1D ELSE {alpha!r}D END"
    return f"sum(CASE WHEN rn >= {end} THEN {weight} * (close - anchor) END)"


def split_like(lookback: int = 120) -> str:
    """Is this bar an overnight jump near a split factor without a large move that day?

    The oldest bar of the look-back has no predecessor inside it.
    """
    # Gap 0.35, relative error 0.06, move of the day 0.25.
    return (
        f"coalesce(rn < {max(3, lookback)} AND abs(jump - 1) >= 0.35D AND abs(jump - jump_factor) / jump_factor <= 0.06D"
        " AND coalesce(abs(try_divide(close, open) - 1) <= 0.25D, TRUE), FALSE)"
    )


def split_like_gap(prev_close: Column, open_: Column, close: Column) -> Column:
    """The outcome variant: least relative error, every price required."""
    # Gap 0.35, relative error 0.06, move of the day 0.25.
    jump = ratio(open_, prev_close)
    return F.coalesce(
        (prev_close > 0)
        & (open_ > 0)
        & (F.abs(jump - 1.0) >= 0.35)
        & (F.abs(ratio(close, open_) - 1.0) <= 0.25)
        & (least_relative_split_error(jump) <= 0.06),
        F.lit(False),
    )


def enrich_bars(bars: DataFrame, split_lookback: int = 120) -> DataFrame:
    """Positions plus the single-bar columns the measures are summed from."""
    rows = with_texts(
        with_positions(bars),
        {
            "ret": "try_divide(close, prev_close) - 1",
            "shares": "greatest(coalesce(volume, 0D), 0D)",
            "close_pos": held("coalesce(try_divide(close - low, high - low), 0.5D)", 0.0, 1.0),
            "flow_multiplier": "coalesce(try_divide((close - low) - (high - close), high - low), 0D)",
            "true_range": "greatest(abs(high - low), abs(high - prev_close), abs(low - prev_close))",
            "bad_geometry": "coalesce(high < greatest(open, close), FALSE) OR coalesce(low > least(open, close), FALSE)"
            " OR coalesce(high < low, FALSE) OR close <= 0",
            "jump": "try_divide(open, prev_close)",
            "gap_up": "coalesce(low > high_2_back AND rn <= 15, FALSE)",
        },
    )
    rows = with_texts(rows, {"jump_factor": nearest_split_factor("jump")})
    return with_texts(
        rows,
        {
            "is_split_like": split_like(split_lookback),
            "mean_shares": f"avg({tail(20, 'shares')}) OVER (PARTITION BY ticker)",
        },
    )


def bar_profile(bars: DataFrame, split_lookback: int = 120) -> DataFrame:
    """One row per ticker with every measure the price features are computed from."""
    absorbs = "abs(ret) <= 0.02D AND shares >= 1.25D * greatest(mean_shares, 1D) AND close_pos >= 0.55D"
    # Slope of the cumulated signed volume over the last 20 bars: the sum of
    # each bar's signed volume times its fixed least-squares weight.
    signed = "signum(coalesce(ret, 0D)) * shares * rn * (20 - rn) / 1330D"
    split_no = "CASE WHEN is_split_like THEN rn END"
    gap_no = "CASE WHEN gap_up THEN rn END"
    measures = {
        "bars": "count(1)",
        "last_date": "max(date)",
        "price_days": f"collect_list({tail(20, 'date')})",
        "last_close": at(1, "close"),
        "last_low": at(1, "low"),
        "close_20": at(20, "close"),
        "close_21": at(21, "close"),
        "close_61": at(61, "close"),
        "vol20_n": f"count({tail(20, 'ret')})",
        "vol20_raw": f"stddev_pop({tail(20, 'ret')})",
        "vol60_n": f"count({tail(60, 'ret')})",
        "vol60_raw": f"stddev_pop({tail(60, 'ret')})",
        "shares_20": f"coalesce(sum({tail(20, 'shares')}), 0D)",
        "money_flow_20": f"coalesce(sum({tail(20, 'flow_multiplier * shares')}), 0D)",
        "obv_slope_20": f"coalesce(sum({tail(20, signed)}), 0D)",
        "value_20": f"coalesce(sum({tail(20, 'close * shares')}), 0D)",
        "up_value_20": f"coalesce(sum({tail(20, 'CASE WHEN ret > 0 THEN close * shares END')}), 0D)",
        "absorption_20": f"avg({tail(20, f'CASE WHEN {absorbs} THEN 1D ELSE 0D END')})",
        "acceptance_20": f"avg({tail(20, 'close_pos')})",
        "atr14_n": f"count({tail(14, 'true_range')})",
        "atr14_raw": f"avg({tail(14, 'true_range')})",
        "prev20_high": f"max({span(2, 21, 'high')})",
        "prev5_low": f"min({span(2, 6, 'low')})",
        "ema20_gap": ema_gap(20, 1),
        "ema50_gap": ema_gap(50, 1),
        "ema20_gap_6": ema_gap(20, 6),
        "ema50_gap_6": ema_gap(50, 6),
        "fvg_low": f"min_by(high_2_back, {gap_no})",
        "fvg_high": f"min_by(low, {gap_no})",
        "zero_volume_20": f"avg({tail(20, 'CASE WHEN coalesce(volume, 0D) <= 0 THEN 1D ELSE 0D END')})",
        "unchanged_20": f"avg({tail(20, 'CASE WHEN close = prev_close AND rn < 20 THEN 1D ELSE 0D END')})",
        "bad_geometry_60": f"avg({tail(60, 'CASE WHEN bad_geometry THEN 1D ELSE 0D END')})",
        "split_rn": f"min({split_no})",
        "split_date": f"min_by(date, {split_no})",
        "split_factor": f"min_by(jump_factor, {split_no})",
    }
    return enrich_bars(bars, split_lookback).groupBy("ticker").agg(*agg_texts(measures))


def bars_nested(prices: DataFrame, n: int = 320, tickers: DataFrame | None = None) -> DataFrame:
    """Newest ``n`` deduped bars as one ordered array per ticker."""
    wanted = prices if tickers is None else prices.join(requested(tickers), "ticker", "left_semi")
    rows = last_n_bars(dedupe_days(wanted).withColumnRenamed("trade_date", "date"), n)
    bar = F.struct(F.col("date").alias("trade_date"), "open", "high", "low", "close", "volume")
    return rows.groupBy("ticker").agg(F.array_sort(F.collect_list(bar)).alias("payload"))


def bars_json(prices: DataFrame, n: int = 450, tickers: DataFrame | None = None) -> DataFrame:
    """The same bars as JSON text, one array per ticker so that no task holds them all."""
    nested = bars_nested(prices, n, tickers)
    tagged = F.transform(
        "payload",
        lambda b: F.struct(
            F.col("ticker").alias("ticker"), *[b[c].alias(c) for c in ("trade_date", "open", "high", "low", "close", "volume")]
        ),
    )
    return nested.select("ticker", F.to_json(tagged).alias("payload"))


def price_cache(prices: DataFrame, n: int = 450, tickers: DataFrame | None = None) -> DataFrame:
    """Newest ``n`` deduped bars as rows."""
    wanted = prices if tickers is None else prices.join(requested(tickers), "ticker", "left_semi")
    rows = last_n_bars(dedupe_days(wanted).withColumnRenamed("trade_date", "date"), n)
    return rows.select("ticker", F.col("date").alias("trade_date"), "open", "high", "low", "close", "volume")


def requested(tickers: DataFrame) -> DataFrame:
    name = F.upper(F.trim("ticker"))
    return tickers.select(name.alias("ticker")).where(F.col("ticker") != "").distinct()
