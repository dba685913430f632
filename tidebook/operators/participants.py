"""Per-participant flow from trade detail, and scores over its history."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.config import (
    FLOW_VERSION,
    OFFICIAL_BROKER_SUMMARY,
    TRADE_DETAIL_FLOW,
    TRADE_DETAIL_PROVENANCE,
    TRADE_DETAIL_STATE,
)
from tidebook.functions.frames import average_rank_pct, last_by_key, latest_by_key, require_columns
from tidebook.functions.scalars import between, canonical_ticker, day, number, ratio, rint_to, sum0

TRADE_REQUIRED = ("tradingdate", "asset", "participant_buy", "participant_sell", "volume", "value")
BUYER, SELLER = "TOP_NET_BUYER", "TOP_NET_SELLER"


def read_trade_detail(df: DataFrame, trade_date: date | str, universe: DataFrame | None = None) -> DataFrame:
    """Raw trade-detail rows in canonical form, kept to the universe."""
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    require_columns(df, TRADE_REQUIRED, "trade detail")

    def who(name: str) -> Column:
        text = F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
        return F.when(text == "", F.lit("UNKNOWN")).otherwise(text).alias(name)

    out = df.select(
        canonical_ticker(F.col("asset")).alias("ticker"),
        F.coalesce(day(F.col("tradingdate")), F.lit(str(trade_date)).cast("date")).alias("trade_date"),
        who("participant_buy"),
        who("participant_sell"),
        F.coalesce(number(F.col("volume")), F.lit(0.0)).alias("volume"),
        F.coalesce(number(F.col("value")), F.lit(0.0)).alias("value"),
    )
    return out if universe is None else out.join(universe.select("ticker"), "ticker", "left_semi")


def aggregate_trades(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Buy and sell sums per (ticker, trade_date, participant[, by]).

    Every trade is unfolded into its two legs in the scan and one aggregation
    follows; its map-side half already folds a hot ticker to one row per
    participant and day before anything is exchanged.
    """
    legs = trades.select(
        "ticker",
        "trade_date",
        *by,
        F.expr(
            "stack(2, participant_buy, volume, value, 0D, 0D, participant_sell, 0D, 0D, volume, value)"
            " AS (participant, buy_volume, buy_value, sell_volume, sell_value)"
        ),
    )
    return with_balances(legs.groupBy("ticker", "trade_date", "participant", *by).agg(*leg_sums()))


def leg_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("buy_volume", "buy_value", "sell_volume", "sell_value")]


def with_balances(sums: DataFrame) -> DataFrame:
    """Net amounts and average prices beside the sums of both legs."""
    return sums.withColumns(
        {
            "net_volume": F.col("buy_volume") - F.col("sell_volume"),
            "net_value": F.col("buy_value") - F.col("sell_value"),
            "buy_avg": ratio(F.col("buy_value"), F.col("buy_volume")),
            "sell_avg": ratio(F.col("sell_value"), F.col("sell_volume")),
        }
    )


def aggregate_trade_detail(df: DataFrame, trade_date: date | str, universe: DataFrame | None = None) -> DataFrame:
    flow = aggregate_trades(read_trade_detail(df, trade_date, universe))
    return flow.withColumns(
        {"participant_flow_source": F.lit(TRADE_DETAIL_FLOW), "participant_flow_version": F.lit(FLOW_VERSION)}
    )


def trim_top_participants(flow: DataFrame, top_n: int = 10) -> DataFrame:
    """Largest net buyers and net sellers of each ticker-day with their ranks.

    ``net_rank`` and ``sell_rank`` count over all participants of the
    ticker-day, one row per participant code after ``aggregate_trades``.
    Equal nets are ordered by participant.
    """
    group = ("ticker", "trade_date")
    size = F.abs(F.col("net_value"))
    by_net = Window.partitionBy(*group).orderBy(F.col("net_value").desc(), "participant")
    by_size = Window.partitionBy(*group).orderBy(size.desc(), "participant")
    by_side = Window.partitionBy(*group, "side").orderBy(size.desc(), "participant")
    ranked = flow.withColumns(
        {"net_rank": F.row_number().over(by_net), "_size_rank": F.row_number().over(by_size)}
    ).where(F.col("net_value") != 0)
    ranked = ranked.withColumns(
        {
            "side": F.when(F.col("net_value") > 0, BUYER).otherwise(SELLER),
            "sell_rank": F.when(F.col("net_value") < 0, F.col("_size_rank")),
        }
    ).drop("_size_rank")
    return ranked.withColumn("flow_rank", F.row_number().over(by_side)).where(F.col("flow_rank") <= top_n)


def top_participants(flow: DataFrame, top_n: int = 10) -> DataFrame:
    """``trim_top_participants`` without the two whole-day ranks.

    The single rank filter is pushed below the exchange as a group limit, so
    every map task ships at most ``top_n`` rows per ticker-day and side.
    """
    by_side = Window.partitionBy("ticker", "trade_date", "side").orderBy(F.abs("net_value").desc(), "participant")
    return (
        flow.where(F.col("net_value") != 0)
        .withColumn("side", F.when(F.col("net_value") > 0, BUYER).otherwise(SELLER))
        .withColumn("flow_rank", F.row_number().over(by_side))
        .where(F.col("flow_rank") <= top_n)
    )


def participant_measures(history: DataFrame, lookback_days: int = 20) -> DataFrame:
    """Raw measures per ticker over its last ``lookback_days`` flow days."""
    newest = Window.partitionBy("ticker").orderBy(F.col("trade_date").desc())
    recent = history.withColumn("day_rank", F.dense_rank().over(newest)).where(F.col("day_rank") <= lookback_days)
    buyer, seller = F.col("side") == BUYER, F.col("side") == SELLER
    lead_now = buyer & (F.col("day_rank") == 1) & (F.col("flow_rank") == 1)
    per_participant = recent.groupBy("ticker", "participant").agg(
        F.count(F.when(buyer & (F.col("flow_rank") <= 3), True)).alias("top3_days"),
        F.sum(F.when(buyer, F.col("net_value"))).alias("buyer_net"),
        sum0(F.when(buyer, F.greatest(F.col("net_value"), F.lit(0.0)))).alias("positive"),
        sum0(F.when(seller, F.abs("net_value"))).alias("negative"),
        F.max("day_rank").alias("days"),
        F.max("trade_date").alias("latest_date"),
        F.max(lead_now).alias("leads"),
        F.max(F.when(lead_now, F.col("buy_avg"))).alias("lead_avg"),
    )
    pick = F.max(
        F.when(F.col("top3_days") > 0, F.struct("top3_days", (-F.col("_order")).alias("_order"), "participant"))
    )
    ordered = per_participant.withColumn(
        "_order", F.row_number().over(Window.partitionBy("ticker").orderBy("participant"))
    )
    return ordered.groupBy("ticker").agg(
        F.max("days").alias("days"),
        F.max("latest_date").alias("latest_date"),
        pick.alias("persistent"),
        F.max("buyer_net").alias("top_net"),
        F.sum("positive").alias("positive"),
        F.sum("negative").alias("negative"),
        F.max(F.when(F.col("leads"), F.col("participant"))).alias("latest_buyer"),
        F.max("lead_avg").alias("latest_avg"),
    )


def score_participant_history(history: DataFrame, universe: DataFrame, lookback_days: int = 20) -> DataFrame:
    """One scored row per universe ticker; tickers without history get NO_DATA."""
    # Blend weights 0.35/0.25/0.20/0.20 and 0.70/0.30, states at 70 and 35.
    measures = participant_measures(history, lookback_days).withColumns(
        {
            "persistence": F.lit(100.0) * F.coalesce(F.col("persistent.top3_days"), F.lit(0)) / F.col("days"),
            "concentration": F.when(
                (F.col("top_net") > 0) & (F.col("positive") > 0), F.lit(100.0) * F.col("top_net") / F.col("positive")
            ),
            "dominance": between(
                F.lit(50.0)
                + F.lit(15.0)
                * F.when(F.col("negative") > 0, F.col("positive") / F.col("negative")).otherwise(
                    F.when(F.col("positive") > 0, F.lit(5.0)).otherwise(F.lit(0.0))
                ),
                0.0,
                100.0,
            ),
        }
    )
    ranked = average_rank_pct(universe.select("ticker").distinct().join(measures, "ticker", "left"), "top_net", "pct")
    net_score = F.when(F.col("top_net").isNull(), F.lit(None).cast("double")).otherwise(
        F.when(F.col("pct_n") >= 3, F.col("pct") * 100.0).otherwise(F.lit(50.0))
    )
    scored = ranked.withColumns(
        {
            "participant_net_score": net_score,
            "participant_flow_coverage_pct": F.coalesce(
                between(F.lit(100.0) * F.col("days") / F.lit(max(1, lookback_days)), 0.0, 100.0), F.lit(0.0)
            ),
        }
    )
    scored = scored.withColumn(
        "participant_accumulation_score",
        rint_to(
            between(
                F.lit(0.35) * F.coalesce("participant_net_score", F.lit(50.0))
                + F.lit(0.25) * between(F.coalesce("persistence", F.lit(0.0)), 0.0, 100.0)
                + F.lit(0.20) * between(F.coalesce("concentration", F.lit(0.0)), 0.0, 100.0)
                + F.lit(0.20) * F.coalesce("dominance", F.lit(50.0)),
                0.0,
                100.0,
            ),
            1,
        ),
    )
    covered = F.col("participant_flow_coverage_pct") > 0
    accumulation = F.col("participant_accumulation_score")
    return scored.select(
        "ticker",
        F.col("days").alias("participant_flow_observed_days"),
        F.col("latest_date").alias("participant_flow_latest_date"),
        F.when(covered, F.coalesce(F.col("persistent.participant"), F.lit(""))).alias("participant_top_buyer_code"),
        F.when(covered, F.coalesce("latest_buyer", F.lit(""))).alias("participant_latest_top_buyer_code"),
        F.col("persistence").alias("participant_top3_buyer_persistence_20d_pct"),
        F.col("top_net").alias("participant_top_buyer_net_value_20d"),
        F.col("concentration").alias("participant_buyer_concentration_pct"),
        F.col("dominance").alias("participant_buy_sell_dominance_score"),
        F.col("latest_avg").alias("participant_latest_top_buyer_buy_avg"),
        "participant_flow_coverage_pct",
        F.when(covered, F.lit(TRADE_DETAIL_FLOW)).alias("participant_flow_source"),
        F.when(covered, F.lit(TRADE_DETAIL_PROVENANCE)).alias("participant_flow_provenance"),
        "participant_net_score",
        "participant_accumulation_score",
        rint_to(
            between(
                F.lit(0.70) * accumulation + F.lit(0.30) * F.coalesce("participant_net_score", F.lit(50.0)), 0.0, 100.0
            ),
            1,
        ).alias("participant_smart_money_confirmation_score"),
        F.when(~covered, F.lit("NO_DATA"))
        .when(accumulation >= 70, F.lit("PARTICIPANT_ACCUMULATION"))
        .when(accumulation <= 35, F.lit("PARTICIPANT_DISTRIBUTION"))
        .otherwise(F.lit("PARTICIPANT_MIXED"))
        .alias("participant_accumulation_state"),
        F.lit(FLOW_VERSION).alias("participant_flow_version"),
    )


def participant_to_broker(flow: DataFrame, arrival: str | None = None, source_url: str | None = None) -> DataFrame:
    """Participant flow as verified broker rows."""
    values = ("buy_value", "sell_value", "buy_volume", "sell_volume")
    code = "participant" if "participant" in flow.columns else "broker_code"
    require_columns(flow, ("ticker", "trade_date", code, *values), "participant flow")
    rows = flow.select(
        canonical_ticker(F.col("ticker")).alias("ticker"),
        day(F.col("trade_date")).alias("trade_date"),
        F.upper(F.trim(F.col(code))).alias("broker_code"),
        (F.col("market_type") if "market_type" in flow.columns else F.lit("RG")).alias("market_type"),
        *[F.coalesce(number(F.col(c)), F.lit(0.0)).alias(c) for c in values],
        *([F.col(arrival).alias("_arrival")] if arrival else []),
    ).where(F.col("trade_date").isNotNull() & F.col("broker_code").isNotNull())
    rows = last_by_key(rows, ["ticker", "trade_date", "broker_code"], "_arrival" if arrival else None, "participant flow")
    return rows.withColumns(
        {
            "buy_avg": ratio(F.col("buy_value"), F.col("buy_volume")),
            "sell_avg": ratio(F.col("sell_value"), F.col("sell_volume")),
            "source": F.lit(TRADE_DETAIL_FLOW),
            "source_verified": F.lit(True),
            "source_url": F.lit(source_url).cast("string"),
            "provenance_state": F.lit(TRADE_DETAIL_STATE),
        }
    )


def merge_prefer_direct(direct: DataFrame, other: DataFrame) -> DataFrame:
    """Union in which rows of the direct broker source win their key."""
    both = direct.unionByName(other, allowMissingColumns=True)
    prefers = F.col("source").contains(OFFICIAL_BROKER_SUMMARY).cast("int")
    return latest_by_key(both, ["ticker", "trade_date", "broker_code"], [prefers])
