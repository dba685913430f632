"""Foreign share flow scored per ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.config import OFFICIAL_STOCK_SUMMARY
from tidebook.functions.days import day_bits, day_sets, days_held
from tidebook.functions.scalars import sum0
from tidebook.functions.text import clip, score, sigmoid, with_texts

FOREIGN_COLUMNS = (
    "foreign_institutional_score",
    "foreign_evidence_coverage_pct",
    "official_foreign_coverage_pct",
    "foreign_evidence_source",
    "foreign_net_5d",
    "foreign_net_20d",
    "foreign_persistence_20d",
    "foreign_intensity_20d",
)


def foreign_state(flow: DataFrame) -> DataFrame:
    """Sums over the last 5 and 20 flow days, one row per ticker.

    Rows are folded to one per ticker-day first, so the day window is bounded
    by the calendar; the set of a ticker's days is a bitmap made from the rows.
    """
    source = next((c for c in ("foreign_evidence_source", "source") if c in flow.columns), None)
    volume = F.col("volume") if "volume" in flow.columns else F.lit(0.0)
    daily = flow.where(F.col("trade_date").isNotNull()).groupBy("ticker", "trade_date").agg(
        (sum0(F.col("foreign_buy")) - sum0(F.col("foreign_sell"))).alias("net"),
        sum0(volume).alias("volume"),
        F.max(F.col(source) if source else F.lit(None).cast("string")).alias("source"),
    )
    newest = Window.partitionBy("ticker").orderBy(F.col("trade_date").desc())
    rows = daily.withColumn("n", F.row_number().over(newest))
    in20 = F.col("n") <= 20
    days = day_sets(day_bits(flow, ["ticker"], "trade_date"), ["ticker"], "flow_day_set")
    sums = rows.groupBy("ticker").agg(
        sum0(F.when(F.col("n") <= 5, F.col("net"))).alias("net_5"),
        sum0(F.when(in20, F.col("net"))).alias("net_20"),
        sum0(F.when(in20, F.col("volume"))).alias("volume_20"),
        F.avg(F.when(in20, (F.col("net") > 0).cast("double"))).alias("persistence_20"),
        F.min_by("source", F.when(F.col("source").isNotNull(), F.col("n"))).alias("flow_source"),
    )
    return sums.join(days, "ticker", "left")


def add_foreign_features(state: DataFrame) -> DataFrame:
    """Scores from ``foreign_state`` joined to ``bar_profile``; null state takes defaults."""
    # 0.58, 42, scale 0.035, full confidence at 80 % coverage.
    s = with_texts(state, {"_some": "flow_day_set IS NOT NULL AND coalesce(size(price_days), 0) > 0"})

    def given(text: str, default: str) -> str:
        return f"CASE WHEN _some THEN {text} ELSE {default} END"

    covered = f"100D * {days_held('flow_day_set', 'price_days')} / greatest(size(price_days), 1)"
    s = with_texts(
        s,
        {
            "foreign_evidence_coverage_pct": given(covered, "0D"),
            "foreign_intensity_20d": given("net_20 / greatest(volume_20, 1D)", "0D"),
            "foreign_evidence_source": given("coalesce(flow_source, 'UNKNOWN')", "'UNAVAILABLE'"),
            "foreign_net_5d": given("net_5", "0D"),
            "foreign_net_20d": given("net_20", "0D"),
            "foreign_persistence_20d": given("persistence_20", "0D"),
        },
    )
    s = with_texts(
        s, {"_raw": score(f"(0.58D * {sigmoid('foreign_intensity_20d', 0.035)} + 42 * foreign_persistence_20d)")}
    )
    confidence = clip("foreign_evidence_coverage_pct / 80D", 0.0, 1.0)
    return with_texts(
        s,
        {
            "foreign_institutional_score": given(f"50 + {confidence} * (_raw - 50)", "50D"),
            "official_foreign_coverage_pct": f"CASE WHEN foreign_evidence_source = '{OFFICIAL_STOCK_SUMMARY}'"
            " THEN foreign_evidence_coverage_pct ELSE 0D END",
        },
    ).drop("flow_day_set", "net_5", "net_20", "volume_20", "persistence_20", "flow_source", "_raw", "_some")


def compute_foreign_features(flow: DataFrame, profile: DataFrame) -> DataFrame:
    joined = profile.select("ticker", "price_days").join(foreign_state(flow), "ticker", "left")
    return add_foreign_features(joined).select("ticker", *FOREIGN_COLUMNS)
