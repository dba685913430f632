"""Strictly forward evaluation of signals.

The forward values of every bar are computed once on a window over the
ticker's days; a signal then meets its own bar in an equality join. Work grows
with bars plus signals, never with their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.frames import last_by_key, one_row
from tidebook.functions.scalars import finite_or_null
from tidebook.operators.bars import dedupe_days, split_like_gap

OUTCOME_COLUMNS = (
    "entry_close",
    "return_5d",
    "return_20d",
    "return_60d",
    "mfe_20d",
    "mae_20d",
    "evaluated_through",
    "evaluation_status",
    "evaluation_note",
)
SPLIT_NOTE = "CORPORATE_ACTION_LIKE_GAP_IN_FORWARD_WINDOW"
OPEN_STATES = ("PENDING", "PARTIAL")


def forward_bars(bars: DataFrame) -> DataFrame:
    """Each bar with the closes 5, 20 and 60 bars on and the extremes of the 20 after it.

    A ticker-day that is there twice is an error: dedupe where the order of arrival is known."""
    oldest = Window.partitionBy("ticker").orderBy("date")
    text = F.concat(F.lit("two bars of one ticker-day: "), "ticker", F.lit(" "), F.col("date").cast("string"))
    flagged = bars.withColumn(
        "gap", split_like_gap(F.lag("close").over(oldest), F.col("open"), F.col("close")).cast("int")
    )
    next20, next60 = oldest.rowsBetween(1, 20), oldest.rowsBetween(1, 60)
    return flagged.select(
        "ticker",
        F.when(F.lag("date").over(oldest) == F.col("date"), F.raise_error(text)).otherwise(F.col("date")).alias("as_of_date"),
        F.col("close").alias("entry"),
        *[F.lead("close", n).over(oldest).alias(f"close_{n}") for n in (5, 20, 60)],
        F.max("high").over(next20).alias("high_20"),
        F.min("low").over(next20).alias("low_20"),
        (F.coalesce(F.max("gap").over(next60), F.lit(0)) == 1).alias("has_gap"),
        F.max("date").over(Window.partitionBy("ticker")).alias("last_date"),
    )


def evaluate(joined: DataFrame) -> DataFrame:
    """Outcome columns from signal rows left-joined to ``forward_bars``."""
    # Status and note texts.
    found = F.col("entry").isNotNull() & (F.col("entry") > 0)
    gap = F.col("has_gap")

    def pct(value: str) -> Column:
        return F.when(found & ~gap, F.lit(100.0) * (F.col(value) / F.col("entry") - 1.0))

    status = (
        F.when(~F.coalesce(found, F.lit(False)), F.lit("PENDING"))
        .when(gap, F.lit("EXCLUDED"))
        .when(F.col("close_60").isNotNull(), F.lit("COMPLETE"))
        .when(F.col("close_5").isNotNull() | F.col("close_20").isNotNull(), F.lit("PARTIAL"))
        .otherwise(F.lit("PENDING"))
    )
    return joined.withColumns(
        {
            "entry_close": F.when(found, F.col("entry")),
            "return_5d": pct("close_5"),
            "return_20d": pct("close_20"),
            "return_60d": pct("close_60"),
            "mfe_20d": pct("high_20"),
            "mae_20d": pct("low_20"),
            "evaluated_through": F.when(found, F.col("last_date")),
            "evaluation_status": status,
            "evaluation_note": F.when(found & gap, F.lit(SPLIT_NOTE)),
        }
    ).drop("entry", "close_5", "close_20", "close_60", "high_20", "low_20", "has_gap", "last_date")


def compute_signal_outcomes(signals: DataFrame, bars: DataFrame, arrival: str | None = None) -> DataFrame:
    """Outcome of every signal; one without a bar on its exact day stays PENDING.

    Of several bars of a day the last by ``arrival`` counts; without it they are an error.
    """
    columns = ("ticker", "date", "open", "high", "low", "close")
    if arrival is not None:
        bars = last_by_key(bars.select(*columns, F.col(arrival).alias("_arrival")), ["ticker", "date"], "_arrival", "bars")
    bars = bars.select(*columns)
    keys = [c for c in signals.columns if c not in OUTCOME_COLUMNS]
    return evaluate(signals.select(*keys).join(forward_bars(bars), ["ticker", "as_of_date"], "left"))


def _as_bars(prices: DataFrame) -> DataFrame:
    return dedupe_days(prices).withColumnRenamed("trade_date", "date")


def _bars_ahead(prices: DataFrame, open_rows: DataFrame) -> DataFrame:
    """Forward bars of the tickers with open rows, from the first open signal of each on: what
    lies before cannot reach an outcome, so it is dropped before the window."""
    since = open_rows.groupBy("ticker").agg(F.min("as_of_date").alias("_since"))
    ahead = prices.join(since, "ticker").where(F.col("trade_date") >= F.col("_since")).drop("_since")
    return forward_bars(_as_bars(ahead))


def refresh_signal_outcomes(
    outcomes: DataFrame, prices: DataFrame, now: Column | None = None, limit: int | None = None
) -> DataFrame:
    """Updated rows of all open outcomes that have a price on their signal day.

    ``limit`` takes the oldest open rows only, where a caller wants a budget.
    """
    open_rows = outcomes.where(F.col("evaluation_status").isin(*OPEN_STATES))
    keys = [c for c in outcomes.columns if c not in (*OUTCOME_COLUMNS, "evaluated_at")]
    joined = open_rows.select(*keys).join(_bars_ahead(prices, open_rows), ["ticker", "as_of_date"])
    if limit is not None:
        joined = joined.orderBy("as_of_date", "ticker", "run_id").limit(limit)
    return _stamped(evaluate(joined.where(F.col("entry") > 0)), now)


def _stamped(rows: DataFrame, now: Column | None) -> DataFrame:
    stamp = F.current_timestamp() if now is None else now
    return rows.withColumn("evaluated_at", F.when(F.col("evaluation_status") != "PENDING", stamp))


def pending_rows(outcomes: DataFrame, universe: DataFrame) -> DataFrame:
    """Open rows of the universe: what a refresh looks at."""
    open_rows = outcomes.where(F.col("evaluation_status").isin(*OPEN_STATES))
    return open_rows.join(universe.select("ticker"), "ticker", "left_semi")


def refresh_pending(
    outcomes: DataFrame, universe: DataFrame, prices: DataFrame, now: Column | None = None
) -> DataFrame:
    """Open universe rows whose status or last evaluated day changed."""
    pending = pending_rows(outcomes, universe)
    held = {"evaluation_status": "_held_status", "evaluated_through": "_held_through"}
    keys = [c for c in outcomes.columns if c not in (*OUTCOME_COLUMNS, "evaluated_at")]
    rows = pending.select(*keys, *[F.col(c).alias(h) for c, h in held.items()])
    fresh = evaluate(rows.join(_bars_ahead(prices, pending), ["ticker", "as_of_date"], "left"))
    same = F.lit(True)
    for c, h in held.items():
        same = same & F.col(c).eqNullSafe(F.col(h))
    return _stamped(fresh.where(~same).drop(*held.values()), now)


def refresh_stats(updates: DataFrame, pending: DataFrame) -> DataFrame:
    """How many rows were looked at and changed, and what they became."""
    checked = pending.agg(F.count(F.lit(1)).alias("checked"))
    return updates.agg(
        one_row(checked)["checked"].alias("checked"),
        F.count(F.lit(1)).alias("updated"),
        F.count(F.when(F.col("evaluation_status") == "COMPLETE", True)).alias("complete"),
        F.count(F.when(F.col("evaluation_status") == "EXCLUDED", True)).alias("excluded"),
    )


def apply_updates(outcomes: DataFrame, updates: DataFrame) -> DataFrame:
    """The outcome table after an update; rows without one stay as they are."""
    changed = [c for c in (*OUTCOME_COLUMNS, "evaluated_at") if c in updates.columns and c in outcomes.columns]
    patch = updates.select("run_id", "ticker", *[F.col(c).alias(f"_n_{c}") for c in changed], F.lit(True).alias("_hit"))
    joined = outcomes.join(patch, ["run_id", "ticker"], "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
            for c in outcomes.columns
        ]
    )


def seed_signal_outcomes(results: DataFrame, run_id: str, bars: DataFrame, now: Column | None = None) -> DataFrame:
    """Results registered as outcome rows of ``run_id``."""
    rows = results.where((F.col("ticker") != "") & F.col("as_of_date").isNotNull()).select(
        F.lit(run_id).alias("run_id"),
        "ticker",
        "as_of_date",
        F.coalesce("phase", F.lit("UNKNOWN")).alias("phase"),
        F.coalesce("evidence_tier", F.lit("PRICE_PROXY")).alias("evidence_tier"),
        F.coalesce(finite_or_null(F.col("final_score")), F.lit(0.0)).alias("final_score"),
    )
    return _stamped(compute_signal_outcomes(rows, bars), now)
