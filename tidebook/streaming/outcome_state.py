"""Open outcomes as keyed state: each arriving bar moves the signals of its ticker on.

The batch refresh reads every price since the first open signal of a ticker again.  Here a ticker's
state holds its open signals and the bars from the oldest of them on, so a batch of bars costs what
it brings plus the open signals of its tickers.  A signal that closes (60 bars on, or a split-like
gap) leaves the state, and with it the bars that no open signal needs.

A signal on a day without a bar stays open, as in the batch refresh, and keeps the bars from its
day on, since its bar may still come.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidebook.functions.frames import latest_by_key
from tidebook.functions.scalars import SPLIT_FACTORS
from tidebook.operators.outcomes import OPEN_STATES, evaluate
from tidebook.streaming.state import state_store

#: Bars after the signal's own that an outcome looks at.
HORIZON = 60
SIGNALS = "run_id string, day int"
BARS = "day int, age long, source string, open double, high double, low double, close double"
FOUND = (
    "ticker string, run_id string, day int, entry double, close_5 double, close_20 double, close_60 double, high_20 double, low_20 double,"
    " has_gap boolean, last_day int, version long"
)


def gap_like(prev_close: float | None, open_: float | None, close: float | None, factors: Sequence[float]) -> bool:
    """``split_like_gap`` of one bar."""
    # Gap 0.35, relative error 0.06, move of the day 0.25.
    if prev_close is None or open_ is None or close is None or prev_close <= 0 or open_ <= 0:
        return False
    jump = open_ / prev_close
    return abs(jump - 1.0) >= 0.35 and abs(close / open_ - 1.0) <= 0.25 and min(abs(jump - f) / f for f in factors) <= 0.06


class OpenOutcomes(StatefulProcessor):
    """State of one ticker: open signals, their bars, and how many batches it has seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.signals = handle.getListState("signals", SIGNALS)
        self.bars = handle.getListState("bars", BARS)
        self.version = handle.getValueState("version", "n long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.signals.appendList(list(zip(initialState.run_ids, initialState.days, strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived, signals = list(rows), [tuple(s) for s in self.signals.get()]
        known = {run_id for run_id, _ in signals}
        signals += [(r.run_id, r.day) for r in arrived if r.run_id is not None and r.run_id not in known]
        held = {b[0]: tuple(b) for b in self.bars.get()}
        for r in arrived:
            if r.run_id is None:
                bar = (r.day, r.age, r.source, r.open, r.high, r.low, r.close)
                # Of a day's rows the newest ingestion counts, then the first source; nulls first.
                rank = (bar[1], bar[2] is not None, bar[2] or "")
                old = held.get(r.day)
                if old is None or rank < (old[1], old[2] is not None, old[2] or "") or rank[0] == old[1] and bar[2] == old[2] and _plain(bar) < _plain(old):
                    held[r.day] = bar
        days = sorted(held)
        bars = [held[d] for d in days]
        gaps = [i > 0 and gap_like(bars[i - 1][6], bars[i][3], bars[i][6], SPLIT_FACTORS) for i in range(len(bars))]
        version = (self.version.get() or (0,))[0] + 1
        self.version.update((version,))
        still = []
        for run_id, day in signals:
            i = bisect_left(days, day)
            found = i < len(days) and days[i] == day
            entry = bars[i][6] if found else None
            has_gap, close_60 = any(gaps[i + 1 : i + 1 + HORIZON]) if found else False, _close(bars, i + HORIZON)
            if entry is None or entry <= 0 or not (has_gap or close_60 is not None):
                still.append((run_id, day))
            if entry is not None and entry > 0:
                after = bars[i + 1 : i + 21]
                yield Row(
                    ticker=key[0], run_id=run_id, day=day, entry=entry, close_5=_close(bars, i + 5), close_20=_close(bars, i + 20), close_60=close_60,
                    high_20=max((b[4] for b in after if b[4] is not None), default=None), low_20=min((b[5] for b in after if b[5] is not None), default=None),
                    has_gap=has_gap, last_day=days[-1], version=version,
                )
        self.signals.put(still) if still else self.signals.clear()
        since = min((day for _, day in still), default=None)
        kept = [] if since is None else bars[bisect_left(days, since) :]
        self.bars.put(kept) if kept else self.bars.clear()

    def close(self) -> None:
        pass


def _plain(bar: tuple) -> tuple:
    return tuple((x is not None, x or 0.0) for x in bar[3:])


def _close(bars: list[tuple], i: int) -> float | None:
    return bars[i][6] if i < len(bars) else None


def open_signals(outcomes: DataFrame) -> DataFrame:
    """Stored rows that are still open, one row per ticker as the processor's first state."""
    rows = outcomes.where(F.col("evaluation_status").isin(*OPEN_STATES))
    signals = F.collect_list(F.struct("run_id", F.unix_date("as_of_date").alias("day")))
    return rows.groupBy("ticker").agg(signals.alias("signals")).select("ticker", F.col("signals.run_id").alias("run_ids"), F.col("signals.day").alias("days"))


def bar_rows(prices: DataFrame) -> DataFrame:
    age = F.coalesce(-F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(2**63 - 1))
    return prices.select(
        "ticker", F.lit(None).cast("string").alias("run_id"), F.unix_date("trade_date").alias("day"), age.alias("age"), "source",
        *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")),
    )


def signal_rows(signals: DataFrame) -> DataFrame:
    none = F.lit(None)
    return signals.select(
        "ticker", "run_id", F.unix_date("as_of_date").alias("day"), none.cast("long").alias("age"), none.cast("string").alias("source"),
        *(none.cast("double").alias(c) for c in ("open", "high", "low", "close")),
    )


def track_outcomes(
    prices: DataFrame, outcomes: DataFrame, table_path: str, checkpoint: str, signals: DataFrame | None = None, now: Column | None = None
) -> StreamingQuery:
    """Streams price rows past the open rows of ``outcomes`` and appends every outcome they move.

    ``signals`` is a stream of new open rows (run_id, ticker, as_of_date), where there is one.
    ``outcomes`` counts in the first batch only; a restart goes on from the checkpoint. Each batch
    overwrites a partition of its own, so that one that is repeated leaves no second copy.
    """
    rows = bar_rows(prices) if signals is None else bar_rows(prices).unionByName(signal_rows(signals))
    spark = prices.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        moved = batch.withColumns({"as_of_date": F.date_from_unix_date("day"), "last_date": F.date_from_unix_date("last_day")})
        stamp = F.current_timestamp() if now is None else now
        moved = evaluate(moved.drop("day", "last_day"))
        moved = moved.withColumn("evaluated_at", F.when(F.col("evaluation_status") != "PENDING", stamp)).withColumn("batch", F.lit(batch_id))
        moved.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table_path)

    with state_store(spark):
        found = rows.groupBy("ticker").transformWithState(
            OpenOutcomes(), FOUND, "Update", "None", initialState=open_signals(outcomes).groupBy("ticker")
        )
        return found.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tracked_outcomes(spark: SparkSession, table_path: str) -> DataFrame:
    """The last state of every outcome that was moved."""
    held = spark.read.parquet(table_path).drop("batch")
    return latest_by_key(held, ["run_id", "ticker"], [F.col("version")]).drop("version")
