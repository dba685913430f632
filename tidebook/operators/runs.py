"""Scan-run bookkeeping as table operators. "Now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.days import day_bits, day_sets, days_held, united

COMPONENTS = (
    "accumulation_score",
    "operator_dominance_score",
    "cost_basis_score",
    "retail_exhaustion_score",
    "foreign_institutional_score",
    "supply_concentration_score",
    "price_flow_divergence_score",
    "market_context_score",
    "smc_execution_score",
    "risk_liquidity_score",
    "price_data_quality_score",
)


def reap_stale_runs(runs: DataFrame, now: Column, max_age_minutes: int | None = 45) -> DataFrame:
    """All runs, RUNNING ones with a heartbeat older than the age marked FAILED.

    The age must lie within 15..120 minutes. ``reaped`` marks the changed rows.
    """
    age = 45 if max_age_minutes is None else int(max_age_minutes)
    if not 15 <= age <= 120:
        raise ValueError("max_age_minutes must lie within 15 and 120")
    seen = F.coalesce("heartbeat_at", "started_at")
    stale = F.coalesce((F.col("status") == "RUNNING") & (seen < now - F.expr(f"INTERVAL {age} MINUTES")), F.lit(False))
    reason = F.create_map(
        F.lit("stale_failure_reason"),
        F.lit("SERVER_CRON_STALE_HEARTBEAT"),
        F.lit("stale_reaped_at"),
        now.cast("string"),
        F.lit("stale_max_age_minutes"),
        F.lit(str(age)),
    )
    own = F.coalesce("config", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(own, lambda k, v: ~k.isin("stale_failure_reason", "stale_reaped_at", "stale_max_age_minutes"))
    marked = runs.withColumn("reaped", stale)
    hit = F.col("reaped")
    return marked.withColumns(
        {
            "status": F.when(hit, F.lit("FAILED")).otherwise(F.col("status")),
            "completed_at": F.when(hit, now).otherwise(F.col("completed_at")),
            "current_ticker": F.when(~hit, F.col("current_ticker")),
            "error_count": F.when(hit, F.greatest(F.coalesce("error_count", F.lit(0)), F.lit(1))).otherwise(
                F.col("error_count")
            ),
            "config": F.when(hit, F.map_concat(kept, reason)).otherwise(F.col("config")),
        }
    )


def mark_stale_managed_runs(runs: DataFrame, now: Column, max_age_minutes: int = 45, cap: int = 45) -> DataFrame:
    """The simpler variant: the age must lie within 1 and ``cap`` minutes."""
    age = int(max_age_minutes)
    if not 1 <= age <= cap:
        raise ValueError(f"max_age_minutes must lie within 1 and {cap}")
    seen = F.coalesce("heartbeat_at", "started_at")
    stale = (F.upper("status") == "RUNNING") & (seen < now - F.expr(f"INTERVAL {age} MINUTES"))
    hit = F.coalesce(stale, F.lit(False))
    return runs.withColumn("reaped", hit).withColumns(
        {
            "status": F.when(F.col("reaped"), F.lit("FAILED")).otherwise(F.col("status")),
            "completed_at": F.when(F.col("reaped"), now).otherwise(F.col("completed_at")),
            "current_ticker": F.when(~F.col("reaped"), F.col("current_ticker")),
        }
    )


def resolve_duplicate_runs(runs: DataFrame, now: Column) -> DataFrame:
    """Keeps the newest RUNNING run of every universe signature and fails the others.

    The newest is found by a map-side combined aggregate, so a signature with
    very many runs is never gathered in one task.
    """
    signature = F.col("config.universe_signature")
    active = (F.col("status") == "RUNNING") & (F.coalesce(signature, F.lit("")) != "")
    order = F.struct(
        F.col("heartbeat_at").isNotNull().alias("has"), F.col("heartbeat_at"), F.col("started_at"), F.col("id")
    )
    newest = (
        runs.where(active).groupBy(signature.alias("_signature")).agg(F.max(order)["id"].alias("_newest"))
    )
    joined = runs.join(newest, active & (signature == F.col("_signature")), "left")
    hit = F.coalesce(F.col("_newest") != F.col("id"), F.lit(False))
    return joined.withColumn("superseded", hit).withColumns(
        {
            "status": F.when(F.col("superseded"), F.lit("FAILED")).otherwise(F.col("status")),
            "completed_at": F.when(F.col("superseded"), now).otherwise(F.col("completed_at")),
            "current_ticker": F.when(~F.col("superseded"), F.col("current_ticker")),
        }
    ).drop("_signature", "_newest")


def repair_run_states(runs: DataFrame, now: Column, obsolete_version: str = "0.1.2") -> DataFrame:
    """COMPLETED runs without results and RUNNING runs of an obsolete version become FAILED."""
    empty = (F.col("status") == "COMPLETED") & (F.col("processed_count") == 0)
    old = (F.col("status") == "RUNNING") & (F.coalesce(F.col("config.version"), F.lit("")) == obsolete_version)
    hit = F.coalesce(empty | old, F.lit(False))
    return runs.withColumn("repaired", hit).withColumns(
        {
            "status": F.when(F.col("repaired"), F.lit("FAILED")).otherwise(F.col("status")),
            "completed_at": F.when(F.col("repaired"), F.coalesce("completed_at", now)).otherwise(F.col("completed_at")),
            "heartbeat_at": F.when(F.col("repaired"), F.coalesce("heartbeat_at", now)).otherwise(F.col("heartbeat_at")),
            "current_ticker": F.when(~F.col("repaired"), F.col("current_ticker")),
        }
    )


def evidence_telemetry(results: DataFrame, vendor: DataFrame, official: DataFrame, days: int = 45) -> DataFrame:
    """Per run: covered tickers, distinct flow days in the window, histogram of sources.

    ``results`` holds run_id, ticker, as_of_date, foreign_evidence_source and
    foreign_evidence_coverage_pct.
    """
    covered = F.coalesce("foreign_evidence_coverage_pct", F.lit(0.0)) > 0
    named = covered & (F.coalesce("foreign_evidence_source", F.lit("")) != "")
    counts = results.groupBy("run_id").agg(
        F.count(F.when(covered, True)).alias("foreign_evidence_tickers"), F.max("as_of_date").alias("as_of")
    )
    per_source = (
        results.where(named)
        .groupBy("run_id", "foreign_evidence_source")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("run_id")
        .agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("foreign_evidence_source", "n")))).alias(
                "foreign_evidence_sources"
            )
        )
    )
    # A ticker's flow days are bitmaps, a run's days those of its tickers merged; only the days of
    # the run's window are then looked up, once a run.
    flows = vendor.select("ticker", "trade_date").unionAll(official.select("ticker", "trade_date"))
    bits = day_bits(flows, ["ticker"], "trade_date")
    run_days = day_sets(united(results.select("run_id", "ticker").join(bits, "ticker"), ["run_id"]), ["run_id"], "_days")
    window_days = f"sequence(date_sub(as_of, {days}), as_of)"
    in_window = F.expr(f"CAST({days_held('_days', window_days)} AS BIGINT)")
    return (
        counts.join(run_days, "run_id", "left")
        .withColumn("foreign_evidence_days", F.when(F.col("_days").isNotNull() & F.col("as_of").isNotNull(), in_window))
        .drop("as_of", "_days")
        .join(per_source, "run_id", "left")
        .withColumns(
            {
                "foreign_evidence_days": F.coalesce("foreign_evidence_days", F.lit(0)),
                "foreign_evidence_sources": F.coalesce(
                    "foreign_evidence_sources", F.create_map().cast("map<string,bigint>")
                ),
            }
        )
    )


def result_records(results: DataFrame, run_id: str) -> DataFrame:
    """Results in storage form: key columns, components struct, diagnostics struct."""
    keep = (
        "ticker",
        "as_of_date",
        "final_score",
        "phase",
        "action",
        "evidence_tier",
        "evidence_coverage_pct",
        "real_money_state",
        "distribution_risk",
        "estimated_smart_money_cost",
        "premium_to_cost_pct",
        "entry_low",
        "entry_high",
        "invalidation",
        "tp1",
        "tp2",
    )
    return results.select(
        F.lit(run_id).alias("run_id"), *keep, F.struct(*COMPONENTS).alias("components"), "diagnostics", "guardrail_reason"
    )


def persisted_results(stored: DataFrame, run_id: str, limit: int | None = None) -> DataFrame:
    """One run's results, best first, with the component scores as columns again.

    All of them, unless a caller asks for the best ``limit``.
    """
    rows = stored.where(F.col("run_id") == run_id).orderBy(F.col("final_score").desc(), "ticker")
    rows = rows if limit is None else rows.limit(limit)
    return rows.withColumns({c: F.col(f"components.{c}") for c in COMPONENTS})


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(limit)


