"""Runs whose heartbeat stops, found as time passes: one event-time limit for each open run.

The batch reaper looks at every run row on a schedule. Here the state is a table of the runs that
are open: each with its newest update, until the time at which its heartbeat would be too old. A
batch merges what it brings into that table and takes out the runs whose time has passed, so it costs
the open runs and its own rows, and no task handles a run by itself. Time is the watermark of the
updates' arrival times, so a replay gives what the live stream gave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebook.functions.frames import latest_by_key
from tidebook.sources.sinks import remove

#: A state row; one without id holds the watermark in ``at``.
KEPT = "id long, status string, error_count int, seen long, at timestamp, due boolean"


def run_updates(runs: DataFrame, at: Column) -> DataFrame:
    """Run rows as updates that arrived at ``at``; a row without id is a tick."""
    seen = F.unix_micros(F.coalesce("heartbeat_at", "started_at", at).cast("timestamp"))
    return runs.select("id", F.col("status"), F.col("error_count").cast("int").alias("error_count"), seen.alias("seen"), at.cast("timestamp").alias("at"))


def watch_runs(
    updates: DataFrame, table_path: str, checkpoint: str, max_age_minutes: int = 45, delay: str = "0 seconds"
) -> StreamingQuery:
    """Streams ``run_updates`` and appends every run that goes stale; the age must lie within 15..120 minutes."""
    if not 15 <= max_age_minutes <= 120:
        raise ValueError("max_age_minutes must lie within 15 and 120")

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, mine = batch.sparkSession, f"{checkpoint}/runs/batch={batch_id}"
        rows, passed = batch.select("id", "status", "error_count", "seen", "at"), None
        if batch_id:
            held = spark.read.schema(KEPT).parquet(f"{checkpoint}/runs/batch={batch_id - 1}").where("NOT due").drop("due")
            passed = held.where("id IS NULL").agg(F.max(F.unix_millis("at"))).first()[0]
            if passed is not None:  # what arrives behind the watermark is too late
                rows = rows.where(F.col("at") > F.timestamp_millis(F.lit(passed)))
            rows = held.where("id IS NOT NULL").unionByName(rows)
        newest = batch.agg(F.max(F.unix_millis(F.col("at") - F.expr(f"INTERVAL {delay}")))).first()[0]
        now = max((t for t in (passed, newest) if t is not None), default=None)
        ended = F.coalesce("status", F.lit("")) != "RUNNING"  # of equally new updates the run's end counts
        runs = latest_by_key(rows.where("id IS NOT NULL"), ["id"], [F.col("seen"), ended, F.col("status"), F.col("error_count")])
        # Stale once more than the age has passed, in whole milliseconds. A run that ended stays as long,
        # so that late updates do not revive it.
        due = F.expr("seen div 1000") + max_age_minutes * 60_000 + 1 <= F.lit(now).cast("long")
        clock = spark.range(1).select(
            *(F.lit(None).cast(kind).alias(c) for c, kind in (("id", "long"), ("status", "string"), ("error_count", "int"), ("seen", "long"))),
            F.timestamp_millis(F.lit(now).cast("long")).alias("at"), F.lit(False).alias("due"),
        )
        runs.withColumn("due", F.coalesce(due, F.lit(False))).unionByName(clock).write.mode("overwrite").parquet(mine)
        found = spark.read.schema(KEPT).parquet(mine).where("due AND status = 'RUNNING'").select(
            "id", F.lit("FAILED").alias("status"), F.greatest(F.coalesce("error_count", F.lit(0)), F.lit(1)).alias("error_count"), "seen",
            (F.lit(now).cast("long") * 1000).alias("reaped_at"), F.lit(max_age_minutes).alias("max_age_minutes"), F.lit(batch_id).alias("batch"),
        )
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table_path)
        if batch_id > 1:  # the batch before may be needed again, if this one is
            remove(spark, f"{checkpoint}/runs/batch={batch_id - 2}")

    return updates.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stale_found(spark: SparkSession, table_path: str) -> DataFrame:
    """Runs found stale, each once, with the columns of the batch reaper."""
    held = latest_by_key(spark.read.parquet(table_path), ["id"], [F.col("reaped_at")])
    return held.select(
        "id", "status", "error_count", F.timestamp_micros("reaped_at").alias("completed_at"), F.lit("SERVER_CRON_STALE_HEARTBEAT").alias("stale_failure_reason"),
        F.col("max_age_minutes").cast("string").alias("stale_max_age_minutes"),
    )
