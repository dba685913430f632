"""Writers: keyed upsert, verified append, partitioned caches, exports, audit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions.frames import latest_by_key, staged
from tidebook.functions.scalars import finite_or_null

# Storage keys.
KEYS = {
    "prices": ("ticker", "trade_date", "source"),
    "broker": ("ticker", "trade_date", "broker_code", "market_type", "source"),
    "official": ("ticker", "trade_date", "source"),
    "vendor": ("ticker", "trade_date", "source", "market_type"),
    "results": ("run_id", "ticker"),
    "outcomes": ("run_id", "ticker"),
}


class WriteMismatch(RuntimeError):
    """A written partition does not hold the rows that were to be written."""


def held_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def upsert(df: DataFrame, path: str, keys: Sequence[str], partition: str, order: Sequence[Column] = ()) -> None:
    """Inserts or replaces rows by key in a Parquet table partitioned by ``partition``.

    Only the partitions that receive rows are read and rewritten. The merged
    rows are staged first, so a lost executor or a failed commit can be redone
    from complete data. One writer at a time. ``order`` decides between rows of
    ``df`` itself that share a key. ``partition`` must be one of the keys or follow from them
    (then name it among ``keys``): otherwise a key could be held in two partitions.
    """
    if partition not in keys:
        raise ValueError(f"partition {partition} must be one of the keys {list(keys)}")
    spark = df.sparkSession
    fresh = latest_by_key(df, list(keys), list(order))
    held = held_table(spark, path)
    if held is not None:
        fresh = staged(fresh, "upsert-in")
        touched = fresh.select(partition).distinct()
        held = held.join(touched, partition, "left_semi")
        both = held.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        fresh = staged(latest_by_key(both, list(keys), [F.col("_new")]).drop("_new"), "upsert-out")
    # Few files per partition value, while a value with very many rows is split over tasks.
    fresh = fresh.hint("rebalance", partition)
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_results(df: DataFrame, path: str, run_id: str, write: Callable[[DataFrame], None] | None = None) -> int:
    """Writes one run's rows and reads the partition back; a differing count fails the run.

    What is to be written is counted while it is written, so the rows are made once. ``write`` takes
    the place of the Parquet writer where the rows go through something else."""
    spark = df.sparkSession
    counts, asked = Observation(), [F.count(F.lit(1)).alias("rows")]
    rows = df.withColumn("run_id", F.lit(run_id)).observe(counts, *asked)
    if write is not None:
        write(rows)
    else:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    expected = _observed(counts, df, asked)["rows"]
    held = held_table(spark, path)
    written = 0 if held is None else held.where(F.col("run_id") == run_id).count()
    if written != expected:
        raise WriteMismatch(f"run {run_id}: expected {expected} rows, found {written}")
    return written


def _observed(counts: Observation, rows: DataFrame, asked: Sequence[Column]) -> dict[str, int]:
    """What was counted while writing; counted anew where the optimizer saw that there can be no
    rows to write, and left the counting out."""
    try:
        return counts.get
    except Py4JJavaError:
        return rows.agg(*asked).first().asDict()


def land_accepted(
    rows: DataFrame, accept: Column, path: str, audit_path: str, provider: str, dataset: str, min_rows: int = 80
) -> dict[str, int]:
    """Writes the rows that are accepted and appends one audit row; received, accepted and rejected
    are counted in the same pass. A condition that is null rejects."""
    counts, good = Observation(), F.coalesce(accept, F.lit(False))
    asked = [F.count(F.lit(1)).alias("received"), F.count_if(good).alias("accepted")]
    rows.observe(counts, *asked).where(good).write.mode("append").parquet(path)
    found = _observed(counts, rows, asked)
    found["rejected"] = found["received"] - found["accepted"]
    status = "COMPLETED" if found["accepted"] >= min_rows else "INSUFFICIENT"
    row = (provider, dataset, status, found["received"], found["accepted"], found["rejected"])
    schema = "provider string, dataset string, status string, rows_received long, rows_accepted long, rows_rejected long"
    append_audit(rows.sparkSession.createDataFrame([row], schema), audit_path)
    return found


def _finite(x: Column, kind: T.DataType) -> Column:
    """x with null in place of every NaN and infinity, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite_or_null(x)
    if isinstance(kind, T.StructType):
        parts = [_finite(x.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(x.isNotNull(), F.struct(*parts)) if parts else x
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: _finite(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: _finite(v, kind.valueType))
    return x


def strict_json(df: DataFrame) -> DataFrame:
    """One JSON object text per row; NaN and infinities become null, days ISO text."""
    safe = [_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))


def land_partitioned(df: DataFrame, path: str, partition: str = "trade_date") -> None:
    """Cache table partitioned by day, the splittable form of a gzip file."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)


def write_meta(stats: DataFrame, path: str) -> None:
    """One-row statistics as JSON."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Flat columns only, as CSV files with a header."""
    nested = [n for n, t in df.dtypes if t.startswith(("struct", "array", "map"))]
    df.drop(*nested).write.mode("overwrite").option("header", True).csv(path)


def audit_rows(accepted: DataFrame, requested: DataFrame, provider: str, dataset: str, min_bars: int = 80) -> DataFrame:
    """One audit row per requested ticker with its status by accepted rows."""
    counts = accepted.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("freshness_date"))
    n = F.coalesce("n", F.lit(0))
    return requested.select("ticker").distinct().join(counts, "ticker", "left").select(
        F.lit(provider).alias("provider"),
        F.lit(dataset).alias("dataset"),
        "ticker",
        F.when(n >= min_bars, F.lit("COMPLETED")).otherwise(F.lit("INSUFFICIENT")).alias("status"),
        n.alias("rows_accepted"),
        "freshness_date",
    )


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def partitions(spark: SparkSession, path: str) -> list[dict[str, str]]:
    """The first level of partition folders of a table, as column and value; names only, no data."""
    files, where = _file_system(spark, path)
    if not files.exists(where):
        return []
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    found = []
    for status in files.listStatus(where):
        column, sign, value = status.getPath().getName().partition("=")
        if status.isDirectory() and sign:
            found.append({column: unescape(value)})
    return found


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a folder of a table; false where there is none."""
    files, where = _file_system(spark, path)
    return files.delete(where, True)


def drop_partitions(spark: SparkSession, path: str, column: str, first: str) -> list[str]:
    """Deletes the partitions whose value sorts before ``first`` (days as ISO text): retention of a
    table by folders, without reading or rewriting a row. Returns the values dropped."""
    old = sorted(p[column] for p in partitions(spark, path) if column in p and p[column] < first)
    for value in old:
        remove(spark, f"{path}/{column}={value}")
    return old
