"""Frame helpers: keyed dedupe, distributed ranks, scalar sub-results."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks required columns: {missing}")


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the one with the largest ``order`` tuple, nulls smallest."""
    return _extreme_by_key(df, keys, order, F.max)


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the one with the smallest ``order`` tuple, nulls smallest."""
    return _extreme_by_key(df, keys, order, F.min)


def _extreme_by_key(df, keys, order, extreme) -> DataFrame:
    """Keyed dedupe as an aggregate.

    The copies of a hot key are reduced to one row inside every map task, so no
    task ever holds them together as a window would. The remaining columns end
    the compared tuple, which makes the choice the same on every run.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = df.select(*keys, F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest).alias("_row"))
    best = packed.groupBy(*keys).agg(extreme("_row").alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def last_by_key(df: DataFrame, keys: Sequence[str], order: str | None, what: str) -> DataFrame:
    """One row per key: of several the last by the column ``order``, which the result has no more.

    Where no order is known, repeats of a row are one, and rows of a key that differ are an error:
    which of them came last can't be told from their values."""
    if order is not None:
        return latest_by_key(df, keys, [F.col(order)]).drop(order)
    rest = [c for c in df.columns if c not in keys]
    print_ = F.xxhash64(*rest) if rest else F.lit(0)
    packed = df.select(*keys, F.struct(*rest).alias("_row"), print_.alias("_print"))
    best = packed.groupBy(*keys).agg(F.max("_row").alias("_row"), F.min("_print").alias("_low"), F.max("_print").alias("_high"))
    text = F.concat(F.lit(f"{what}: rows that differ for one key, and no order among them: "), F.to_json(F.struct(*keys)))
    row = F.when(F.col("_low") == F.col("_high"), F.col("_row")).otherwise(F.raise_error(text))
    best = best.select(*keys, row.alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def one_row(df: DataFrame, *columns: str) -> Column:
    """A one-row frame as a struct column (uncorrelated scalar sub-query)."""
    names = columns or tuple(df.columns)
    return df.select(F.struct(*names).alias("_ctx")).scalar()


def average_rank_pct(df: DataFrame, value: str, out: str, ranges_per_octave: int = 16) -> DataFrame:
    """Cross-section percentile rank (0..1], ties share their mean rank.

    No task sees the whole column. Equal values are first merged into counts,
    the counts are spread over ranges of magnitude, and a rank is the number of
    rows in the lower ranges plus the rank inside the range. Null values get a
    null rank. ``<out>_n`` holds the number of ranked rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    octave = F.floor(F.log2(F.abs(value)) * ranges_per_octave) + F.lit(1200 * ranges_per_octave)
    ranged = counts.withColumn(
        "_range", F.when(F.col(value) == 0, F.lit(0)).otherwise((F.signum(value) * octave).cast("int"))
    )
    # One row per range of magnitude: a number bounded by the double format.
    sizes = ranged.groupBy("_range").agg(F.sum("_n").alias("_size"))
    lower = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(
        "_range",
        F.coalesce(F.sum("_size").over(lower), F.lit(0)).alias("_before"),
        F.sum("_size").over(everything).alias("_total"),
    )
    inside = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = (
        ranged.withColumn("_upto", F.sum("_n").over(inside))
        .join(offsets, "_range")
        .select(
            value,
            ((F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)) / F.col("_total")).alias(out),
            F.col("_total").alias(f"{out}_n"),
        )
    )
    return df.join(ranks, value, "left")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    For a frame that several branches of a plan read. The copy lives in the
    folder the cluster names in ``spark.checkpoint.dir`` and so survives the
    loss of executors. Where that is unset, a session in one process takes a local
    folder and a cluster session is refused. The copy is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/tidebook/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def staged_together(frames: dict[str, DataFrame]) -> list[DataFrame]:
    """Frames staged by jobs that run at the same time, so that one's joins are prepared in the
    driver, or its last tasks end, while the tasks of another fill the cores."""
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(inheritable_thread_target(staged), frames.values(), frames))


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return  # the session has ended: its cluster clears the folder
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
