"""Table access and shared-folder staging for the operators of this package."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as Java and Python regular expressions write it.
SPACE = r"\x20\x09-\x0D"
#: One word: a longest run of anything else.
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only a local session without that setting (tests) gets a new folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: its cluster clears the folder
        return


def staged(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: lineage ends there, and a
    lost executor loses nothing of it.  The copy is removed when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def freed(df: DataFrame) -> DataFrame:
    """`staged(df)`, after which the shuffle files of that run are removed, not when the driver's
    garbage happens to be collected."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return staged(df)
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def released(df: DataFrame) -> None:
    """Removes the copy behind `df = staged(...)`; nothing may read it any more."""
    for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("staged-"):
            _remove(df.sparkSession, folder)


def sampled(rows: DataFrame, key: Column, most: int, n: int) -> DataFrame:
    """At most `most` rows, those of least `key` (a 64-bit hash), of about `n` rows.

    Only rows whose key lies in the lowest share that holds some more than `most` are ordered, so
    that tasks don't each send `most` rows."""
    share = min(1.0, (1.2 * most + 50) / max(n, 1))
    last = min(2**63 - 1, int(-(2**63) + share * 2**64))
    return rows.withColumn("_key", key).where(F.col("_key") <= F.lit(last)).orderBy("_key").limit(most).drop("_key")


def small_batches(spark: SparkSession, most: int = 4_000_000) -> None:
    """From now on the session's Arrow batches hold about `most` bytes, not 10,000 texts of any length.

    A batch is held by the executor's JVM and by the Python worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def handing_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work` on the batches of a task, after which the worker gives the memory it freed back to the system.

    Spark keeps Python workers for the tasks to come; what their allocators hold on to counts
    as the executor's in all of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        hand_back()

    return run


def hand_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # only where the C library is glibc
        trim(0)


def of_one(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """As `handing_back`, for `work` on a group."""

    def run(group: pa.Table) -> pa.Table:
        out = work(group)
        hand_back()
        return out

    return run


def of_two(work: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """As `handing_back`, for `work` on a group of two tables."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        hand_back()
        return out

    return run


def words_of(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
