"""What both vector searches share: clean vectors, different vectors once each, blocks of pairs.

A search meets every query with every shard of the index.  Both sides are dealt into blocks of a
bounded size, and a pair of blocks is one group: the work is queries times rows by contract, but
no task holds more than one block of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v as array<double>) of the rows that take part: id not null, vector not null and
    not empty, all its components finite."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite
    )


def different(rows: DataFrame, keep: int, kind: str = "double") -> DataFrame:
    """One row per different vector: v, its `keep` smallest ids in order (ids).

    A search for fewer than `keep` rows needs no more of equal vectors, as ties go to smaller
    ids.  The window's rank is cut in each task first, so that a vector with many copies sends
    `keep` rows from each."""
    by = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= keep)
    return first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows per query out of all shards' best."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
