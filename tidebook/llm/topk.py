"""Exact top-k by integer inner product over a bit-sliced index.

A shard keeps its vectors as bitmaps: slice j of component d has, per row, bit j of the
component's distance from its least value, of which the top bits are kept (the quantised
attribute).  A query adds the slices as bitmaps, each weighted by the bits of its own component;
a negative weight takes the complement of the slices.  Carry-save adders over whole bitmaps give
the slices of all rows' sums; the k largest are found from the most significant slice downward.
What quantising leaves out has a known bound: every row within it of the k-th sum is resolved
exactly from the integers.

Defined results: rows whose id or vector is null, or whose vector is empty or holds null or
non-finite components, take no part; vectors meet those of their own length only; of several rows
with a query's id the least vector asks, and none of them is its candidate; equal vectors tie and
smaller ids win; an empty table gives no rows.  Integer scores must fit in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import staged
from tidebook.llm.vectors import best, blocks, different, usable

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def bitmaps(bits: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)])).view(np.uint64)


class SlicedShard:
    """The bit-sliced index of one shard's integer vectors."""

    def __init__(self, vectors: np.ndarray, keep_bits: int = 8):
        self.vectors = vectors
        self.least = vectors.min(0)
        span = int((vectors.max(0) - self.least).max())
        self.bits = min(keep_bits, max(1, span.bit_length()))
        self.drop = max(0, span.bit_length() - self.bits)
        high = (vectors - self.least) >> self.drop
        # slices[d, j]: bit j of the quantised component d of all rows
        self.slices = np.stack([bitmaps(((high >> j) & 1).T.astype(bool)) for j in range(self.bits)], axis=1)
        self.all = bitmaps(np.ones(len(vectors), bool))

    def sums(self, weight: np.ndarray) -> tuple[list[np.ndarray], int, int]:
        """Slices of each row's weighted sum of quantised components, how far they are shifted
        right, and the most by which the full sum is above them."""
        size = np.abs(weight)
        cut = max(0, int(size.max()).bit_length() - 12)
        short = size >> cut
        top = (1 << self.bits) - 1
        most = (size - (short << cut)).sum() * (top << self.drop) + size.sum() * ((1 << self.drop) - 1)
        flip = np.where(weight < 0, ALL, np.uint64(0))
        waiting: list[list[np.ndarray]] = []
        for k in range(max(1, int(short.max()).bit_length())):
            has = np.flatnonzero((short >> k) & 1)
            for j in range(self.bits):
                while len(waiting) <= j + k:
                    waiting.append([])
                if len(has):
                    waiting[j + k].append(self.slices[has, j] ^ flip[has, None])
        out, place = [], 0
        while place < len(waiting):
            rows = np.concatenate(waiting[place]) if waiting[place] else np.zeros((0, self.all.shape[-1]), np.uint64)
            while len(rows) > 1:
                n = len(rows) // 3
                if n:
                    a, b, c = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
                    half = a ^ b
                    total, carry = half ^ c, (a & b) | (c & half)
                    rows = np.concatenate([total, rows[3 * n :]])
                else:
                    carry, rows = rows[:1] & rows[1:], rows[:1] ^ rows[1:]
                if place + 1 == len(waiting):
                    waiting.append([])
                waiting[place + 1].append(carry)
            out.append(rows[0] if len(rows) else np.zeros(self.all.shape[-1], np.uint64))
            place += 1
        return out, cut + self.drop, int(most)

    def candidates(self, weight: np.ndarray, k: int) -> np.ndarray:
        """Numbers of the rows that can be among the k with the largest inner products."""
        slices, shift, most = self.sums(weight)
        open_, sure, kth = self.all, np.zeros_like(self.all), 0
        if len(self.vectors) <= k:
            return np.arange(len(self.vectors))
        for j in range(len(slices) - 1, -1, -1):
            above = sure | (open_ & slices[j])
            if int(np.bitwise_count(above).sum()) >= k:
                open_ = open_ & slices[j]
                kth |= 1 << j
            else:
                sure, open_ = above, open_ & ~slices[j]
        least = max(0, kth - (-(-most // (1 << shift))))
        enough, equal = np.zeros_like(self.all), self.all
        for j in range(len(slices) - 1, -1, -1):
            if least >> j & 1:
                equal = equal & slices[j]
            else:
                enough, equal = enough | (equal & slices[j]), equal & ~slices[j]
        if least.bit_length() > len(slices):
            return np.zeros(0, np.int64)
        return np.flatnonzero(np.unpackbits((enough | equal).view(np.uint8), bitorder="little")[: len(self.vectors)])


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    shard_rows: int = 16384,
    block_queries: int = 512,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product of floor(scale * x).

    `is_query` is a condition over vec_id and v."""
    whole = usable(rows, id_col, vector_col).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")
    )
    index = staged(different(whole, k + 1).withColumn("width", F.size("v")))
    asked = whole.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))
    shards, groups = blocks(index.count(), shard_rows), blocks(asked.count(), block_queries)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # By plain hash every shard of a large index has close to `shard_rows` rows.
    held = index.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).withColumn("part", every(groups))
    asking = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("shard", every(shards))
    keys = ["width", "shard", "part"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            def matrix(column: pa.ChunkedArray) -> np.ndarray:
                return column.combine_chunks().flatten().to_numpy().astype(np.int64).reshape(len(column), -1)

            shard = SlicedShard(matrix(left["v"]))
            ids = left["ids"].to_pylist()
            for query, vector in zip(right["vec_id"].to_pylist(), matrix(right["v"]), strict=True):
                # One more, as the query's own vector may be here.
                rows = shard.candidates(vector, k + 1)
                score = shard.vectors[rows] @ vector
                some = [(-s, i) for r, s in zip(rows.tolist(), score.tolist(), strict=True) for i in ids[r] if i != query]
                found += [(query, i, -s) for s, i in sorted(some)[:k]]
        query_id, vec_id, score = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(query_id, pa.int64()), "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array(score, pa.int64())})

    found = held.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    return best(found, k)
