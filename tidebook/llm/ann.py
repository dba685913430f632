"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of a bounded size by hash.  A shard's graph has layers, each a flat
array of neighbour numbers per node; it is built by inserting nodes in growing batches, each
searching the graph so far, linked to diverse near nodes in both directions.  The graphs are
written as rows of flat arrays to the shared folder and searched by blocks of queries; the
shards' results are merged.  All rows are indexed.

Defined results: rows whose id or vector is null, or whose vector is empty, zero or holds null or
non-finite components, take no part; vectors meet those of their own length only; of several
rows with a query's id the least vector asks, and none of them is its candidate; equal vectors
are one node with its smallest ids, so ties are whole; an empty table gives no rows.  Scores are
cosines in double precision of the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import staged
from tidebook.llm.vectors import best, blocks, different, usable


class Graph:
    """Layers of neighbour arrays over unit vectors; -1 fills a row of neighbours."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], members: list[np.ndarray]):
        self.vectors, self.layers, self.members = vectors, layers, members

    def beam(self, layer: np.ndarray, asked: np.ndarray, entry: np.ndarray, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Best `width` nodes that each query reaches from its entry nodes, best first."""
        n = len(asked)
        seen = np.zeros((n, len(self.vectors)), bool)
        nodes = np.full((n, width), -1)
        score = np.full((n, width), -np.inf, np.float32)
        done = np.ones((n, width), bool)
        entry = entry[:, :width]
        e = entry.shape[1]
        nodes[:, :e] = entry
        score[:, :e] = np.where(entry >= 0, np.einsum("qed,qd->qe", self.vectors[entry], asked), -np.inf)
        done[:, :e] = entry < 0
        np.put_along_axis(seen, np.maximum(entry, 0), True, 1)
        active = np.arange(n)
        while len(active):
            waiting = np.where(done[active], -np.inf, score[active])
            pick = np.argpartition(-waiting, min(at_once, width) - 1, axis=1)[:, : min(at_once, width)]
            gain = np.take_along_axis(waiting, pick, 1)
            going = np.isfinite(gain)
            live = going.any(1)
            active, pick, going = active[live], pick[live], going[live]
            if not len(active):
                break
            rows = active[:, None]
            done[rows, pick] = True
            near = layer[np.maximum(nodes[rows, pick], 0)]
            near = np.where(going[:, :, None], near, -1).reshape(len(active), -1)
            near.sort(1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[rows, np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            seen[active[r], near[r, c]] = True
            value = np.full(near.shape, -np.inf, np.float32)
            value[r, c] = np.einsum("nd,nd->n", self.vectors[near[r, c]], asked[active[r]])
            all_score = np.concatenate([score[active], value], 1)
            all_nodes = np.concatenate([nodes[active], near], 1)
            all_done = np.concatenate([done[active], ~fresh], 1)
            keep = np.argpartition(-all_score, width - 1, axis=1)[:, :width]
            score[active] = np.take_along_axis(all_score, keep, 1)
            nodes[active] = np.take_along_axis(all_nodes, keep, 1)
            done[active] = np.take_along_axis(all_done, keep, 1) | ~np.isfinite(score[active])
        order = np.argsort(-score, axis=1, kind="stable")
        score = np.take_along_axis(score, order, 1)
        return np.where(np.isfinite(score), np.take_along_axis(nodes, order, 1), -1), score

    def search(self, asked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """From the top layer down by one best node, at the lowest layer by a beam."""
        entry = np.full((len(asked), 1), self.members[-1][0])
        for layer in self.layers[:0:-1]:
            entry = self.beam(layer, asked, entry, 1, 1)[0]
        return self.beam(self.layers[0], asked, entry, width)


def spread(vectors: np.ndarray, nodes: np.ndarray, score: np.ndarray, links: int) -> np.ndarray:
    """Of each row's nodes (best first, -1 fills) up to `links`: those nearer to the row's own
    node than to any taken before; then, if there is room, the best of the rest."""
    n, c = nodes.shape
    near = vectors[nodes]
    among = near @ near.transpose(0, 2, 1)
    taken, closest = np.zeros((n, c), bool), np.full((n, c), -np.inf, np.float32)
    count = np.zeros(n, np.int64)
    for j in range(c):
        take = (nodes[:, j] >= 0) & (score[:, j] > closest[:, j]) & (count < links)
        taken[:, j] = take
        count += take
        closest[take] = np.maximum(closest[take], among[take, j])
    rank = np.where(nodes < 0, 2 * c + np.arange(c), np.where(taken, 0, c) + np.arange(c))
    order = np.argsort(rank, axis=1)[:, :links]
    out = np.take_along_axis(nodes, order, 1)
    return out if c >= links else np.pad(out, [(0, 0), (0, links - c)], constant_values=-1)


def build(vectors: np.ndarray, links: int = 16, width: int = 64, batch: int = 256, seed: int = 5) -> Graph:
    n = len(vectors)
    level = np.minimum(np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(links)), 8).astype(int)
    level[0] = level.max()
    members = [np.flatnonzero(level >= x) for x in range(level[0] + 1)]
    layers = [np.full((n, 2 * links if x == 0 else links), -1) for x in range(level[0] + 1)]
    graph = Graph(vectors, layers, members)
    low = 1
    while low < n:
        new = np.arange(low, min(n, low + min(batch, low)))
        asked = vectors[new]
        entry = np.zeros((len(new), 1), np.int64)
        for x in range(level[0], -1, -1):
            joining = level[new] >= x
            nodes, score = graph.beam(layers[x], asked, entry, width if joining.any() else 1)
            entry = nodes[:, : max(1, min(4, nodes.shape[1]))]
            if joining.any():
                connect(graph, x, new[joining], nodes[joining], score[joining], links)
        low = int(new[-1]) + 1
    return graph


def connect(graph: Graph, x: int, new: np.ndarray, nodes: np.ndarray, score: np.ndarray, links: int) -> None:
    """Link new nodes to diverse ones among those found and those of their own batch."""
    vectors, layer = graph.vectors, graph.layers[x]
    own = vectors[new] @ vectors[new].T
    np.fill_diagonal(own, -np.inf)
    nodes = np.concatenate([nodes, np.broadcast_to(new, own.shape)], 1)
    score = np.concatenate([np.where(nodes[:, : score.shape[1]] >= 0, score, -np.inf), own], 1)
    order = np.argsort(-score, axis=1, kind="stable")[:, : 3 * links]
    nodes, score = np.take_along_axis(nodes, order, 1), np.take_along_axis(score, order, 1)
    nodes = np.where(np.isfinite(score), nodes, -1)
    chosen = spread(vectors, nodes, score, links)
    layer[new, : chosen.shape[1]] = chosen
    # The way back: each chosen node gets the new one, and keeps diverse ones if it has too many.
    to = chosen.ravel()
    source = np.repeat(new, chosen.shape[1])[to >= 0]
    to = to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    targets, first, count = np.unique(to, return_index=True, return_counts=True)
    for low in range(0, len(targets), 512):
        t, c = targets[low : low + 512], count[low : low + 512]
        more = np.full((len(t), int(c.max())), -1)
        nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        more[np.repeat(np.arange(len(t)), c), nth] = source[first[low] : first[low] + c.sum()]
        every = np.concatenate([layer[t], more], 1)
        every.sort(1)
        every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
        near = np.where(every >= 0, np.einsum("ncd,nd->nc", vectors[every], vectors[t]), -np.inf)
        order = np.argsort(-near, axis=1, kind="stable")
        every, near = np.take_along_axis(every, order, 1), np.take_along_axis(near, order, 1)
        full = (every >= 0).sum(1) > layer.shape[1]
        layer[t] = every[:, : layer.shape[1]] if every.shape[1] >= layer.shape[1] else np.pad(every, [(0, 0), (0, layer.shape[1] - every.shape[1])], constant_values=-1)
        if full.any():
            layer[t[full]] = spread(vectors, every[full], near[full], layer.shape[1])


def graphs(rows: DataFrame, k: int, shard_rows: int, links: int, width: int, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """The index, per shard its vectors, ids and layers as flat arrays, and the number of shards."""
    nonzero = usable(rows, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    nodes = staged(different(nonzero, k + 1).withColumn("width", F.size("v")))
    shards = blocks(nodes.count(), shard_rows)
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def make(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort([x[0] for x in group["ids"].to_pylist()], kind="stable")))
        v = group["v"].combine_chunks().flatten().to_numpy().reshape(len(group), -1)
        graph = build(unit(v).astype(np.float32), links, width)
        ids = group["ids"].to_pylist()
        return pa.table(
            {
                "width": group["width"].slice(0, 1), "shard": group["shard"].slice(0, 1),
                "vectors": pa.array([v.ravel()]), "ids": pa.array([[i for x in ids for i in x]], pa.list_(pa.int64())),
                "counts": pa.array([[len(x) for x in ids]], pa.list_(pa.int32())),
                "layers": pa.array([[x.ravel().astype(np.int32) for x in graph.layers]], pa.list_(pa.list_(pa.int32()))),
                "top": pa.array([int(graph.members[-1][0])], pa.int32()),
            }
        )

    made = dealt.groupBy("width", "shard").applyInArrow(
        make, "width int, shard int, vectors array<double>, ids array<long>, counts array<int>, layers array<array<int>>, top int"
    )
    return staged(made), shards


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cosine(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In double precision, safe for very large and very small components."""
    v, q = v / np.abs(v).max(1, keepdims=True), q / np.abs(q).max()
    return (v * q).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum()))


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    shard_rows: int = 4096,
    block_queries: int = 1024,
    links: int = 16,
    width: int = 64,
    search_width: int = 96,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found by cosine."""
    index, shards = graphs(rows, k, shard_rows, links, width, id_col, vector_col)
    nonzero = usable(rows, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    asked = nonzero.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))
    groups = blocks(asked.count(), block_queries)
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asking = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    asking = asking.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ["width", "shard", "part"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            q = right["v"].combine_chunks().flatten().to_numpy().reshape(len(right), -1)
            v = left["vectors"].combine_chunks().flatten().to_numpy().reshape(-1, q.shape[1])
            counts = left["counts"].combine_chunks().flatten().to_numpy()
            ids, ends = left["ids"].combine_chunks().flatten().to_numpy(), np.cumsum(counts)
            layers = [np.array(x).reshape(len(v), -1) for x in left["layers"][0].as_py()]
            graph = Graph(unit(v).astype(np.float32), layers, [left["top"].to_numpy()])
            asked_unit = unit(q).astype(np.float32)
            for low in range(0, len(q), 256):
                nodes, _ = graph.search(asked_unit[low : low + 256], min(search_width, len(v)))
                for query, vector, near in zip(right["vec_id"].slice(low, 256).to_pylist(), q[low : low + 256], nodes, strict=True):
                    near = near[near >= 0][: 2 * k + 8]
                    some = []
                    for node, score in zip(near.tolist(), cosine(v[near], vector).tolist(), strict=True):
                        some += [(-score, int(i)) for i in ids[ends[node] - counts[node] : ends[node]] if i != query]
                    found += [(query, i, -s) for s, i in sorted(some)[:k]]
        query_id, vec_id, score = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(query_id, pa.int64()), "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array(score, pa.float64())})

    found = held.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    return best(found, k)
