"""Near-duplicate documents by improved consistent weighted sampling.

A text's features are its different runs of five words (A-Z in lower case), weighted by
(1 + ln tf) * idf.  idf comes from the number of all documents that hold the run, counted over
the whole corpus in a table of a fixed number of hashed cells (`cells`), so that it can go to
every task whatever the corpus; it lies between 1 and 1.25, so that one common passage weighs
less than a rare one, but a large group of copies does not lose its likeness by being large.

Each of `bands * rows` samples draws one (run, level) of a text such that two texts draw the same
with a chance equal to their weighted Jaccard similarity.  Texts that agree on all samples of a
band share a bucket.  A bucket's leader, a text drawn at random, is compared with all its other
texts; those in no component with it choose new leaders among themselves, which are compared with
all of the bucket outside their components, until none is left.  So a bucket costs its size for each
different kind of text in it, not its square, and other bands draw other leaders.  Components are
kept from round to round, and only one edge for each two of them is handed on.  After the first
round, texts that cannot be like any other by what they hold alone, and pairs whose bitmaps of runs
differ in too many bits, are not compared.  In buckets
that had more texts open after the first round than lead in the second, texts that never led and
are in different components meet at the end, but for pairs out of reach by what other components
hold, so that no two texts of a bucket that are alike stay apart.  A pair is linked if its exact
weighted or plain Jaccard similarity is `least` or more.  Classes are connected components, found by
rounds of joins.

Texts with the same words are one node from the start, so copies never meet each other.

Defined results: a text without words (null, empty, white space) is its own class; one of fewer
than five words has a single run of them all; rows with the same words share a class; a null doc_id
gets the class of its text too, and names a class only where all its ids are null; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import handing_back, staged
from tidebook.llm.textbytes import LOWER, SLICE, distinct, flat, mixed, shingles, slices, word_hashes, words

SIZE = 5
#: What is known of a node by its own text and its set: see shared_at_most.
BOUNDS = {"n": "double", "w": "double", "s": "double", "sw": "double", "bits": "array<long>"}


def runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different runs of five words of each text: hash, text, times; and words per text."""
    low = LOWER[data]
    start, end, first = words(low, at)
    found, whose = shingles(word_hashes(low, start, end), first, SIZE)
    return (*distinct(found, whose), np.diff(first))


def identity(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each text's words in order."""
    low = LOWER[data]
    start, end, first = words(low, at)
    h, n = word_hashes(low, start, end), np.diff(first)
    nth = (np.arange(len(h)) - np.repeat(first[:-1], n)).astype(np.uint64)
    out = np.zeros((2, len(n)), np.uint64)
    has = np.flatnonzero(n)
    with np.errstate(over="ignore"):
        for k, salt in enumerate((0x1234567, 0x89ABCDE)):
            stirred = mixed(h ^ mixed(nth * np.uint64(2) + np.uint64(salt)))
            if len(has):
                out[k, has] = mixed(np.add.reduceat(stirred, first[:-1][has]) + n[has].astype(np.uint64))
    return out


class Sampler:
    """Improved consistent weighted sampling.

    For a feature and a sample, r and c follow Gamma(2, 1) and beta is uniform, all read off a
    hash of both.  Then t = floor(ln w / r + beta), ln a = ln c - r * (t - beta + 1), and the
    text's draw is the feature of least a, with its t."""

    def __init__(self, samples: int, seed: int):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(1, 1 << 62, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x).
        x = np.concatenate([np.geomspace(1e-7, 0.01, 4000), np.linspace(0.01, 40, 400_000)[1:]])
        share = (np.arange(1 << 16) + 0.5) / (1 << 16)
        self.gamma = np.interp(share, -np.expm1(np.log1p(x) - x), x).astype(np.float32)
        self.log_gamma = np.log(self.gamma)
        self.inverse = (1 / self.gamma).astype(np.float32)

    def draws(self, found: np.ndarray, first: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
        """(samples, texts) hashes of what each text draws; `first` is where its features begin,
        and every text has some."""
        out = np.empty((len(self.factors), len(first)), np.uint64)
        size = np.diff(np.append(first, len(found)))
        owner = np.repeat(np.arange(len(first)), size)
        log_weight = log_weight.astype(np.float32)
        for k, factor in enumerate(self.factors):
            with np.errstate(over="ignore"):
                h = found * factor
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
            one, two, three = h & np.uint64(0xFFFF), (h >> np.uint64(16)) & np.uint64(0xFFFF), h >> np.uint64(32)
            r = self.gamma[one]
            beta = (three & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(log_weight * self.inverse[one] + beta)
            # The last 16 bits tell equal quantiles of c apart.
            a = self.log_gamma[two] - r * (t - beta + np.float32(1)) + (three >> np.uint64(16)).astype(np.float32) * np.float32(1e-10)
            least = np.minimum.reduceat(a, first)
            hit = np.flatnonzero(a == least[owner])
            pick = hit[np.searchsorted(owner[hit], np.arange(len(first)))]
            with np.errstate(over="ignore"):
                out[k] = mixed(found[pick] + mixed(t[pick].astype(np.int64).astype(np.uint64) + np.uint64(k * 131 + 7)))
        return out


def document_counts(docs: DataFrame, cells: int) -> tuple[np.ndarray, int]:
    """How many different runs of texts fall into each hashed cell, over all texts; and how many
    texts there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, texts = np.zeros(cells, np.int64), 0
        for batch in batches:
            data, at = flat(batch.column(0))
            texts += len(batch)
            for low, high in slices(at, SLICE):
                found = runs(data[at[low] : at[high]], at[low : high + 1] - at[low])[0]
                sums += np.bincount((found >> np.uint64(11)).astype(np.int64) % cells, minlength=cells)
        block = 4096
        for low in range(0, cells, block):
            yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([sums[low : low + block]]), pa.array([texts if not low else 0])], names=["low", "sums", "texts"])

    parts = docs.select("text").mapInArrow(handing_back(count), "low long, sums array<long>, texts long")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Row by row, so that a part of the table never holds more than its sums.
        sums: dict[int, np.ndarray] = {}
        texts = 0
        for batch in batches:
            for low, x, n in zip(batch.column("low").to_pylist(), batch.column("sums"), batch.column("texts").to_pylist(), strict=True):
                sums[low] = sums.get(low, 0) + x.values.to_numpy()
                texts += n
        for low, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([x]), pa.array([texts])], names=["low", "sums", "texts"])
            texts = 0

    out, texts = np.zeros(cells, np.int64), 0
    for r in parts.repartition("low").mapInArrow(add, "low long, sums array<long>, texts long").collect():
        out[r["low"] : r["low"] + len(r["sums"])] = r["sums"]
        texts += r["texts"]
    return out, texts


def idf_of(counts: np.ndarray, texts: int) -> np.ndarray:
    """Between 1 and 1.25 by how many documents hold a run.  A cell holds many rare runs; what it
    has above the median cell is put down to a common one."""
    usual = float(np.median(counts)) if len(counts) else 0.0
    common = 1.0 + np.maximum(counts - usual - 4 * np.sqrt(usual + 1), 0)
    top = np.log(max(2.0, texts + 1.0))
    return (1.0 + 0.25 * np.clip((top - np.log(common)) / top, 0, 1)).astype(np.float32)


def weights(found: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(times)) * idf[(found >> np.uint64(11)).astype(np.int64) % len(idf)]


def signed(docs: DataFrame, idf: np.ndarray, bands: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, _k1, _k2, node, keys): the hash of a text's words as hex, null without words, and its band keys."""
    sampler_of: list[Sampler] = []
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sampler_of:
            sampler_of.append(Sampler(bands * rows, seed))
        for batch in batches:
            data, at = flat(batch.column("text"))
            for low, high in slices(at, SLICE):
                part, begin = data[at[low] : at[high]], at[low : high + 1] - at[low]
                found, whose, times, n = runs(part, begin)
                has = np.flatnonzero(n)
                keys = np.zeros((high - low, bands), np.int64)
                if len(has):
                    first = np.searchsorted(whose, has)
                    drawn = sampler_of[0].draws(found, first, np.log(weights(found, times, idf)))
                    with np.errstate(over="ignore"):
                        for band in range(bands):
                            key = np.full(len(has), np.uint64(band))
                            for x in drawn[band * rows : (band + 1) * rows]:
                                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + x)
                            keys[has, band] = key.view(np.int64)
                one, two = identity(part, begin)
                node = [f"{a:016x}{b:016x}" if k else None for a, b, k in zip(one.tolist(), two.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x).slice(low, high - low) for x in ("doc_id", "_k1", "_k2")), pa.array(node, pa.string()), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands).cast(pa.list_(pa.int64()))],
                    names=["doc_id", "_k1", "_k2", "node", "keys"],
                )

    return docs.select("doc_id", "text", "_k1", "_k2").mapInArrow(handing_back(sign), f"doc_id {kind}, _k1 long, _k2 int, node string, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """Of pairs (a, b) those whose texts' exact similarity is `least` or more.

    Both joins are plain ones on a node, so that a node with very many partners is split."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, one_at = flat(batch.column("text_a"))
            two, two_at = flat(batch.column("text_b"))
            good = np.zeros(len(batch), bool)
            for low, high in slices(one_at + two_at, SLICE):
                sides = []
                for data, at in ((one, one_at), (two, two_at)):
                    found, whose, times, _ = runs(data[at[low] : at[high]], at[low : high + 1] - at[low])
                    sides.append((found, whose, weights(found, times, idf)))
                found, whose, w = (np.concatenate(x) for x in zip(*sides, strict=True))
                order = np.lexsort((found, whose))
                found, whose, w = found[order], whose[order], w[order]
                same = np.flatnonzero((found[1:] == found[:-1]) & (whose[1:] == whose[:-1]))
                n = high - low
                shared, smaller = np.bincount(whose[same], minlength=n), np.bincount(whose[same], np.minimum(w[same], w[same + 1]), n)
                total, count = np.bincount(whose, w, n), np.bincount(whose, minlength=n)
                near = (smaller >= least * np.maximum(total - smaller, 1e-12) - 1e-9) | (shared >= least * np.maximum(count - shared, 1) - 1e-9)
                good[low:high] = near & (shared > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(handing_back(alike), "a string, b string")


def components(links: DataFrame) -> DataFrame:
    """(node, class): every linked node with the least node of its component.

    Rounds of large-star and small-star: every node's neighbours are tied to the least of them,
    until nothing changes.  Each round is two aggregations by node over links, and is written."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        # Large star: of a node's neighbours, the larger ones are tied to the least of all.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its smaller neighbours are tied to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = staged(small.where("u != v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("class"))
        before = now


def run_bits(found: np.ndarray, whose: np.ndarray, texts: int) -> pa.ListArray:
    """A bitmap of each text's runs as 64-bit numbers: a power of two of them, with eight bits or more a run."""
    many = np.bincount(whose, minlength=texts)
    size = 2 ** np.ceil(np.log2(np.maximum(many, 256) / 8)).astype(np.int64)
    begin = np.append(0, np.cumsum(size))
    on = np.zeros(begin[-1] * 64, np.uint8)
    on[begin[whose] * 64 + ((found >> np.uint64(20)) & (size[whose] * 64 - 1).astype(np.uint64)).astype(np.int64)] = 1
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(np.packbits(on, bitorder="little").view(np.int64)))


def apart_at_least(one: Column, two: Column) -> Column:
    """At least so many runs are in only one of two texts: in how many bits their bitmaps differ.

    The longer bitmap is folded to half its length where the other has that; for others it is 0."""

    def folded(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseOR(b))

    def differ(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)

    n, m = F.size(one), F.size(two)
    return F.when(n == m, differ(one, two)).when(n == 2 * m, differ(folded(one), two)).when(m == 2 * n, differ(one, folded(two))).otherwise(0)


def reach(least: float, other: str) -> Column:
    """Whether two nodes may be alike by what shared_at_most tells of both; the second's columns begin with `other`.

    What they share is at most what either shares with any, and a run that only one of them has, of
    weight 1 or more, takes from both likenesses."""

    def shared(both: str, own: str) -> Column:
        return F.least(both, f"{other}{both}") * (1 + least) >= least * (F.col(own) + F.col(f"{other}{own}")) - 1e-6

    def total(both: str, own: str) -> Column:
        return F.when(shared(both, own), F.col(own) + F.col(f"{other}{own}"))

    most = F.greatest(total("s", "n"), total("sw", "w"))
    return most.isNotNull() & (apart_at_least(F.col("bits"), F.col(f"{other}bits")) * (1 + least) <= (1 - least) * most + 1e-6)


def shared_at_most(nodes: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(node, n, w, s, sw, bits) of some nodes: different runs and their weight, how much of both
    other nodes of the set hold too, and a bitmap of the runs.

    A run that only one node holds is found by an aggregate over runs, which keeps its count and one
    node: no group of nodes is ever gathered.  If the nodes have a class, s and sw are what nodes of
    other classes hold too."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column("text"))
            ids = batch.column("id").to_numpy()
            for low, high in slices(at, SLICE):
                found, whose, times, _ = runs(data[at[low] : at[high]], at[low : high + 1] - at[low])
                yield pa.RecordBatch.from_arrays([pa.array(ids[low:high][whose]), pa.array(found.view(np.int64)), pa.array(weights(found, times, idf).astype(float))], names=["id", "run", "weight"])

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column("text"))
            for low, high in slices(at, SLICE):
                found, whose, _, _ = runs(data[at[low] : at[high]], at[low : high + 1] - at[low])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(low, high - low), run_bits(found, whose, high - low)], names=["id", "bits"])

    some = texts.join(nodes.select("node").distinct(), "node").select(F.xxhash64("node").alias("id"), "text")
    every = staged(some.mapInArrow(handing_back(unfold), "id long, run long, weight double"))
    if "class" in nodes.columns:
        classed = every.join(nodes.select(F.xxhash64("node").alias("id"), "class").distinct(), "id")
        own = classed.groupBy("run").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low = high").select("run")
        alone = classed.join(own, "run", "left_semi")
    else:
        alone = every.groupBy("run").agg(F.count(F.lit(1)).alias("many"), F.max("id").alias("id"), F.max("weight").alias("weight")).where("many = 1")
    alone = alone.groupBy("id").agg(F.count(F.lit(1)).alias("u"), F.sum("weight").alias("uw"))
    whole = every.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).join(alone, "id", "left")
    bound = whole.select("id", "n", "w", (F.col("n") - F.coalesce("u", F.lit(0))).alias("s"), (F.col("w") - F.coalesce("uw", F.lit(0.0))).alias("sw"))
    bound = bound.join(some.mapInArrow(handing_back(bitmaps), "id long, bits array<long>"), "id")
    return staged(nodes.select("node").distinct().withColumn("id", F.xxhash64("node")).join(bound, "id").drop("id"))


def across(rest: DataFrame, texts: DataFrame, idf: np.ndarray, least: float, block: int = 64) -> DataFrame:
    """(a, b) of nodes of one bucket and different classes, but for those that cannot be alike.

    `rest` has (band, key, node, class).  A bucket is dealt by pairs of blocks of about `block` nodes."""
    split = rest.groupBy("band", "key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("many"))
    split = split.where("low != high").select("band", "key", F.ceil(F.col("many") / block).cast("int").alias("blocks"))
    apart = staged(rest.join(split, ["band", "key"]))
    known = shared_at_most(apart.select("node", "class"), texts, idf)
    apart = staged(apart.join(known, "node").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")))
    columns = ["node", "class", *BOUNDS]
    left = apart.select("band", "key", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), *columns)
    right = apart.select("band", "key", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), *[F.col(c).alias(f"r_{c}") for c in columns])
    met = left.join(right, ["band", "key", "i", "j"]).where((F.col("class") != F.col("r_class")) & ((F.col("i") < F.col("j")) | (F.col("node") < F.col("r_node"))) & reach(least, "r_"))
    return met.select(F.least("node", "r_node").alias("a"), F.greatest("node", "r_node").alias("b")).distinct()


def joined(known: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """(node, class) after more alike pairs: the components of what `known` has and `pairs` adds.

    Pairs become edges between the components so far, each once, so that a group whose texts are
    alike in very many pairs hands on no more edges than it had components."""
    if known is None:
        return components(pairs)
    for side in ("a", "b"):
        of = known.select(F.col("node").alias(side), F.col("class").alias(f"of_{side}"))
        pairs = pairs.join(of, side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
    moved = components(pairs.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    to = moved.select(F.col("node").alias("class"), F.col("class").alias("to"))
    kept = known.join(to, "class", "left").select("node", F.coalesce("to", "class").alias("class"))
    return staged(kept.unionByName(moved))


def connected(members: DataFrame, texts: DataFrame, idf: np.ndarray, least: float, seed: int, large: int) -> DataFrame:
    """(node, class) of the nodes that are not alone: the components of all pairs that are alike in a bucket.

    One text leads a bucket in the first round; of those not in a component with a leader, sixteen
    times as many as before lead in each further round.  A leader meets every text of its bucket that is
    not in its component, but for texts that cannot be like it: what two texts share is at most what
    each shares with any text of the large buckets (more than `large` texts) still open, so a text
    with many runs of its own is out of reach, and is never compared.  Nor are two texts whose bitmaps of
    runs differ in more bits than alike texts have runs apart.  No link is lost by that.

    A bucket is done when each of its texts has led or is in the component of one that led first,
    or, where more texts are open after the first round than lead in the second, when in the end
    those that never led have been compared across components."""
    known, tested, late, led_by, bounds = None, None, None, None, None
    open_, leading, turn = members, 1, 0
    while True:
        lot = F.xxhash64("node", "band", F.lit(seed + turn))
        if leading == 1:
            leaders = open_.groupBy("band", "key").agg(F.min(F.struct(lot.alias("lot"), F.col("node")))["node"].alias("leader"))
        else:
            nth = F.row_number().over(Window.partitionBy("band", "key").orderBy(lot, "node"))
            leaders = open_.withColumn("nth", nth).where(F.col("nth") <= leading).select("band", "key", F.col("node").alias("leader"))
        leaders = staged(leaders)
        led_by = leaders if led_by is None else led_by.unionByName(leaders)
        # All texts of the buckets that have leaders, with their components and bounds.
        live = members if known is None else members.join(leaders.select("band", "key").distinct(), ["band", "key"], "left_semi")
        live = classed(live, known)
        if bounds is not None:
            live = live.join(bounds, ["band", "key", "node"], "left")
        else:
            live = live.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in BOUNDS.items()])
        live = staged(live)
        ahead = live.select("band", "key", F.col("node").alias("leader"), F.col("class").alias("l_class"), *[F.col(c).alias(f"l_{c}") for c in BOUNDS])
        ahead = leaders.join(ahead, ["band", "key", "leader"])
        unknown = F.col("n").isNull() | F.col("l_n").isNull()
        led = live.join(ahead, ["band", "key"]).where((F.col("class") != F.col("l_class")) & (unknown | reach(least, "l_")))
        pairs = led.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        pairs = staged(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        fresh = staged(verified(pairs, texts, idf, least))
        if known is None or not fresh.isEmpty():
            known = joined(known, fresh)
        # Settled are those in the component of a leader of their bucket; still open are the others.
        led_classes = classed(led_by.withColumnRenamed("leader", "node"), known).select("band", "key", "class").distinct()
        open_ = staged(classed(open_.select("band", "key", "node"), known).join(led_classes, ["band", "key", "class"], "left_anti"))
        if leading == 1:
            waiting = staged(open_.groupBy("band", "key").agg(F.count(F.lit(1)).alias("many")))
            late = waiting.where(F.col("many") > 16).select("band", "key")
            wide = members.join(waiting, ["band", "key"], "left_semi")
            big = wide.groupBy("band", "key").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") > large).select("band", "key")
            # A bound holds among the nodes of large buckets only.
            wide = wide.join(big, ["band", "key"], "left_semi")
            bounds = staged(wide.join(shared_at_most(wide, texts, idf), "node").select("band", "key", "node", *[F.col(c).cast(kind).alias(c) for c, kind in BOUNDS.items()]))
        if open_.isEmpty():
            break
        leading, turn = 16 * leading, turn + 1
    rest = members.join(late, ["band", "key"], "left_semi").join(led_by.withColumnRenamed("leader", "node"), ["band", "key", "node"], "left_anti")
    rest = staged(classed(rest, known))
    if rest.isEmpty():
        return known
    pairs = staged(across(rest, texts, idf, least).join(tested, ["a", "b"], "left_anti"))
    return joined(known, staged(verified(pairs, texts, idf, least)))


def classed(nodes: DataFrame, known: DataFrame | None) -> DataFrame:
    """With the class of each node: that of its component, or itself if it has no row there."""
    if known is None:
        return nodes.withColumn("class", F.col("node"))
    return nodes.join(known, "node", "left").withColumn("class", F.coalesce("class", "node"))


def row_keys(id_col: str, text_col: str) -> list:
    """Two hashes that name a row of documents by its id and text."""
    return [F.xxhash64(id_col, text_col).alias("_k1"), F.hash(text_col, id_col).alias("_k2")]


def classes(
    docs: DataFrame,
    least: float = 0.8,
    bands: int = 14,
    rows: int = 4,
    cells: int = 1 << 18,
    seed: int = 29,
    large: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, node, class_node, class_id, class_docs, _k1, _k2): every document's class, named by
    its least doc_id, and how many documents the class has.  node names the text's words; without
    any it is null, and the class is the document itself.  _k1 and _k2 are the row's keys."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row_keys(id_col, text_col))
    idf = idf_of(*document_counts(given, cells))
    signatures = staged(signed(given, idf, bands, rows, seed))
    wordy = signatures.where("node IS NOT NULL")
    # One row per different text; first() may take any, as equal words draw the same.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_k1", "_k2"))
    nodes = staged(wordy.groupBy("node").agg(first.alias("row"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys")))
    buckets = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    members = staged(buckets.join(shared, ["band", "key"]).select("band", "key", "node"))
    named = nodes.select("node", "row.doc_id", "row._k1", "row._k2", "n")
    # A text of each node that shares a bucket; a row that is there twice gives it once.
    asked = members.select("node").distinct().join(named, "node").select("node", "_k1", "_k2")
    texts = staged(given.select("text", "_k1", "_k2").join(asked, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]).select("node", "text"))
    parts = connected(members, texts, idf, least, seed, large)
    of_node = named.join(parts, "node", "left").withColumn("class_node", F.coalesce("class", "node"))
    per_class = of_node.groupBy("class_node").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_docs"))
    per_node = of_node.select("node", "class_node").join(per_class, "class_node")
    columns = ["doc_id", "node", "class_node", "class_id", "class_docs", "_k1", "_k2"]
    with_words = wordy.select("doc_id", "node", "_k1", "_k2").join(per_node, "node").select(*columns)
    without = signatures.where("node IS NULL").select(
        "doc_id", "node", F.col("node").alias("class_node"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_docs"), "_k1", "_k2"
    )
    return with_words.unionByName(without)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with one left of each class: that of the least doc_id.  Documents without
    words all stay."""
    found = staged(classes(docs, id_col=id_col, text_col=text_col, **how))
    stays = found.where("node IS NOT NULL").groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_k1", "_k2")).alias("row")).select("row._k1", "row._k2")
    empty = found.where("node IS NULL").select("_k1", "_k2").distinct()
    keyed = docs.select("*", *row_keys(id_col, text_col))
    one = keyed.join(stays, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    without = ~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return one.select(*docs.columns).unionByName(keyed.where(without).join(empty, ["_k1", "_k2"], "left_semi").select(*docs.columns))
