"""Mixing sources to target weights, in blocks of a fixed number of words.

The words of a source, document after document, are one stream, cut into blocks.  Every output
shard draws its multinomial number of blocks per source from what the sources still lack, so
that shards differ but the whole comes near the targets.  A source's slots are numbered through
all shards; slot j is block perm(j mod n) of its n blocks, where perm is a keyed permutation of
the block numbers that changes with each pass.  Slots and documents meet in one join by block.

Two passes at most are drawn of a source, so no document gives more than twice its words.

Only one row per source (its total) reaches the driver; `most_sources` bounds that and is
checked.  Positions in a source's stream come from sums over cells of documents, dealt by hash,
so that a source of any size is never ordered in one task.

Defined results: null texts have size 0 and give nothing; null sources are one source, the last;
null or repeated doc_ids are separate rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import SPACE, WORD, staged, words_of

WEIGHTS = (3, 1, 2)


def targets(sizes: list[int], share: float, times: float, weights: tuple[int, ...] = WEIGHTS) -> list[float]:
    """What each source gives: `share` of all sizes by weight, none above `times` its own size;
    what is above goes to the others by weight, until none is."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    rest, open_ = share * sum(sizes), set(range(len(sizes)))
    got = [0.0] * len(sizes)
    while open_:
        all_weight = sum(weight[i] for i in open_)
        for i in open_:
            got[i] = rest * weight[i] / all_weight
        above = [i for i in sorted(open_) if got[i] > times * sizes[i]]
        if not above:
            break
        for i in above:
            got[i] = float(times * sizes[i])
            rest -= got[i]
        open_.difference_update(above)
    return got


def draw(blocks: list[int], wanted: list[float], block: int, shards: int, passes: int, seed: int) -> np.ndarray:
    """Blocks that each shard takes of each source: multinomial, in proportion to what a source
    still lacks, at most `passes` times its blocks."""
    limit = passes * np.array(blocks, np.int64)
    lack = np.minimum(np.rint(np.array(wanted) / block).astype(np.int64), limit)
    chosen, rng = np.zeros((shards, len(blocks)), np.int64), np.random.default_rng(seed)
    for shard in range(shards):
        left = int(lack.sum())
        if not left:
            break
        n = -(-left // (shards - shard))
        chosen[shard] = np.minimum(rng.multinomial(n, lack / left), limit)
        limit -= chosen[shard]
        lack = np.maximum(lack - chosen[shard], 0)
    return chosen


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of range(n), at `index`: a four-round Feistel network over the next
    even number of bits, walked until the result is below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x, h, m = out[todo], half[todo], mask[todo]
        left, right = x >> h, x & m
        for turn in range(4):
            with np.errstate(over="ignore"):
                f = (right + key[todo] + np.uint64(turn + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _placed(docs: DataFrame, block: int, cell_words: int, most_sources: int, share: float, times: float, id_col: str, text_col: str, source_col: str):
    """Every document's place in its source's stream, and the sources' totals and targets."""
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        words_of(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("digest"),
    )
    sized = staged(sized)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).limit(most_sources + 1).collect()
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    totals = sorted(totals, key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [r.source_size for r in totals]
    wanted = targets(sizes, share, times)
    spark = docs.sparkSession
    kind = sized.schema["source"].dataType.simpleString()
    plan = spark.createDataFrame(
        [(r.source, i, r.source_size, t) for i, (r, t) in enumerate(zip(totals, wanted, strict=True))],
        f"source {kind}, number int, source_size long, target double",
    )
    cells = max(1, sum(sizes) // cell_words)
    placed = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(cells)))
    per_cell = placed.groupBy("number", "cell").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("number").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = per_cell.select("number", "cell", F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("cell_first"))
    inside = Window.partitionBy("number", "cell").orderBy("doc_id", "digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(per_cell, ["number", "cell"])
        .withColumn("first", F.col("cell_first") + F.col("within"))
        .drop("cell", "cell_first", "within")
    )
    return placed, sizes, wanted


def _times(spark, sizes: list[int], wanted: list[float], block: int, shards: int, passes: int, seed: int) -> DataFrame:
    """How often each block is taken: the slots of all shards, mapped to blocks and counted."""
    blocks = [-(-n // block) for n in sizes]
    chosen = draw(blocks, wanted, block, shards, passes, seed)
    begins = np.cumsum(chosen, axis=0) - chosen
    rows = [
        (s, blocks[s], shard, int(begins[shard, s]), int(chosen[shard, s]))
        for shard in range(shards)
        for s in range(len(sizes))
        if chosen[shard, s]
    ]
    runs = spark.createDataFrame(rows, "number int, n long, shard int, first_slot long, count long")
    # A run is cut again, so that no row stands for more than 65,536 slots.
    parts = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(65536).cast("long"))).alias("skip"))
    parts = parts.repartition(F.col("number"), F.col("shard"), F.col("skip"))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                slot = r.first_slot + np.arange(r.skip, min(r.count, r.skip + 65536))
                n = np.full(len(slot), r.n)
                key = ((slot // r.n) * 1_000_003 + r.number * 8191 + seed).astype(np.uint64)
                found = permuted(slot % r.n, n, key)
                yield pd.DataFrame({"number": np.int32(r.number), "shard": np.int32(r.shard), "slot": slot, "block": found})

    parts = parts.withColumnRenamed("count", "count_").select("number", "n", "shard", "first_slot", F.col("count_").alias("count"), "skip")
    drawn = parts.mapInPandas(slots, "number int, shard int, slot long, block long")
    return drawn.groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"))


def mix(
    docs: DataFrame,
    block: int = 64,
    share: float = 1.5,
    times: float = 2.0,
    shards: int = 256,
    seed: int = 11,
    cell_words: int = 1 << 18,
    most_sources: int = 10_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep_parts: bool = False,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken.

    With `keep_parts` also digest (of the text) and parts: the runs of words taken, as structs
    (from, to, times) over word numbers of the document."""
    placed, sizes, wanted = _placed(docs, block, cell_words, most_sources, share, times, id_col, text_col, source_col)
    taken = _times(docs.sparkSession, sizes, wanted, block, shards, int(times), seed)
    last = F.col("first") + F.col("size")
    pieces = placed.select(
        "*",
        F.explode_outer(
            F.when(F.col("size") > 0, F.sequence(F.floor(F.col("first") / block), F.floor((last - 1) / block)))
        ).alias("block"),
    )
    low, high = F.greatest(F.col("block") * block, F.col("first")), F.least((F.col("block") + 1) * block, last)
    # Both sides grow with the corpus, so neither may be sent to every task.
    joined = pieces.join(taken.hint("merge"), ["number", "block"], "left").select(
        "doc_id", "source", "size", "digest", "source_size", "target", "number", "first",
        (low - F.col("first")).alias("from"), (high - F.col("first")).alias("to"), F.coalesce("times", F.lit(0)).alias("times"),
    )
    # A document with words is alone at its place of the stream; those without words have none.
    keys = ["doc_id", "source", "size", "digest", "source_size", "target", "number", "first"]
    with_words = joined.where("size > 0").groupBy(*keys).agg(
        F.sum((F.col("to") - F.col("from")) * F.col("times")).cast("long").alias("taken"),
        *([F.sort_array(F.collect_list(F.when(F.col("times") > 0, F.struct("from", "to", "times")))).alias("parts")] if keep_parts else []),
    )
    without = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    if keep_parts:
        without = without.withColumn("parts", F.array().cast(with_words.schema["parts"].dataType))
    out = ["doc_id", "source", "size", "source_size", "target", "taken", *(["digest", "parts"] if keep_parts else [])]
    return with_words.select(*out).unionByName(without.select(*out))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as documents: per document and pass one row with the words that the pass takes,
    in their order and with the white space before them.  All columns of `docs` are kept; n_chars,
    where there is one, follows the text.  Rows that are the same in id, source and text count as
    one here."""
    once = docs.withColumn("_digest", F.xxhash64(text_col)).dropDuplicates([id_col, source_col, "_digest"])
    plan = mix(once, id_col=id_col, text_col=text_col, source_col=source_col, keep_parts=True, **how)
    plan = plan.where("taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("digest").alias("_hash"), F.col("size").alias("_size"),
        F.col("taken").alias("_taken"), F.col("parts").alias("_parts"),
    )
    same = once[id_col].eqNullSafe(plan["_id"]) & once[source_col].eqNullSafe(plan["_source"]) & (once["_digest"] == plan["_hash"])
    joined = once.join(plan, same)
    passes = F.sequence(F.lit(1), F.array_max(F.transform("_parts", lambda p: p["times"].cast("int"))))
    joined = joined.withColumn("_pass", F.explode(passes))
    words = F.regexp_extract_all(F.col(text_col), F.lit(rf"[{SPACE}]*{WORD}"), F.lit(0))
    runs = F.filter("_parts", lambda p: p["times"] >= F.col("_pass"))
    whole = F.aggregate(runs, F.lit(0).cast("long"), lambda n, p: n + p["to"] - p["from"]) == F.col("_size")
    cut = F.array_join(F.flatten(F.transform(runs, lambda p: F.slice(words, (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")))), "")
    text = F.when(whole, F.col(text_col)).otherwise(F.regexp_replace(cut, rf"^[{SPACE}]+", ""))
    columns = {c: F.col(c) for c in docs.columns}
    columns[text_col] = text
    out = joined.select(*[columns[c].alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out
