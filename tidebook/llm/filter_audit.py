"""What each filter of a chain takes, in every order of the chain, from sorted posting lists.

A posting row holds, for one part and one range of ids, the sorted ids of the documents that fail
each filter and of those that are labelled good or toxic.  Ids are places in the range, so that
documents that share an id stay apart.  For every set of filters the lists are united by
galloping: the shorter list looks up its ids in the longer one by binary search.  What a filter
removes after a set of others is its list less that union; redundant, lost and kept documents are
sizes of such lists.  Sizes add up over ranges, so ranges are worked through on their own and only
80 sums of each part (five filters, sixteen sets of others before each) meet.

On Spark: texts become narrow rows (id, part, failures, hash) in one scan; the least id of equal
texts comes from an aggregate and goes back by a join, as labels do, both salted, so that a text,
id or null that very many rows share is spread; only salts that rows of a key have get a copy of
what goes back, so copies are never more than documents; both are merge joins, as a salted copy is
many times what its file's size tells the optimizer, and the driver builds what is broadcast; ranges are cut from an exchange by range of ids,
at most `range_docs` rows each, whatever the ids are.

Defined results: a null text is empty; a null source is the part of the empty string; a null
doc_id is behind no other document, so that it never repeats one, and has no label; rows of one
doc_id and text do not repeat each other, as neither id is smaller; a document with several label
rows is good or toxic if one of them says so; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.llm.common import WORD, staged

FILTERS = "ABCDE"
#: A document that repeats an earlier one fails this filter, which looks at the whole table.
REPEATS = "E"


def failures(text: Column) -> dict[str, Column]:
    """Whether a text fails each of the filters that look at it alone."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def _bits(bits: Sequence[Column]) -> Column:
    """An int with bit i set where bits[i] is true."""
    total = F.lit(0)
    for i, bit in enumerate(bits):
        total = total + F.when(bit, F.lit(1 << i)).otherwise(F.lit(0))
    return total


def judged(docs: DataFrame, labels: DataFrame, salts: int = 16) -> DataFrame:
    """doc_id, part, fails (a bit for each filter), good and toxic of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = failures(text)
    flags = [own.get(f, F.lit(False)) for f in FILTERS]
    narrow = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), _bits(flags).alias("fails"),
            F.unhex(F.sha2(text, 256)).alias("digest"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("salt"),
        )
    )
    seen = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt"))).alias("seen")
    salt = F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda x: F.getbit("seen", x) == 1)).alias("salt")
    least = narrow.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), seen)
    least = least.where("least < last").select("digest", "least", salt)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    marks = marks.where("good OR toxic").hint("merge").join(narrow.groupBy("doc_id").agg(seen), "doc_id").select("doc_id", "good", "toxic", salt)
    rows = narrow.join(least.hint("merge"), ["digest", "salt"], "left").join(marks.hint("merge"), ["doc_id", "salt"], "left")
    repeats = F.when(F.col("doc_id") > F.col("least"), F.lit(1 << FILTERS.index(REPEATS))).otherwise(F.lit(0))
    false = F.lit(False)
    return rows.select(
        "doc_id", "part", (F.col("fails") + repeats).alias("fails"), F.coalesce("good", false).alias("good"), F.coalesce("toxic", false).alias("toxic"), "salt"
    )


LISTS = [*FILTERS, "good", "toxic"]


def postings(rows: DataFrame, range_docs: int = 1 << 16) -> DataFrame:
    """One row per part and range of ids: its first and last id, its documents and, for each filter
    and label, the sorted places in the range of the documents that have it."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, range_docs):
                cut = batch.slice(low, range_docs)
                if n + cut.num_rows > range_docs:
                    yield posted(pa.Table.from_batches(held))
                    held, n = [], 0
                held.append(cut)
                n += cut.num_rows
        if n:
            yield posted(pa.Table.from_batches(held))

    def posted(found: pa.Table) -> pa.RecordBatch:
        parts = found["part"].combine_chunks().dictionary_encode()
        codes = parts.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")  # ids stay in order within a part
        begin = np.searchsorted(codes[order], np.arange(len(parts.dictionary) + 1))
        fails = found["fails"].to_numpy()
        sets = [(fails >> i) & 1 == 1 for i in range(len(FILTERS))] + [found[x].to_numpy(zero_copy_only=False).astype(bool) for x in ("good", "toxic")]
        ids = found["doc_id"]
        columns = [[] for _ in LISTS]
        for k in range(len(begin) - 1):
            places = order[begin[k] : begin[k + 1]]
            for x, has in zip(columns, sets, strict=True):
                x.append(places[has[places]].astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [
                parts.dictionary, pa.array([ids[int(order[a])].as_py() for a in begin[:-1]], pa.int64()),
                pa.array([ids[int(order[b - 1])].as_py() for b in begin[1:]], pa.int64()), pa.array(np.diff(begin), pa.int64()),
                *(pa.array(x, pa.list_(pa.int32())) for x in columns),
            ],
            names=["part", "first_id", "last_id", "docs", *LISTS],
        )

    schema = "part string, first_id long, last_id long, docs long, " + ", ".join(f"{x} array<int>" for x in LISTS)
    ranged = rows.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id")
    return ranged.select("doc_id", "part", "fails", "good", "toxic").mapInArrow(lists, schema)


def member(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which ids of the sorted x are in the sorted y; the shorter gallops through the longer."""
    has = np.zeros(len(x), bool)
    if not len(x) or not len(y):
        return has
    if len(x) <= len(y):
        at = np.searchsorted(y, x)
        inside = at < len(y)
        has[inside] = y[at[inside]] == x[inside]
        return has
    at = np.searchsorted(x, y)
    inside = at < len(x)
    at, y = at[inside], y[inside]
    has[at[x[at] == y]] = True
    return has


def union(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sorted ids of both sorted lists: those of the shorter that are new go to their places."""
    if len(x) < len(y):
        x, y = y, x
    new = y[~member(y, x)]
    return np.insert(x, np.searchsorted(x, new), new)


def sums(lists: DataFrame) -> DataFrame:
    """For each part, filter and set of others before it (bits): documents, those that the others
    take (united), that fail the filter, and that it removes after them, good and toxic ones too."""
    n = len(FILTERS)
    names = ["part", "filter", "before", "docs", "united", "failing", "removed", "good_lost", "toxic_lost"]

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in names]
            for r in range(batch.num_rows):
                one = {x: batch.column(x)[r].values.to_numpy() for x in LISTS}
                rows = list(sizes([one[f] for f in FILTERS], one["good"], one["toxic"]))
                part, docs = batch.column("part")[r].as_py(), batch.column("docs")[r].as_py()
                for row in rows:
                    for x, value in zip(out, (part, row[0], row[1], docs, *row[2:]), strict=True):
                        x.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 0 else pa.int64()) for i, x in enumerate(out)], names=names)

    def sizes(fails: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple[int, ...]]:
        united = [np.zeros(0, np.int32)]
        for taken in range(1, 1 << n):
            low = taken & -taken
            united.append(union(united[taken ^ low], fails[low.bit_length() - 1]))
        for f in range(n):
            for before in range(1 << n):
                if not before >> f & 1:
                    gone = fails[f][~member(fails[f], united[before])]
                    yield f, before, len(united[before]), len(fails[f]), len(gone), int(member(gone, good).sum()), int(member(gone, toxic).sum())

    schema = "part string, " + ", ".join(f"{x} long" for x in names[1:])
    found = lists.mapInArrow(audit, schema)
    return found.groupBy("part", "filter", "before").agg(*(F.sum(x).alias(x) for x in names[3:]))


def orders(spark: SparkSession) -> DataFrame:
    """Every step of every order: filter_order, step, filter, before (bits); 600 rows."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        for step, f in enumerate(order, 1):
            rows.append(("".join(FILTERS[i] for i in order), step, f, sum(1 << i for i in order[: step - 1])))
    return spark.createDataFrame(rows, "filter_order string, step int, filter long, before long")


def audit(docs: DataFrame, labels: DataFrame, range_docs: int = 1 << 16) -> DataFrame:
    """One row per part, order of the filters and step in it, with the documents' counts."""
    found = sums(postings(staged(judged(docs, labels)), range_docs))
    n = len(FILTERS)
    others = F.lit((1 << n) - 1) - F.call_function("shiftleft", F.lit(1).cast("long"), F.col("filter").cast("int"))
    # So many of the orders put just these filters before it.
    ways = F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)).cast("long") for k in range(n)))
    each = Window.partitionBy("part", "filter")
    found = found.withColumns(
        {
            "unique_fails": F.max(F.when(F.col("before") == others, F.col("removed"))).over(each),
            "shapley": F.sum(F.col("removed") * ways[F.bit_count("before")]).over(each),
        }
    )
    every = F.broadcast(orders(docs.sparkSession))
    return found.join(every, ["filter", "before"]).select(
        "part", "filter_order", "step", (F.col("docs") - F.col("united") - F.col("removed")).alias("kept"), "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley",
    )
