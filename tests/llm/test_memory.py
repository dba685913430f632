"""What stages of the pipeline hold in executors: batches of bounded bytes, memory handed back."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tidebook.llm.common import handing_back


def test_stages_make_small_batches(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat(concat('word ', id, ' '), 400) AS text", "'a' AS source", "'en' AS lang")
    docs = docs.coalesce(1)
    corpus_pipeline.quality_stage(spark, docs, "")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([b.nbytes])], names=["n", "bytes"])

    rows = docs.select("text").mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in rows) == 4000
    assert max(r["bytes"] for r in rows) < 5_000_000


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_freed_memory_is_handed_back():
    held = []

    def work(batches):
        for batch in batches:
            parts = [np.ones(100_000, np.uint8) for _ in range(2000)]
            held.append(parts[-1])  # what lies above the freed parts
            yield batch

    before = resident()
    given = [pa.RecordBatch.from_arrays([pa.array([k])], names=["k"]) for k in range(2)]
    assert list(handing_back(work)(iter(given))) == given
    assert resident() - before < 60_000_000
