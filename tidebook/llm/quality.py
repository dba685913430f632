"""Quality classifier from weak labels.

Overlapping heuristic labellers look at every whole text and vote good, bad or not at all.
Expectation-maximisation over the counts of all documents' vote patterns (3**8 at most, whatever
the corpus) estimates how accurate each labeller is and how common good documents are, without a
single true label; its posterior per pattern is the weak label.  Posterior labels of a bounded
sample (`train_docs`, those first by a hash of their id) train a linear scorer over hashed
features: the words, their shapes and repeats.  The scorer rates every document.

Defined results: a null or empty text, or one of white space, gets score 0 and is not kept; a
text of a few words on which every labeller abstains is rated by its words alone; with an empty
table nothing is learned and no row returned; repeated rows are rated alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import handing_back, sampled
from tidebook.llm.textbytes import LOWER, SLICE, distinct, flat, mixed, powers, slices, word_hashes, words

LABELLERS = ("capitals", "marks", "lone_marks", "ending_marks", "repeats", "variety", "word_length", "sentences")
BUCKETS = 1 << 15
#: Kinds of bytes for shapes and counts: space, lower case, capital, digit, sentence mark, other mark, further UTF-8 byte.
KIND = np.full(256, 5, np.uint8)
KIND[[32, *range(9, 14)]] = 0
KIND[97:123] = 1
KIND[65:91] = 2
KIND[48:58] = 3
KIND[[ord(x) for x in ".,;:'\"()-?!"]] = 4
KIND[128:] = 6


def _kinds(data: np.ndarray) -> np.ndarray:
    kind = KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    second = data[lead + 1]
    kind[lead] = kind[lead + 1] = 1
    kind[lead[(second >= 0x80) & (second <= 0x9E)]] = 2
    return kind


def look(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes (texts, labellers; 1 good, -1 bad, 0 none), and every token's two buckets beside the
    text it is of: (3, tokens) of text, word bucket, shape bucket."""
    low = LOWER[data]
    kind = _kinds(data)
    start, end, first = words(data, at)
    n_docs, n = len(at) - 1, np.diff(first)
    doc = np.repeat(np.arange(n_docs), n)
    hashes = word_hashes(low, start, end)

    def per(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags))
        return sums[at[1:]] - sums[at[:-1]]

    def of_words(flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc, flags, n_docs) / np.maximum(n, 1)

    letters, capitals = per((kind == 1) | (kind == 2) | (kind == 6)), per(kind == 2)
    solid, odd = per(kind != 0), per(kind == 5)
    sums = np.append(0, np.cumsum((kind == 4) | (kind == 5)))
    lone = sums[end] - sums[start] == end - start
    two = (end - start > 2) & (kind[end - 1] >= 4) & (kind[end - 1] <= 5) & (data[end - 1] == data[np.maximum(end - 2, 0)]) if len(end) else np.zeros(0, bool)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    found, whose, _ = distinct(hashes, doc)
    variety = np.bincount(whose, minlength=n_docs) / np.maximum(n, 1)
    length = letters / np.maximum(n, 1)
    stops = of_words(np.isin(data[end - 1], [ord(x) for x in ".,;:?!"]) if len(end) else np.zeros(0))

    def vote(bad: np.ndarray, good: np.ndarray, enough: np.ndarray) -> np.ndarray:
        return np.where(~enough, 0, np.where(bad, -1, np.where(good, 1, 0)))

    some, many = n >= 4, n >= 40
    upper, marks = capitals / np.maximum(letters, 1), odd / np.maximum(solid, 1)
    votes = np.stack(
        [
            vote(upper > 0.5, upper < 0.25, some),
            vote(marks > 0.05, marks < 0.03, some),
            vote(of_words(lone) > 0.2, of_words(lone) < 0.06, some),
            vote(of_words(two) > 0.3, of_words(two) < 0.1, some),
            vote(of_words(again) > 0.3, of_words(again) < 0.1, some),
            vote(variety < 0.15, variety > 0.4, many),
            vote((length < 1.5) | (length > 20), (length > 2.5) & (length < 14), some),
            vote(stops > 0.8, (stops > 0.02) & (stops < 0.5), many),
        ],
        axis=1,
    )
    # A word's shape: the kinds of its bytes, runs as one.
    change = np.zeros(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[start] = True
    with np.errstate(over="ignore"):
        step = np.cumsum(change)
        mark = np.where(kind == 5, data, kind).astype(np.uint64) + np.uint64(1)
        shape = np.append(np.uint64(0), np.cumsum(np.where(change, mark * powers(0x9E3779B97F4A7C15, len(data) + 1)[step % (len(data) + 1)], np.uint64(0)))) if len(data) else np.zeros(1, np.uint64)
        inverse = powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), len(data) + 1)
        shapes = mixed((shape[end] - shape[start]) * inverse[step[start]]) if len(start) else np.zeros(0, np.uint64)
        shapes = mixed(shapes * np.uint64(2) + again.astype(np.uint64) + np.uint64(77))
    half = np.uint64(BUCKETS // 2)
    return votes, n, np.stack([doc, (hashes % half).astype(np.int64), (half + shapes % half).astype(np.int64)])


def pattern_of(votes: np.ndarray) -> np.ndarray:
    return ((votes + 1) * 3 ** np.arange(votes.shape[1])).sum(1)


def accuracies(counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns: the posterior of good per pattern, each
    labeller's chance of (bad, none, good) votes for bad and good documents, the share of good."""
    patterns = np.flatnonzero(counts)
    n = counts[patterns].astype(float)
    votes = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    # To begin with, labellers are trusted: a bad vote speaks for bad.
    good = np.clip(0.9 - 0.8 * (votes == 0).any(1), 0.1, 0.9)
    chance, share = np.full((2, len(LABELLERS), 3), 1 / 3), 0.5
    for _ in range(rounds):
        share = (n * good).sum() / n.sum()
        for side, weight in ((0, n * (1 - good)), (1, n * good)):
            for vote in range(3):
                chance[side, :, vote] = (weight[:, None] * (votes == vote)).sum(0) + 0.5
        chance /= chance.sum(2, keepdims=True)
        # An abstention says nothing.
        speak = votes != 1
        logs = [(np.log(chance[s, np.arange(len(LABELLERS)), votes] / (1 - chance[s, np.arange(len(LABELLERS)), 1])) * speak).sum(1) for s in (0, 1)]
        gap = np.clip(logs[0] - logs[1] + np.log((1 - share + 1e-9) / (share + 1e-9)), -50, 50)
        good = 1 / (1 + np.exp(gap))
    out = np.full(len(counts), share)
    out[patterns] = good
    return out, chance, share


def train(found: np.ndarray, whose: np.ndarray, value: np.ndarray, label: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Weights per bucket and, last, the intercept: logistic regression on the share `value` of
    text `whose` in bucket `found`, by Adam over all of the sample; both classes weigh alike."""
    weight = np.where(label > 0.5, 0.5 / max(label.sum(), 1e-9), 0.5 / max((1 - label).sum(), 1e-9))
    w, m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(whose, value * w[found], len(label)) + w[-1])))
        d = weight * (p - label)
        g = np.append(np.bincount(found, value * d[whose], BUCKETS), d.sum()) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    return w


@dataclass
class Fitted:
    """What is learned from documents: the posterior of good per vote pattern, the scorer's weights."""

    posterior: np.ndarray
    weights: np.ndarray

    def judge(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Weak label's posterior and score of every text."""
        data, at = flat(text)
        weak, scores = [np.zeros(0)], [np.zeros(0)]
        for low, high in slices(at, SLICE):
            votes, n, (doc, word, shape) = look(data[at[low] : at[high]], at[low : high + 1] - at[low])
            total = np.bincount(doc, self.weights[word] + self.weights[shape], high - low) / np.maximum(n, 1) + self.weights[-1]
            weak.append(self.posterior[pattern_of(votes)])
            scores.append(np.where(n > 0, 1 / (1 + np.exp(-np.clip(total, -50, 50))), 0.0))
        return np.concatenate(weak), np.concatenate(scores)


def fit(docs: DataFrame, train_docs: int, id_col: str, text_col: str) -> Fitted | None:
    """Votes of all documents, and the scorer from a sample of theirs; None without documents."""

    def ballot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            data, at = flat(batch.column("text"))
            for low, high in slices(at, SLICE):
                counts.update(pattern_of(look(data[at[low] : at[high]], at[low : high + 1] - at[low])[0]).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = np.zeros(3 ** len(LABELLERS), np.int64)
    for r in texts.select("text").mapInArrow(handing_back(ballot), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect():
        counts[r["pattern"]] = r["n"]
    if not counts.sum():
        return None
    posterior = accuracies(counts)[0]
    sample = sampled(texts.where("text IS NOT NULL"), F.xxhash64("doc_id", "text"), train_docs, int(counts.sum())).select("text").toArrow()
    weights = np.zeros(BUCKETS + 1)
    if len(sample):
        # Features of a slice at a time, so that the driver holds no more than their counts.
        data, at = flat(sample["text"])
        parts = []
        for low, high in slices(at, SLICE):
            votes, n, (doc, word, shape) = look(data[at[low] : at[high]], at[low : high + 1] - at[low])
            found, whose, times = distinct(np.append(word, shape).astype(np.uint64), np.append(doc, doc))
            value = (times / np.maximum(n[whose], 1)).astype(np.float32)
            parts.append((found.astype(np.int32), (low + whose).astype(np.int32), value, posterior[pattern_of(votes)]))
        weights = train(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    return Fitted(posterior, weights)


def rate(
    docs: DataFrame, train_docs: int = 4000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, weak, score, keep): the weak label's posterior, the scorer's, the decision."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fitted = fit(docs, train_docs, id_col, text_col)
    if fitted is None:
        return rows.where("false").select("doc_id", F.lit(0.0).alias("weak"), F.lit(0.0).alias("score"), F.lit(False).alias("keep"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weak, score = fitted.judge(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weak), pa.array(score), pa.array(score >= threshold)], names=["doc_id", "weak", "score", "keep"])

    return rows.mapInArrow(handing_back(judge), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, weak double, score double, keep boolean")


def kept_documents(
    docs: DataFrame, train_docs: int = 4000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents that the classifier keeps, with all their columns, in one pass."""
    fitted = fit(docs, train_docs, id_col, text_col)
    if fitted is None:
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(fitted.judge(batch.column(text_col))[1] >= threshold))

    return docs.mapInArrow(handing_back(keep), docs.schema)
