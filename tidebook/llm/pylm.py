"""Hierarchical Pitman-Yor language model over words, spelt by a hierarchical one over letters.

Restaurants, from the most special to the most general: the class of a word's document and the
word before it, whichever that is; for all but the 31 most frequent words before it, what they
share in the class; the document's class alone; all words; and the spelling.  A restaurant draws
new tables from its parent: those of all less frequent words before from the one they share, 32
of each class from the class, all classes from the one of all words, whose new tables spell their
word, letter after letter, in restaurants of three, two, one and no letters before it.

Seats are sampled by Gibbs: given the parents' predictive probabilities and the restaurants'
totals, the tables of each (context, word) are drawn by the Chinese restaurant process; sweeps
alternate with the exchange of totals.  Scores are the mean of the predictive probabilities over
several samples of all seats.

On Spark: every batch of texts counts its different (word, context) pairs; counts meet by ranges
of the words' hashes, so that a range's words sit in one row of flat arrays of bounded size.  What
follows each less frequent word meets by ranges of that word's hash, so that such a restaurant is
whole in one row; restaurants of the 31 most frequent, which most words follow, are spread over the
words' ranges.  Ranges by the word before tell the words' ranges how many tables they open of each
word, and hear its probability from them.  Only totals of the restaurants of classes and frequent
words (a fixed number) and counts of letter groups (48 letters, so 48**4 at most) reach the driver.
For scoring, documents are dealt into chunks; a chunk asks the ranges for its different pairs and
gets their probabilities back in the same order.  Classes, frequent words and all counts come from
all training documents, whole; a null text counts as an empty one there too.

Defined results: a null or empty text is its end token alone; a null doc_id counts as remainder
0, held out; with nothing to learn from the base score is that of its formula (N = V = 0);
repeated rows get the same scores each; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import freed, handing_back, of_one, of_two, released, small_batches, staged
from tidebook.llm.textbytes import LOWER, flat, mixed, slices, word_hashes, words

CLASSES, FREQUENT, FEATURES = 8, 32, 4096
CONTEXTS = CLASSES * FREQUENT
#: Where the hash of a word before holds its document's class.
CLASS_BITS = np.uint64(CLASSES - 1)
#: The end token's hash.
END = np.uint64(0x5EED0FE9D0000001)
#: Letters: a-z, one for the UTF-8 lead byte 0xC3, 16 for continuation bytes, digits, other ASCII,
#: other lead bytes, the end of a word and what stands before its first letter.
LETTERS, WORD_END, BEFORE = 48, 46, 47
LETTER = np.full(256, 44, np.uint8)
LETTER[97:123] = np.arange(26)
LETTER[0xC3] = 26
LETTER[0x80:0xC0] = 27 + (np.arange(0x80, 0xC0) & 15)
LETTER[48:58] = 43
LETTER[0xC0:0xC3] = LETTER[0xC4:] = 45


@dataclass
class Contexts:
    """Word probabilities of document classes over hashed words, and the frequent words."""

    class_words: np.ndarray  # (FEATURES, CLASSES) log probabilities
    class_share: np.ndarray
    frequent: np.ndarray  # sorted hashes


@dataclass
class Tokens:
    hashes: np.ndarray
    context: np.ndarray
    doc: np.ndarray  # which text
    start: np.ndarray  # bytes of the word; -1 for the end token
    length: np.ndarray
    lower: np.ndarray
    before: np.ndarray  # class and hash of the word before, if that is none of the frequent; else 0


def tokens_of(data: np.ndarray, at: np.ndarray, known: Contexts | None) -> Tokens:
    """Tokens of texts in order, each text followed by its end token, with their contexts."""
    low = LOWER[data]
    start, end, first = words(low, at)
    hashes = word_hashes(low, start, end)
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    context = np.zeros(len(hashes), np.int64)
    kind = np.zeros(n, np.int64)
    before, before_end = np.zeros(len(hashes), np.uint64), np.zeros(n, np.uint64)
    if known is not None:
        if len(hashes):
            score = np.zeros((n, CLASSES))
            has = np.flatnonzero(np.diff(first))
            score[has] = np.add.reduceat(known.class_words[(hashes & np.uint64(FEATURES - 1)).astype(np.int64)], first[:-1][has], axis=0)
            kind = (score + known.class_share).argmax(1)
        place = np.minimum(np.searchsorted(known.frequent, hashes), max(0, len(known.frequent) - 1))
        number = np.where(known.frequent[place] == hashes, place + 1, 0) if len(known.frequent) else np.zeros(len(hashes), np.int64)
        context[1:] = number[:-1]
        context[first[:-1][np.diff(first) > 0]] = 0
        last = np.where(np.diff(first) > 0, number[np.maximum(first[1:] - 1, 0)] if len(number) else 0, 0)
        rare = np.where(number == 0, (hashes & ~CLASS_BITS) | kind[doc].astype(np.uint64), np.uint64(0))
        before[1:] = rare[:-1]
        before[first[:-1][np.diff(first) > 0]] = 0
        if len(rare):
            before_end = np.where(np.diff(first) > 0, rare[np.maximum(first[1:] - 1, 0)], np.uint64(0))
        context += FREQUENT * kind[doc]
        ending = FREQUENT * kind + last
    else:
        ending = np.zeros(n, np.int64)
    at_end = first[1:]
    return Tokens(
        np.insert(hashes, at_end, END), np.insert(context, at_end, ending), np.insert(doc, at_end, np.arange(n)),
        np.insert(start, at_end, -1), np.insert(end - start, at_end, 0), low, np.insert(before, at_end, before_end),
    )


def collected(df: DataFrame, size: int) -> np.ndarray:
    """Sum of vectors of a fixed length, from rows (key, value)."""
    out = np.zeros(size)
    sums = df.groupBy("key").agg(F.sum("value").alias("value")).toArrow()
    out[sums["key"].to_numpy()] = sums["value"].to_numpy()
    return out


def spread(docs: DataFrame) -> DataFrame:
    """Word features of texts as flat arrays, a row for each slice of texts: where a text begins, its
    different features and how often it has them; and beside them, now and then, different words and
    their counts since the last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def folded() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            own, at = np.unique(h, return_inverse=True)
            held[:] = [(own, np.bincount(at, n, len(own)).astype(np.int64))]
            return held[0]

        def row(first=(), feature=(), times=(), h=(), n=()) -> pa.RecordBatch:
            kinds = (np.int64, np.uint16, np.uint32, np.uint64, np.int64)
            return pa.RecordBatch.from_arrays([binary([np.asarray(x, k)]) for x, k in zip((first, feature, times, h, n), kinds, strict=True)], names=["first", "feature", "times", "hashes", "counts"])

        for batch in batches:
            data, at = flat(batch.column("text"))
            for low, high in slices(at, 1_000_000):
                found = tokens_of(data[at[low] : at[high]], at[low : high + 1] - at[low], None)
                real = found.hashes != END
                hashes, doc = found.hashes[real], found.doc[real]
                key, times = np.unique(doc * FEATURES + (hashes & np.uint64(FEATURES - 1)).astype(np.int64), return_counts=True)
                yield row(np.searchsorted(key, np.arange(high - low + 1) * FEATURES), key % FEATURES, times)
                held.append((hashes, np.ones(len(hashes), np.int64)))
                if sum(len(h) for h, _ in held) > 1_000_000 and len(folded()[0]) > 500_000:
                    yield row((), (), (), *held.pop())
        if held:
            yield row((), (), (), *folded())

    return staged(docs.select("text").mapInArrow(handing_back(count), "first binary, feature binary, times binary, hashes binary, counts binary"))


def frequent_words(parts: DataFrame, many: int) -> np.ndarray:
    """Hashes of the words that all texts hold most often, in order."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, n in zip(batch.column("hashes"), batch.column("counts"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h.as_py(), np.int64)), pa.array(np.frombuffer(n.as_py(), np.int64))], names=["word", "n"])

    words_ = parts.where("length(hashes) > 0").select("hashes", "counts").mapInArrow(unfold, "word long, n long")
    top = words_.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(many).collect()
    return np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))


def learn_contexts(docs: DataFrame, train: Column, seed: int, rounds: int = 8) -> Contexts | None:
    """A mixture of word distributions, fitted by expectation-maximisation to all training documents.

    Each round is a pass over their features, whose sums alone (FEATURES by CLASSES, added up in the
    cluster) reach the driver.  The first centre is their mean, each further one a document drawn
    with a chance that grows with its distance from those before it, over all documents."""
    parts = spread(docs.where(train))
    texts = parts.where("length(first) > 8").select("first", "feature", "times")
    frequent = frequent_words(parts, FREQUENT - 1)

    def slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for row in rows_of(batch):
                first = np.frombuffer(row["first"], np.int64)
                yield first, np.frombuffer(row["feature"], np.uint16).astype(np.int64), np.frombuffer(row["times"], np.uint32).astype(float)

    def added(phi: np.ndarray | None, pi: np.ndarray) -> np.ndarray:
        """Feature sums by class, then documents by class."""
        size = FEATURES * CLASSES

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mass, docs_ = np.zeros((CLASSES, FEATURES)), np.zeros(CLASSES)
            for first, feature, times in slices_of(batches):
                n = np.diff(first)
                owner = np.repeat(np.arange(len(n)), n)
                if phi is None:
                    mass[0] += np.bincount(feature, times, FEATURES)
                    docs_[0] += len(n)
                    continue
                for low in range(0, len(n), 256):
                    at = slice(first[low], first[min(low + 256, len(n))])
                    mine, f, x = owner[at] - low, feature[at], times[at]
                    many = min(256, len(n) - low)
                    dense = 64 * len(f) > many * FEATURES  # else most texts have few words
                    if dense:
                        table = np.zeros((many, FEATURES))
                        table[mine, f] = x
                        score = table @ phi + pi
                    else:
                        score = np.stack([np.bincount(mine, x * phi[f, k], many) for k in range(CLASSES)], 1) + pi
                    post = np.exp(score - score.max(1, keepdims=True))
                    post /= post.sum(1, keepdims=True)
                    if dense:
                        mass += post.T @ table
                    else:
                        for k in range(CLASSES):
                            mass[k] += np.bincount(f, x * post[mine, k], FEATURES)
                    docs_ += post.sum(0)
            # In whole parts of 2**-20, whose sums don't depend on their order.
            out = np.rint(np.append(mass.ravel(), docs_) * 2**20) / 2**20
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["key", "value"])

        return collected(texts.mapInArrow(handing_back(sums), "key long, value double"), size + CLASSES)

    def farthest(centres: np.ndarray, turn: int) -> np.ndarray | None:
        """A document's shares, drawn by squared distance from the nearest centre."""

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = (np.inf, b"", b"")
            for first, feature, times in slices_of(batches):
                n = np.diff(first)
                owner = np.repeat(np.arange(len(n)), n)
                has = n > 0
                at = first[:-1][has]
                if not len(at):
                    continue
                share = times / np.repeat(np.add.reduceat(times, at), n[has])
                gap = np.full(len(n), np.inf)
                for c in centres:  # |share - c| summed over features
                    own = c[feature]
                    gap[has] = np.minimum(gap[has], c.sum() + np.add.reduceat(np.abs(share - own) - own, at))
                # Least exponential over weight: a draw of all documents, told by their features' hash.
                mark = mixed(np.bincount(owner, times * (feature + 1) * np.sqrt(feature + 2), len(n)).view(np.uint64) + np.uint64(seed * 64 + turn))
                key = -np.log((mark >> np.uint64(11)).astype(float) / 2**53 + 1e-17) / np.maximum(gap, 1e-9) ** 2
                key[n == 0] = np.inf
                k = int(key.argmin())
                if key[k] < best[0]:
                    best = (float(key[k]), feature[first[k] : first[k + 1]].tobytes(), share[first[k] : first[k + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.binary()), pa.array([best[2]], pa.binary())], names=["at", "feature", "share"])

        row = texts.mapInArrow(handing_back(draw), "at double, feature binary, share binary").orderBy("at", "feature", "share").first()
        if row is None or not row["feature"]:
            return None
        out = np.zeros(FEATURES)
        out[np.frombuffer(row["feature"], np.int64)] = np.frombuffer(row["share"])
        return out

    whole = added(None, np.zeros(CLASSES))
    if not whole[FEATURES * CLASSES :].sum():
        released(parts)
        return None
    mean = whole[:FEATURES] / max(1.0, whole[:FEATURES].sum())
    centres = [mean]
    for turn in range(CLASSES):
        found = farthest(np.array(centres), turn)
        centres.append(mean if found is None else found)
    phi, pi = np.log(0.5 * np.array(centres[1:]) + 0.5 * mean + 1e-6).T, np.full(CLASSES, -np.log(CLASSES))
    for _ in range(rounds):
        sums = added(np.ascontiguousarray(phi), pi)
        mass, in_class = sums[: FEATURES * CLASSES].reshape(CLASSES, FEATURES) + 0.01, sums[FEATURES * CLASSES :]
        phi, pi = np.log(mass / mass.sum(1, keepdims=True)).T, np.log((in_class + 1) / (in_class.sum() + CLASSES))
    released(parts)
    return Contexts(np.ascontiguousarray(phi).astype(np.float32), pi, frequent)


def order_of(major: np.ndarray, minor: np.ndarray, bits: int, shift: int) -> np.ndarray:
    """The order by major, then minor, from one sort of the leading bits of both; `bits` of them are
    minor's, less its last `shift`."""
    key = (major >> np.uint64(bits) << np.uint64(bits)) | (minor >> np.uint64(shift))
    order = np.argsort(key)
    a, b, k = major[order], minor[order], key[order]
    other = a[1:] != a[:-1]
    if (other & ((a[1:] ^ a[:-1]) >> np.uint64(bits) == 0)).any():
        return np.lexsort((minor, major))
    same = k[1:] == k[:-1]
    odd = same & (b[1:] != b[:-1])
    if odd.any():
        run = np.cumsum(np.append(True, ~same)) - 1
        mixed_ = np.zeros(run[-1] + 1, bool)
        mixed_[run[1:][odd]] = True
        at = np.flatnonzero(mixed_[run])
        order[at] = order[at][np.lexsort((b[at], run[at]))]
    return order


def grouped(major: np.ndarray, minor: np.ndarray, bits: int, shift: int, *weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Different (major, minor) pairs in order: both, sums of weights, a place of each, and the pair
    of every place."""
    order = order_of(major, minor, bits, shift)
    a, b = major[order], minor[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begin = np.flatnonzero(new)
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(new) - 1
    sums = [np.add.reduceat(w[order], begin) if len(begin) else np.zeros(0, np.int64) for w in weights]
    return a[begin], b[begin], sums, order[begin], back


def by_word(hashes: np.ndarray, context: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Different pairs of a word and its context's number, in that order."""
    return grouped(hashes, context.astype(np.uint64), 8, 0, *weights)


def by_before(before: np.ndarray, hashes: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Different pairs of the word before and a word, in that order."""
    return grouped(before, hashes, 26, 38, *weights)


def begins(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def spans(values: np.ndarray) -> list[slice]:
    """Runs of equal values."""
    return [slice(a, b) for a, b in itertools.pairwise([*begins(values), len(values)])]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal values: value and length of each."""
    at = begins(values)
    return values[at], np.diff(np.append(at, len(values))).astype(np.uint32)


def dealt_by(where: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The numbers in `where`, in order, and the places of each."""
    order = np.argsort(where, kind="stable")
    cuts = begins(where[order])
    return where[order][cuts], np.split(order, cuts[1:]) if len(cuts) else []


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time: each is large."""
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(24)) % np.uint64(ranges)).astype(np.int64)


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def planes(arrays: list[np.ndarray]) -> pa.Array:
    """As `binary`, but the first bytes of all numbers stand together, then the second ones and so on,
    so that small numbers compress."""
    return pa.array([np.ascontiguousarray(x).reshape(-1, 1).view(np.uint8).T.tobytes() for x in arrays], pa.binary())


def numbers(data: bytes, kind: type) -> np.ndarray:
    """What `planes` wrote."""
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


WORDS = "range long, hashes binary, contexts binary, counts binary, direct binary, words binary"
BEFORE_WORDS = "range long, runs binary, cells binary, counts binary, hashes binary, classes binary"
#: Who asks for which pairs of a row: chunks, and the steps from one asked place to the next.
ASKED = ", chunks array<long>, places array<binary>"


def steps(places: np.ndarray) -> bytes:
    return planes([np.diff(places, prepend=0).astype(np.uint32)])[0].as_py()


def stepped(data: bytes) -> np.ndarray:
    return np.cumsum(numbers(data, np.uint32).astype(np.int64))


def tokens_by_slice(group: pa.Table, known: Contexts | None) -> Iterator[tuple[int, Tokens]]:
    """Tokens of a chunk's texts, some texts at a time, and which is the first of these."""
    data, at = flat(group["text"])
    for low, high in slices(at, 1_000_000):
        yield low, tokens_of(data[at[low] : at[high]], at[low : high + 1] - at[low], known)


def joined(group: pa.Table, name: str, kind: type) -> np.ndarray:
    read = np.frombuffer if kind in (np.uint8, np.uint64) else numbers
    return np.concatenate([read(x.as_py(), kind) for x in group[name]])


def asked_by(group: pa.Table, back: np.ndarray, sizes: list[int], wanted: np.ndarray | None) -> list[pa.Array]:
    """Chunks of a range's parts, and where their wanted pairs are."""
    at = np.cumsum([0, *sizes])
    places = [steps(back[x:y] if wanted is None else back[x:y][wanted[x:y]]) for x, y in itertools.pairwise(at)]
    return [pa.array([group["chunk"].to_pylist()], pa.list_(pa.int64())), pa.array([places], pa.list_(pa.binary()))]


def counted_words(dealt: DataFrame, known: Contexts | None, ranges: int) -> DataFrame:
    """One row per range of words as flat arrays: hashes and numbers of contexts, counts, those of them
    whose word before is frequent or missing (direct), and letters.  Chunks want the pairs that they
    have with such a word before."""

    def count(group: pa.Table) -> pa.Table:
        parts, spellings = [], []
        data, at = flat(group["text"])
        raw = LOWER[data].tobytes()
        train = np.array(group["train"].to_pylist(), bool)
        for low, found in tokens_by_slice(group, known):
            weight, free = train[low + found.doc].astype(np.int64), found.before == 0
            h, c, sums, token, _ = by_word(found.hashes, found.context, weight, weight * free, free.astype(np.int64))
            parts.append((h, c, *sums))
            once = begins(h)
            spellings.append((h[once], found.start[token[once]] + at[low], found.length[token[once]]))
        h, c, *sums = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, c, (n, direct, wanted), _, _ = by_word(h, c, *sums)
        number, rows = dealt_by(range_of(h, ranges))
        known_, start, length = (np.concatenate(x) for x in zip(*spellings, strict=True))
        order = np.argsort(known_)
        known_, start, stop = known_[order], start[order], (start + length)[order]

        def letters(hashes: np.ndarray) -> bytes:
            place = np.searchsorted(known_, runs(hashes)[0])
            return b"\n".join([raw[a:b] for a, b in zip(start[place].tolist(), stop[place].tolist(), strict=True)])

        spelt = [letters(h[x]) for x in rows]
        columns = [
            binary([h[x] for x in rows]), binary([c[x].astype(np.uint8) for x in rows]), planes([n[x] for x in rows]), planes([direct[x] for x in rows]), pa.array(spelt, pa.binary()),
            pa.array(np.full(len(rows), group["chunk"][0].as_py())), binary([(wanted[x] > 0).astype(np.uint8) for x in rows]),
        ]
        return pa.table([pa.array(number), *columns], names=[*names, "chunk", "wanted"])

    def merge(group: pa.Table) -> pa.Table:
        letters: dict[int, bytes] = {}
        sizes = []
        for x, spelt in zip(group["hashes"], group["words"], strict=True):
            h = np.frombuffer(x.as_py(), np.uint64)
            sizes.append(len(h))
            letters.update(zip(runs(h)[0].tolist(), spelt.as_py().split(b"\n"), strict=True))
        h, c = joined(group, "hashes", np.uint64), joined(group, "contexts", np.uint8)
        h, c, (n, direct), _, back = by_word(h, c, joined(group, "counts", np.int64), joined(group, "direct", np.int64))
        spelt = b"\n".join(letters[w] for w in runs(h)[0].tolist())
        columns = [binary([h]), binary([c.astype(np.uint8)]), planes([n]), planes([direct]), pa.array([spelt], pa.binary())]
        return pa.table([group["range"].slice(0, 1), *columns, *asked_by(group, back, sizes, joined(group, "wanted", np.uint8) > 0)], names=[*names, "chunks", "places"])

    names = [x.split()[0] for x in WORDS.split(", ")]
    parts_ = dealt.groupBy("chunk").applyInArrow(of_one(count), WORDS + ", chunk long, wanted binary")
    return freed(parts_.groupBy("range").applyInArrow(of_one(merge), WORDS + ASKED))


def counted_before(dealt: DataFrame, known: Contexts | None, ranges: int) -> DataFrame:
    """One row per range, numbered from `ranges` on, of less frequent words before as flat arrays: so
    many words follow each (runs), which these are, by cells, and counts; then the cells, different
    words of a class in the order of the words' ranges: hashes and classes."""

    def count(group: pa.Table) -> pa.Table:
        parts = []
        train = np.array(group["train"].to_pylist(), bool)
        for low, found in tokens_by_slice(group, known):
            far = found.before != 0
            b, h, (n,), _, _ = by_before(found.before[far], found.hashes[far], train[low + found.doc[far]].astype(np.int64))
            parts.append((b, h, n))
        b, h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        b, h, (n,), _, _ = by_before(b, h, n)
        number, rows = dealt_by(ranges + range_of(b, ranges))
        of = [runs(b[x]) for x in rows]
        columns = [binary([h[x] for x in rows]), binary([x for x, _ in of]), planes([x for _, x in of]), planes([n[x] for x in rows]), pa.array(np.full(len(rows), group["chunk"][0].as_py()), pa.int64())]
        return pa.table([pa.array(number, pa.int64()), *columns], names=["range", "hashes", "contexts", "runs", "counts", "chunk"])

    def merge(group: pa.Table) -> pa.Table:
        sizes = [len(x.as_py()) // 8 for x in group["hashes"]]
        b = np.repeat(joined(group, "contexts", np.uint64), joined(group, "runs", np.uint32))
        b, h, (n,), _, back = by_before(b, joined(group, "hashes", np.uint64), joined(group, "counts", np.int64))
        asked = asked_by(group, back, sizes, None)
        cell_h, kind, _, _, cell = grouped(h, b & CLASS_BITS, 3, 0)
        order = np.argsort(range_of(cell_h, ranges), kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        columns = [planes([runs(b)[1]]), planes([place[cell]]), planes([n]), binary([cell_h[order]]), binary([kind[order].astype(np.uint8)])]
        return pa.table([group["range"].slice(0, 1), *columns, *asked], names=[*names, "chunks", "places"])

    names = [x.split()[0] for x in BEFORE_WORDS.split(", ")]
    parts_ = dealt.groupBy("chunk").applyInArrow(of_one(count), "range long, hashes binary, contexts binary, runs binary, counts binary, chunk long")
    return freed(parts_.groupBy("range").applyInArrow(of_one(merge), BEFORE_WORDS + ASKED))


def seats(n: np.ndarray, parent: np.ndarray, d: np.ndarray, open_: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of `n` customers with one dish each.  A customer opens a table with weight
    open_ * parent, against (customers - d * tables) for joining one; beyond the 64th, customers
    come in groups of a quarter of those before, who see the same tables."""
    t = (n > 0).astype(np.int64)
    todo = np.flatnonzero(n > 1)
    at = 1
    while len(todo):
        step = 1 if at < 64 else at // 4
        group = np.minimum(step, n[todo] - at)
        new = open_[todo] * parent[todo]
        chance = new / np.maximum(at - d[todo] * t[todo] + new, 1e-12)
        t[todo] += rng.binomial(group, np.clip(chance, 0, 1))
        at += step
        todo = todo[n[todo] > at]
    return t


@dataclass
class Totals:
    """Customers and tables of every restaurant of words, and the discounts of their levels."""

    customers: np.ndarray  # CONTEXTS, then CLASSES, then one for all words
    tables: np.ndarray
    discount: np.ndarray  # three levels
    strength: float = 1.0

    @staticmethod
    def first(customers: np.ndarray) -> Totals:
        classes = customers.reshape(CLASSES, FREQUENT).sum(1)
        every = np.concatenate([customers, classes * 0.3, [classes.sum() * 0.1]])
        return Totals(every, every * 0.3, np.full(3, 0.5))

    def joined(self, at: np.ndarray, level: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return np.maximum(customers - self.discount[level] * tables, 0) / (self.strength + self.customers[at])

    def opened(self, at: np.ndarray, level: int) -> np.ndarray:
        return (self.strength + self.discount[level] * self.tables[at]) / (self.strength + self.customers[at])


class Words:
    """The words of a range, their counts and seats."""

    def __init__(self, row: dict):
        self.h = np.frombuffer(row["hashes"], np.uint64)
        self.context = np.frombuffer(row["contexts"], np.uint8).astype(np.int64)
        #: Customers of each pair: at first those that come from no restaurant of a word before.
        self.direct = self.n = numbers(row["direct"], np.int64)
        new = np.append(True, self.h[1:] != self.h[:-1])
        self.own, self.word = self.h[new], np.cumsum(new) - 1
        self.spelt = row["words"].split(b"\n") if row["words"] is not None else []
        # cells: different (word, class); those of a word follow each other
        cell = self.word * CLASSES + self.context // FREQUENT
        self.cell, self.of_cell = np.unique(cell, return_inverse=True)
        self.cell_word, self.cell_class = self.cell // CLASSES, self.cell % CLASSES
        self.total = np.bincount(self.word, numbers(row["counts"], np.int64), len(self.own)).astype(np.int64)

    def pairs_at(self, hashes: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Places of pairs that are there."""
        return np.searchsorted(self.word * CONTEXTS + self.context, np.searchsorted(self.own, hashes) * CONTEXTS + context)

    def sample(self, totals: Totals, spelling: np.ndarray, rng: np.random.Generator, sweeps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables per pair, cell and word after some sweeps of all levels."""
        t = np.minimum(self.n, 1)
        for _ in range(sweeps):
            in_cell = np.bincount(self.of_cell, t, len(self.cell)).astype(np.int64)
            t_cell = np.minimum(in_cell, 1)
            for _ in range(2):
                in_word = np.bincount(self.cell_word, t_cell, len(self.own)).astype(np.int64)
                open_word = np.full(len(self.own), totals.strength + totals.discount[2] * totals.tables[-1])
                t_word = seats(in_word, spelling, np.full(len(self.own), totals.discount[2]), open_word, rng)
                p_word = self.p_words(totals, spelling, in_word, t_word)
                at = CONTEXTS + self.cell_class
                t_cell = seats(in_cell, p_word[self.cell_word], np.full(len(at), totals.discount[1]), totals.strength + totals.discount[1] * totals.tables[at], rng)
            p_cell = self.p_cells(totals, p_word, in_cell, t_cell)
            t = seats(self.n, p_cell[self.of_cell], np.full(len(t), totals.discount[0]), totals.strength + totals.discount[0] * totals.tables[self.context], rng)
        in_cell = np.bincount(self.of_cell, t, len(self.cell)).astype(np.int64)
        t_cell = seats(in_cell, p_word[self.cell_word], np.full(len(at), totals.discount[1]), totals.strength + totals.discount[1] * totals.tables[at], rng)
        in_word = np.bincount(self.cell_word, t_cell, len(self.own)).astype(np.int64)
        t_word = seats(in_word, spelling, np.full(len(self.own), totals.discount[2]), open_word, rng)
        return t, t_cell, t_word

    @staticmethod
    def p_words(totals: Totals, spelling: np.ndarray, in_word: np.ndarray, t_word: np.ndarray) -> np.ndarray:
        last = np.array([CONTEXTS + CLASSES])
        return totals.joined(last, 2, in_word, t_word) + totals.opened(last, 2) * spelling

    def p_cells(self, totals: Totals, p_word: np.ndarray, in_cell: np.ndarray, t_cell: np.ndarray) -> np.ndarray:
        at = CONTEXTS + self.cell_class
        return totals.joined(at, 1, in_cell, t_cell) + totals.opened(at, 1) * p_word[self.cell_word]

    def p_pairs(self, totals: Totals, spelling: np.ndarray, t: np.ndarray, t_cell: np.ndarray, t_word: np.ndarray) -> np.ndarray:
        in_cell = np.bincount(self.of_cell, t, len(self.cell))
        p_word = self.p_words(totals, spelling, np.bincount(self.cell_word, t_cell, len(self.own)), t_word)
        p_cell = self.p_cells(totals, p_word, in_cell, t_cell)
        return totals.joined(self.context, 0, self.n, t) + totals.opened(self.context, 0) * p_cell[self.of_cell]

    def sums(self, t: np.ndarray, t_cell: np.ndarray, t_word: np.ndarray) -> np.ndarray:
        """Customers and tables of all restaurants that these words add, and how many pairs, cells
        and words have one and two customers."""
        in_cell = np.bincount(self.of_cell, t, len(self.cell))
        in_word = np.bincount(self.cell_word, t_cell, len(self.own))
        levels = [(self.context, CONTEXTS, self.n, t), (self.cell_class, CLASSES, in_cell, t_cell), (np.zeros(len(self.own), np.int64), 1, in_word, t_word)]
        customers = np.concatenate([np.bincount(at, n, size) for at, size, n, _ in levels])
        tables = np.concatenate([np.bincount(at, k, size) for at, size, _, k in levels])
        return np.concatenate([customers, tables, [(n == k).sum() for _, _, n, _ in levels for k in (1, 2)]])


class Followers:
    """What follows the words of a range that are not among the frequent, and their restaurants."""

    def __init__(self, row: dict):
        many = numbers(row["runs"], np.uint32)
        self.of = np.repeat(np.arange(len(many)), many)
        self.cell = numbers(row["cells"], np.int32)
        self.n = numbers(row["counts"], np.int64)
        self.customers = np.bincount(self.of, self.n, len(many))

    def asks(self, row: dict, ranges: int, tables: list[np.ndarray]) -> pa.RecordBatch:
        """To each range of words: the tables that are opened of its words, for each of some samples."""
        hashes, classes = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["classes"], np.uint8)
        opened = [np.bincount(self.cell, t, len(hashes)).astype(np.uint32) for t in tables]
        where = range_of(hashes, ranges)
        rows = spans(where)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(where[begins(where)]), pa.array(np.full(len(rows), row["range"])), binary([hashes[x] for x in rows]),
                binary([classes[x] for x in rows]), planes([np.concatenate([o[x] for o in opened]) for x in rows]),
            ],
            names=["range", "source", "hashes", "classes", "opened"],
        )

    def sample(self, parent: np.ndarray, discount: float, rng: np.random.Generator, sweeps: int) -> np.ndarray:
        """Tables per pair, given their probabilities in the parent."""
        t = np.minimum(self.n, 1)
        for _ in range(sweeps):
            opening = 1.0 + discount * np.bincount(self.of, t, len(self.customers))
            t = seats(self.n, parent, np.full(len(t), discount), opening[self.of], rng)
        return t

    def p_pairs(self, parent: np.ndarray, discount: float, t: np.ndarray) -> np.ndarray:
        opening = 1.0 + discount * np.bincount(self.of, t, len(self.customers))
        return (np.maximum(self.n - discount * t, 0) + opening[self.of] * parent) / (1.0 + self.customers)[self.of]


def letter_keys(spelt: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words' letters, each with the word's end: the key of the letter and the three before
    it, the byte (256 for the end), and the word."""
    raw = np.frombuffer(b"".join(x + b"\0" for x in spelt), np.uint8)
    size = np.array([len(x) + 1 for x in spelt], np.int64)
    word = np.repeat(np.arange(len(spelt)), size)
    nth = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
    last = nth == np.repeat(size - 1, size)
    letter = np.where(last, WORD_END, LETTER[raw]).astype(np.int64)
    key = letter.copy()
    for back in (1, 2, 3):
        before = np.full(len(raw), BEFORE)
        before[back:] = np.where(nth[back:] >= back, letter[:-back], BEFORE)
        key += before * LETTERS**back
    return key, np.where(last, 256, raw.astype(np.int64)), word


@dataclass
class Spelling:
    """Probability of a letter after three, for all 48**4 of them, and of a byte given its letter."""

    letter: np.ndarray
    byte: np.ndarray

    @staticmethod
    def learn(counts: np.ndarray, bytes_: np.ndarray, seed: int, burn: int = 3, samples: int = 3) -> Spelling:
        rng = np.random.default_rng(seed)
        kind = np.append(LETTER, WORD_END)
        of_kind = np.bincount(kind, bytes_, LETTERS)
        kinds = np.bincount(kind, minlength=LETTERS)
        byte = (bytes_ + 0.5) / (of_kind + 0.5 * np.maximum(kinds, 1))[kind]
        base = 1.0 / (LETTERS - 1)
        tables = [np.minimum(counts, 1)]
        for level in (3, 2, 1):
            tables.append(np.minimum(tables[-1].reshape(LETTERS, -1).sum(0), 1))
        mean = np.zeros(LETTERS**4)
        for turn in range(burn + samples):
            customers = [counts] + [t.reshape(LETTERS, -1).sum(0) for t in tables[:3]]
            p: np.ndarray | float = base
            for level in (3, 2, 1, 0):  # from no letter before to three
                n, t = customers[level].reshape(-1, LETTERS), tables[level].reshape(-1, LETTERS)
                once, twice = float((n == 1).sum()), float((n == 2).sum())
                d = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.1
                parent = np.broadcast_to(np.tile(np.reshape(p, (-1, LETTERS)), (LETTERS, 1)) if level < 3 else base, n.shape)
                opening = 1.0 + d * t.sum(1, keepdims=True)
                flat_n = n.ravel()
                some = np.flatnonzero(flat_n > 0)
                fresh = np.zeros(flat_n.shape, np.int64)
                fresh[some] = seats(flat_n[some], parent.ravel()[some], np.full(len(some), d), np.broadcast_to(opening, n.shape).ravel()[some], rng)
                tables[level] = fresh
                t = fresh.reshape(-1, LETTERS)
                p = ((n - d * t) + (1.0 + d * t.sum(1, keepdims=True)) * parent) / (1.0 + n.sum(1, keepdims=True))
                p = p.ravel()
            if turn >= burn:
                mean += p / samples
        return Spelling(mean.astype(np.float32), byte)

    def words(self, spelt: list[bytes], own: np.ndarray) -> np.ndarray:
        """Probability of each word's spelling; the end token counts as a word of no letters."""
        if not spelt:
            return np.zeros(0)
        key, raw, word = letter_keys(spelt)
        return np.exp(np.bincount(word, np.log(self.letter[key]) + np.log(self.byte[raw]), len(spelt)))


def rough_spelling(spelt: list[bytes]) -> np.ndarray:
    return np.array([30.0 ** -(len(x) + 1) for x in spelt])


def score(
    docs: DataFrame,
    held_out: Column,
    samples: int = 3,
    range_bytes: int = 6_000_000,
    part_bytes: int = 8_000_000,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both
    log10).  `held_out` is a condition over doc_id."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("train", ~held_out)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(4, -(-total // range_bytes))
    known = learn_contexts(rows, F.col("train"), seed)
    chunks = max(4, -(-total // part_bytes))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition(chunks, "chunk")
    of_words, of_before = counted_words(dealt, known, ranges), counted_before(dealt, known, ranges)

    def keyed(out: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(out)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["key", "value"])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CONTEXTS + 4)
        for batch in batches:
            for row in rows_of(batch):
                w = Words(row)
                out[:CONTEXTS] += np.bincount(w.context, w.direct, CONTEXTS)
                out[CONTEXTS : CONTEXTS + 2] += [w.total.sum(), (w.total > 0).sum()]
        yield keyed(out)

    def plain_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CONTEXTS + 4)
        for batch in batches:
            for row in rows_of(batch):
                f = Followers(row)
                out[:CONTEXTS:FREQUENT] += np.bincount(np.frombuffer(row["classes"], np.uint8)[f.cell], f.n > 0, CLASSES)
                out[CONTEXTS + 2 :] += [(f.n == k).sum() for k in (1, 2)]
        yield keyed(out)

    sums_ = "key long, value double"
    counts = of_words.drop("chunks", "places").mapInArrow(handing_back(plain), sums_).union(of_before.drop("chunks", "places").mapInArrow(handing_back(plain_before), sums_))
    customers = collected(counts, CONTEXTS + 4)
    n_train, n_words, once, twice = (int(x) for x in customers[CONTEXTS:])
    totals = Totals.first(customers[:CONTEXTS])
    discount = float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9))
    size = 2 * (CONTEXTS + CLASSES + 1) + 6
    asking = "range long, source long, hashes binary, classes binary, opened binary"

    def first_asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                f = Followers(row)
                yield f.asks(row, ranges, [np.minimum(f.n, 1)])

    def arrived(w: Words, right: pa.Table, many: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Where in the range each asker's pairs are, and the tables opened of all its pairs in each sample."""
        places = [w.pairs_at(np.frombuffer(h.as_py(), np.uint64), np.frombuffer(k.as_py(), np.uint8).astype(np.int64) * FREQUENT) for h, k in zip(right["hashes"], right["classes"], strict=True)]
        opened = [numbers(x.as_py(), np.uint32).reshape(many, -1) for x in right["opened"]]
        if not places:
            return [], np.zeros((many, len(w.n)), np.int64)
        at, each = np.concatenate(places), np.concatenate(opened, 1)
        return places, np.array([np.bincount(at, x, len(w.n)) for x in each]).astype(np.int64)

    def burn(left: pa.Table, right: pa.Table) -> pa.Table:
        w = Words(left.to_pylist()[0])
        number = left["range"][0].as_py()
        places, opened = arrived(w, right, 1)
        w.n = w.direct + opened[0]
        spelt = rough_spelling(w.spelt)
        now = w.sample(totals, spelt, np.random.default_rng(seed + number), 2)
        key, raw, word = letter_keys(w.spelt)
        found, at, done = [], [], 0
        for x in (w.sums(*now), np.bincount(raw, now[2][word], 257), np.bincount(key, now[2][word], LETTERS**4)):
            some = np.flatnonzero(x)
            found.append(x[some])
            at.append(done + some)
            done += len(x)
        found, at = np.concatenate(found).astype(float), np.concatenate(at)
        logs = np.log(np.maximum(w.p_pairs(totals, spelt, *now), 1e-300)).astype(np.float32)
        return pa.table(
            {
                "range": pa.array([-1, *right["source"].to_pylist()], pa.int64()), "source": pa.array([number] * (len(places) + 1)), "logs": planes([logs[:0], *(logs[x] for x in places)]),
                "keys": binary([at, *[np.zeros(0)] * len(places)]), "sums": binary([found, *[np.zeros(0)] * len(places)]),
            }
        )

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x in zip(batch.column("keys"), batch.column("sums"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k.as_py(), np.int64)), pa.array(np.frombuffer(x.as_py()))], names=["key", "value"])

    burnt = freed(of_words.drop("chunks", "places").groupBy("range").cogroup(of_before.drop("chunks", "places").mapInArrow(handing_back(first_asks), asking).groupBy("range")).applyInArrow(of_two(burn), "range long, source long, logs binary, keys binary, sums binary"))
    learnt = collected(burnt.where("range < 0").select("keys", "sums").mapInArrow(unfold, "key long, value double"), size + 257 + LETTERS**4)
    spelling = Spelling.learn(np.rint(learnt[size + 257 :]).astype(np.int64), learnt[size : size + 257], seed)

    def totals_of(sums: np.ndarray) -> Totals:
        half = (size - 6) // 2
        once, twice = sums[-6::2], sums[-5::2]
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
        return Totals(sums[:half], sums[half : 2 * half], discount)

    spark = docs.sparkSession
    given = spark.sparkContext.broadcast((spelling, totals_of(learnt[:size])))

    def replied(right: pa.Table, many: int) -> np.ndarray:
        """Log probabilities of a range's cells in each sample, as the ranges of their words told them."""
        right = right.sort_by([("source", "ascending")])
        return np.concatenate([numbers(x.as_py(), np.float32).reshape(many, -1) for x in right["logs"]], 1).astype(float)

    def seat_before(left: pa.Table, right: pa.Table) -> pa.Table:
        f = Followers(left.to_pylist()[0])
        parent = np.exp(replied(right, 1)[0])[f.cell]
        rng = np.random.default_rng([seed, left["range"][0].as_py(), 1])
        tables = [f.sample(parent, discount, rng, 2).astype(np.uint32) for _ in range(samples)]
        return left.append_column("tables", planes([np.concatenate(tables)]))

    seated_before = freed(
        of_before.groupBy("range")
        .cogroup(burnt.where("range >= 0").select("range", "source", "logs").groupBy("range"))
        .applyInArrow(of_two(seat_before), BEFORE_WORDS + ASKED + ", tables binary")
    )
    released(burnt)
    released(of_before)

    def later_asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                yield Followers(row).asks(row, ranges, list(numbers(row["tables"], np.uint32).reshape(samples, -1)))

    def seat(left: pa.Table, right: pa.Table) -> pa.Table:
        spelling, totals = given.value
        row = left.to_pylist()[0]
        w = Words(row)
        places, opened = arrived(w, right, samples)
        rng = np.random.default_rng([seed, row["range"], 1])
        spelt, tables, sums = spelling.words(w.spelt, w.own), [], []
        for each in opened:
            w.n = w.direct + each
            now = w.sample(totals, spelt, rng, 2)
            tables.append(np.concatenate(now).astype(np.uint32))
            sums.append(w.sums(*now))
        added = [
            binary([spelt]), planes([np.concatenate(tables)]), planes([opened.astype(np.uint32).ravel()]), pa.array([np.concatenate(sums)]),
            pa.array([right["source"].to_pylist()], pa.list_(pa.int64())), pa.array([[planes([x.astype(np.int32)])[0].as_py() for x in places]], pa.list_(pa.binary())),
        ]
        for name, column in zip(("spelling", "tables", "opened", "sums", "sources", "cells"), added, strict=True):
            left = left.append_column(name, column)
        return left.drop_columns(["words"])

    seated = freed(
        of_words.groupBy("range").cogroup(seated_before.drop("chunks", "places").mapInArrow(handing_back(later_asks), asking).groupBy("range"))
        .applyInArrow(of_two(seat), "range long, hashes binary, contexts binary, counts binary, direct binary" + ASKED + ", spelling binary, tables binary, opened binary, sums array<double>, sources array<long>, cells array<binary>")
    )
    released(of_words)
    sums = collected(seated.select(F.posexplode("sums").alias("key", "value")), samples * size).reshape(samples, size)
    sampled = [totals_of(x) for x in sums]
    for x in sampled:
        x.discount = given.value[1].discount

    def words_seated(row: dict) -> tuple[Words, np.ndarray]:
        """The words of a seated row, and the probabilities of their pairs in each sample."""
        w = Words({**row, "words": None})
        spelt = np.frombuffer(row["spelling"])
        tables = numbers(row["tables"], np.uint32).astype(np.int64).reshape(samples, -1)
        opened = numbers(row["opened"], np.uint32).astype(np.int64).reshape(samples, -1)
        out = []
        for totals, seated_, each in zip(sampled, tables, opened, strict=True):
            w.n = w.direct + each
            out.append(w.p_pairs(totals, spelt, *np.split(seated_, [len(w.n), len(w.n) + len(w.cell)])))
        return w, np.array(out)

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                w, p = words_seated(row)
                logs, cells = np.log(np.maximum(p, 1e-300)).astype(np.float32), [numbers(x, np.int32) for x in row["cells"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["sources"], pa.int64()), pa.array([row["range"]] * len(cells), pa.int64()), planes([logs[:, x].ravel() for x in cells]), planes([w.total[w.word[x]] for x in cells])],
                    names=["range", "source", "logs", "counts"],
                )

    # Scoring: every pair's probability and its word's count, and what chunks of documents asked for.
    scored = "range long, counts binary, logs binary" + ASKED

    def row_scored(row: dict, p: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        logs = np.log10(np.maximum(p.mean(0), 1e-300)).astype(np.float32)
        columns = [pa.array([row["range"]], pa.int64()), planes([count]), planes([logs]), pa.array([row["chunks"]], pa.list_(pa.int64())), pa.array([row["places"]], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=["range", "counts", "logs", "chunks", "places"])

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                w, p = words_seated(row)
                yield row_scored(row, p, w.total[w.word])

    def score_before(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        f = Followers(row)
        right = right.sort_by([("source", "ascending")])
        tables = numbers(row["tables"], np.uint32).astype(np.int64).reshape(samples, -1)
        p = np.array([f.p_pairs(x[f.cell], discount, t) for x, t in zip(np.exp(replied(right, samples)), tables, strict=True)])
        count = np.concatenate([numbers(x.as_py(), np.int64) for x in right["counts"]])[f.cell]
        return pa.Table.from_batches([row_scored(row, p, count)])

    replies = seated.drop("chunks", "places", "sums").mapInArrow(handing_back(reply), "range long, source long, logs binary, counts binary")
    of_words = freed(seated.drop("sums", "sources", "cells").mapInArrow(handing_back(score_words), scored))
    of_before = freed(seated_before.drop("hashes", "classes").groupBy("range").cogroup(replies.groupBy("range")).applyInArrow(of_two(score_before), scored))
    released(seated)
    released(seated_before)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                count, logs = numbers(row["counts"], np.int64), numbers(row["logs"], np.float32)
                places = [stepped(x) for x in row["places"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["chunks"], pa.int64()), pa.array([row["range"]] * len(places), pa.int64()), planes([count[x] for x in places]), planes([logs[x] for x in places])],
                    names=["chunk", "range", "counts", "logs"],
                )

    answers = of_words.union(of_before).mapInArrow(handing_back(answer), "chunk long, range long, counts binary, logs binary")

    def chunk_pairs(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The place of each token's pair among those that the chunk asked for, by range and in their
        order there, and the token's text."""
        slices_: list[list[tuple[np.ndarray, ...]]] = [[], []]
        for low, found in tokens_by_slice(group, known):
            for kept, join, a, b in ((found.before == 0, by_word, found.hashes, found.context), (found.before != 0, by_before, found.before, found.hashes)):
                x, y, _, _, back = join(a[kept], b[kept])
                slices_[join is by_before].append((x, y, back, low + found.doc[kept]))
        tokens, docs_, done = [], [], 0
        for found, join in zip(slices_, (by_word, by_before), strict=True):
            a, _, _, _, merged = join(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
            order = np.argsort(range_of(a, ranges), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            begin = np.cumsum([0, *(len(x[0]) for x in found)])
            tokens += [done + place[merged[k + x[2]]] for k, x in zip(begin, found, strict=False)]
            docs_ += [x[3] for x in found]
            done += len(order)
        return np.concatenate(tokens), np.concatenate(docs_)

    kind = rows.schema["doc_id"].dataType.simpleString()

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        token, doc = chunk_pairs(left)
        right = right.sort_by([("range", "ascending")])
        count = np.concatenate([numbers(x.as_py(), np.int64) for x in right["counts"]])[token]
        logs = np.concatenate([numbers(x.as_py(), np.float32) for x in right["logs"]])[token].astype(float)
        base = np.log10((count + 0.1) / (n_train + 0.1 * (n_words + 1)))
        n = len(left)
        return pa.table(
            {
                "doc_id": left["doc_id"], "held_out": pa.array(~np.array(left["train"].to_pylist(), bool)), "n_tokens": pa.array(np.bincount(doc, minlength=n)),
                "n_known": pa.array(np.bincount(doc, count > 0, n).astype(np.int64)), "train_tokens": pa.array(np.full(n, n_train)),
                "base_score": pa.array(np.bincount(doc, base, n)), "score": pa.array(np.bincount(doc, logs, n)),
            }
        )

    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        of_two(add), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
