"""Packing tokenised documents into sequences by first-fit decreasing.

Documents are tokenised once, cut only where they exceed a sequence, and dealt at random (by
hash) into groups of a bounded expected size.  Each group is packed on its own: pieces in order
of falling length, each into the first bin with room, found in a tournament tree of the bins'
remaining capacities.  Groups never meet, so nothing grows with the corpus but their number.

Defined results: a null or empty text is the end token alone; repeated rows are packed once per
row; an empty table gives no rows; a document of any length becomes pieces of at most
`capacity` ids; other columns of the input are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import handing_back
from tidebook.llm.textbytes import IS_SPACE, LOWER, SLICE, flat, slices, word_hashes, words

#: Classes of bytes: space, letters that the tokenizer keeps in one run, marks that it keeps in
#: one run, anything else.
_SPACE, _LETTER, _MARK, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[IS_SPACE] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[ord(x) for x in ".,;:!?*%&#$|-()+=/@_\""]] = _MARK


def _ragged(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each, end to end."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(start - (ends - length), length) + np.arange(total)]


class UnitTokenizer:
    """Ids of whole texts for a lower-casing tokenizer with word ends, which never joins text
    across white space.

    A unit is a run of plain letters or of marks within a word, or a whole word where the word
    holds anything else.  The ids of each different unit are kept, `most` of them at most, or
    those of the last texts where they have more; new runs of letters are tokenised together and told apart by the token that ends a run."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.hashes, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of letters, end to end, and how many each has."""
        spaced = np.full(int((length + 1).sum()), 32, np.uint8)
        ends = np.cumsum(length + 1)
        spaced[np.repeat(ends - length - 1, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = _ragged(data, start, length)
        cuts = [0, *ends[255::256].tolist(), len(spaced)]
        texts = [spaced[low:high].tobytes().decode() for low, high in zip(cuts, cuts[1:], strict=False)]
        found = [i for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in x.ids]
        ids = np.array(found, "<u4")
        counts = np.diff(np.append(-1, np.flatnonzero(self.ends[ids])))
        if len(counts) != len(start) or counts.sum() != len(ids):
            each = self.direct([data[a : a + n].tobytes().decode() for a, n in zip(start, length, strict=True)])
            return np.concatenate(each), np.array([len(x) for x in each])
        return ids, counts

    def _learn(self, raw: np.ndarray, low: np.ndarray, hashes: np.ndarray, start: np.ndarray, length: np.ndarray, letters: np.ndarray) -> None:
        ids, counts, order = [self.ids], [], []
        if letters.any():
            more, n = self._runs(low, start[letters], length[letters])
            ids.append(more)
            counts.append(n)
            order.append(hashes[letters])
        if not letters.all():
            rest = np.flatnonzero(~letters)
            each = self.direct([raw[a : a + n].tobytes().decode("utf-8", "replace") for a, n in zip(start[rest], length[rest], strict=True)])
            ids.extend(each)
            counts.append(np.array([len(x) for x in each]))
            order.append(hashes[rest])
        n = np.concatenate([self.length, *counts]).astype(np.int64)
        found = np.concatenate([self.hashes, *order])
        at = np.concatenate([self.start, len(self.ids) + np.cumsum(n[len(self.length) :]) - n[len(self.length) :]])
        by = np.argsort(found)
        self.hashes, self.start, self.length, self.ids = found[by], at[by], n[by], np.concatenate(ids)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and where each text's begin."""
        start, end, first = words(data, at)
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(len(at), np.int64)
        kind, low = _CLASS[data], LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        second = data[lead + 1]
        lead, second = lead[(second != 0x97) & (second != 0xB7)], second[(second != 0x97) & (second != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        low[lead + 1] = np.where(second <= 0x9E, second + 0x20, second)
        odd = np.add.reduceat(kind == _OTHER, start) > 0
        cut = np.zeros(len(data), bool)
        cut[1:] = kind[1:] != kind[:-1]
        word = np.repeat(np.arange(len(start)), end - start)
        inside = _ragged(np.arange(len(data)), start, end - start)
        cut[inside[odd[word]]] = False
        cut[start] = True
        begins = inside[cut[inside]]
        unit_word = word[cut[inside]]
        last = np.append(unit_word[1:] != unit_word[:-1], True)
        stops = np.where(last, end[unit_word], np.append(begins[1:], 0))
        whole = odd[unit_word]
        hashes = word_hashes(low, begins, stops)
        if whole.any():  # those keep their capitals
            hashes[whole] = word_hashes(data, begins[whole], stops[whole]) ^ np.uint64(1)
        different, sample, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hashes, different), max(len(self.hashes) - 1, 0))
        new = self.hashes[place] != different if len(self.hashes) else np.ones(len(different), bool)
        if new.any():
            if len(self.hashes) + new.sum() > self.most:
                # All units of these texts are needed at once, however many they are.
                self.forget()
                new[:] = True
            pick = sample[new]
            self._learn(data, low, different[new], begins[pick], (stops - begins)[pick], (kind[begins[pick]] == _LETTER) & ~whole[pick])
        place = np.searchsorted(self.hashes, different)
        length = self.length[place][back]
        sums = np.append(0, np.cumsum(length))
        word_first = np.searchsorted(unit_word, first)
        return _ragged(self.ids, self.start[place][back], length), sums[word_first]


#: One for each tokenizer file and Python worker, so that tasks share the units they have met.
_encoders: dict[str, UnitTokenizer] = {}


def encoder(path: str) -> UnitTokenizer:
    if path not in _encoders:
        _encoders[path] = UnitTokenizer(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Documents as pieces (doc_id, start, ids as little-endian 32-bit binary, doc_tokens)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for batch in batches:
            data, at = flat(batch.column(1))
            for low, high in slices(at, 2 * SLICE):
                ids, first = known.encode(data[at[low] : at[high]], at[low : high + 1] - at[low])
                ids = np.insert(ids, first[1:], end_id).astype("<u4")
                total = np.diff(first) + 1
                per = -(-total // capacity)
                which = np.repeat(np.arange(high - low), per)
                start = (np.arange(len(which)) - np.repeat(np.cumsum(per) - per, per)) * capacity
                length = np.minimum(total[which] - start, capacity)
                binary = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(which), [None, pa.py_buffer(np.append(0, 4 * np.cumsum(length)).astype(np.int64)), pa.py_buffer(ids)]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(low + which)), pa.array(start), binary.cast(pa.binary()), pa.array(total[which])],
                    names=["doc_id", "start", "ids", "doc_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        handing_back(cut), f"doc_id {kind}, start long, ids binary, doc_tokens long"
    )


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece.

    The tree's leaves are bins with their room, an inner node holds the most room below it;
    from the root, the left child is taken whenever it has room enough, which leads to the first
    bin that fits."""
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return bins, offsets


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end_id: int = 2,
    group_docs: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces with their sequence: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A group holds about `group_docs` documents, whatever the size of the corpus; a sequence's id
    is its group's number times 2**32 plus its number within the group."""
    groups = max(1, -(-docs.count() // group_docs))

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("tie", "ascending")])
        lengths = pc.binary_length(rows["ids"]).to_numpy().astype(np.int64) // 4
        bins, offsets = first_fit_decreasing(lengths, capacity)
        group = rows["group"].to_numpy()
        return pa.table(
            {
                "doc_id": rows["doc_id"], "start": rows["start"], "length": pa.array(lengths), "ids": rows["ids"],
                "doc_tokens": rows["doc_tokens"], "sequence_id": pa.array(group * (1 << 32) + bins), "offset": pa.array(offsets),
            }
        )

    cut = pieces(docs, tokenizer, end_id, capacity, id_col, text_col)
    cut = cut.withColumn("tie", F.crc32("ids")).withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "tie"), F.lit(groups)))
    kind = cut.schema["doc_id"].dataType.simpleString()
    return cut.groupBy("group").applyInArrow(
        fit, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
