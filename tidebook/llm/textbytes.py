"""Whole Arrow batches of texts as byte arrays: words, their hashes and shingles, vectorised.

All functions look at the UTF-8 bytes of many texts at once.  Words are longest runs of bytes
other than space and 0x09-0x0D.  Hashes are 64-bit and depend on the bytes alone, so that every
task and every run gives the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at at once where each takes a hundred bytes of arrays or more: what
#: a Python worker once took of memory it keeps while it waits for the next stage.
SLICE = 250_000
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: One odd 64-bit factor and its inverse modulo 2**64; a word's hash is a polynomial in it.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
_RANDOM = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def flat(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, end to end, and where each begins; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array, "").cast(pa.large_string())
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most `most` bytes each, or one longer text."""
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield low, high
        low = high


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, 1 << 16), base, np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with all bits stirred."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end (bytes) of every word, and at which word each text begins."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~IS_SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = at[(at > 0) & (at < len(data))]
    begins[inner] |= solid[inner]
    ends[inner - 1] |= solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_RANDOM[data] * powers(FACTOR, len(data)), out=sums[1:])
        return mixed((sums[end] - sums[start]) * powers(INVERSE, len(data))[start] + (end - start).astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `size` words within a text, and the text it belongs to; a text of
    fewer words, but at least one, has one shingle of all its words."""
    n = np.diff(first)
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
        for k in range(size):
            total += hashes[k : k + len(total)] * powers(INVERSE, size + 1)[k + 1]
        owner = np.repeat(np.arange(len(n)), n)[: len(total)]
        inside = np.arange(len(total)) + size <= first[1:][owner]
        short = np.flatnonzero((n > 0) & (n < size))
        few = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = n[short] > k
            few[has] += hashes[first[:-1][short][has] + k] * powers(INVERSE, size + 1)[k + 1]
    found, whose = np.concatenate([total[inside], few]), np.concatenate([owner[inside], short])
    order = np.argsort(whose, kind="stable")
    return mixed(found[order]), whose[order]


def distinct(found: np.ndarray, whose: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (text, hash) pairs in order, and how often each occurs."""
    order = np.lexsort((found, whose))
    found, whose = found[order], whose[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (whose[1:] != whose[:-1])
    at = np.flatnonzero(new)
    return found[at], whose[at], np.diff(np.append(at, len(found)))
