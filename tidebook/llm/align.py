"""Alignment of two tokenizers' tokens, composed from fragments of byte ranges.

A text becomes bytes: a space and its UTF-8.  Tokenizer A (byte-level) and tokenizer B (pieces with
byte fallback) both cut those bytes into tokens; where both end one, a group ends.  Two tokens are
linked if their bytes overlap.

A fragment is what a byte range knows by itself: an open prefix (tokens before the first place
where both tokenizers surely end a token), closed groups, and an open suffix.  Two neighbours
compose: the left one's suffix and the right one's prefix close up at every place that both end.
The operation is associative and a range without tokens is its neutral element, so that a text of
any length is cut into ranges, each tokenised by a task of its own, and its fragments are reduced
in a tree, `fan` neighbours at a time; closed groups stay where they arose and only the open parts
travel.  Each tokenizer has its own rule for safe cuts: A's tokens never join a letter or digit
with a following space, line end or point; B's never join anything with a following single space.
A range begins at the first such place after its byte, for A and B each, and so with open parts.
A text without safe cuts is one range.

Corpus-wide counts of linked id pairs meet by pair: a slice of texts sends its different pairs
once, and gets their totals back once, so that the exchange is not of links but of a slice's
vocabulary of pairs.

Defined results: a text that is null or empty, or whose token bytes are not its own in either
tokenizer, has no tokens: zeros and an empty `groups`; its links count nowhere.  Repeated rows are
texts of their own, each with its own row.  Ties for a B id's highest count are all best.  An empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import staged

#: Where A and B each surely end a token.
#: How byte-level tokenizers cut words.  Fixed value.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAFE_A = re.compile(rb"(?<=[A-Za-z0-9])(?=[ \n.,;:!?])")
SAFE_B = re.compile(rb"(?<=[!-~])(?= [!-~])")


@dataclass
class ByteLevel:
    """A byte-level tokenizer: ids of a text, all of it plain text, and the bytes of every id."""

    encode: Callable[[str], list[int]]
    tokens: list[bytes]


def byte_level(path: str) -> ByteLevel:
    """Of a tokenizer's file.  Where its merges are in the order of its ids and it cuts words by the
    usual pattern only, a library that goes by ranks gives the same ids in a fourth of the time."""
    from tokenizers import Tokenizer

    with open(path) as file:
        held = json.load(file)
    # The byte-level alphabet: printable Latin-1 stands for itself, the rest for U+0100 onwards.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary, merges = held["model"]["vocab"], [x if isinstance(x, list) else x.split(" ") for x in held["model"]["merges"]]
    extra = {x["content"]: x["id"] for x in held["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in extra}
    tokens = [b""] * (max([*vocabulary.values(), *extra.values()]) + 1)
    for raw, i in [*ranks.items(), *((x.encode(), i) for x, i in extra.items())]:
        tokens[i] = raw
    in_order = all(vocabulary["".join(x)] == len(byte) + k for k, x in enumerate(merges))
    usual = held["normalizer"] is None and {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items() <= held["pre_tokenizer"].items()
    if in_order and usual and not held["model"].get("ignore_merges"):
        import tiktoken

        ranked = tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})
        return ByteLevel(ranked.encode_ordinary, tokens)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    tokenizer.encode_special_tokens = True
    return ByteLevel(lambda text: tokenizer.encode(text, add_special_tokens=False).ids, tokens)


class Tokenizers:
    """Ids of whole texts by both tokenizers."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        from sentencepiece import SentencePieceProcessor

        self.a = byte_level(byte_path)
        self.b = SentencePieceProcessor(model_file=piece_path)
        self.bytes_a = self.a.tokens
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # Text of an id and the mark after it, at 2 * id: within a tokenizer's half of a group, at its end.
        self.text_a = [f"{i}{mark}" for i in range(len(self.bytes_a)) for mark in ",|"]
        self.text_b = [f"{i}{mark}" for i in range(len(self.bytes_b)) for mark in ",;"]
        self.text_of = self.text_a + self.text_b

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [self.a.encode(t) for t in texts]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """Every text begins with a space, which B puts before it by itself."""
        return self.b.encode([t[1:] for t in texts], num_threads=1)

    def own_a(self, text: str, ids: list[int]) -> bool:
        """Whether the tokens' bytes are those of the text."""
        return b"".join(map(self.bytes_a.__getitem__, ids)) == text.encode()

    def own_b(self, text: str, ids: list[int]) -> bool:
        return b"".join(map(self.bytes_b.__getitem__, ids)) == text.encode()


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    """One for each pair of files and Python worker."""
    if (byte_path, piece_path) not in _loaded:
        _loaded[byte_path, piece_path] = Tokenizers(byte_path, piece_path)
    return _loaded[byte_path, piece_path]


# --- fragments


@dataclass
class Side:
    """Tokens of one tokenizer, end to end: the first one's begin, ids and ends."""

    begin: int
    ids: np.ndarray
    ends: np.ndarray

    def places(self) -> np.ndarray:
        return np.append(self.begin, self.ends)

    def cut(self, low: int, high: int) -> Side:
        """Tokens from one token end to another."""
        at = self.places()
        i, j = np.searchsorted(at, [low, high])
        return Side(low, self.ids[i:j], self.ends[i:j])

    def __add__(self, other: Side) -> Side:
        return Side(self.begin, np.append(self.ids, other.ids), np.append(self.ends, other.ends))


@dataclass
class Fragment:
    """A byte range's open prefix and suffix; undivided (no common end yet) if prefix is None.

    `closed` holds the stretches of closed groups, each a pair of sides over the same bytes."""

    prefix: tuple[Side, Side] | None
    suffix: tuple[Side, Side]
    closed: list[tuple[Side, Side]] = field(default_factory=list)


def divide(a: Side, b: Side) -> Fragment:
    """The fragment of two runs of tokens."""
    common = np.intersect1d(a.places(), b.places(), assume_unique=True)
    if not len(common):
        return Fragment(None, (a, b))
    low, high = int(common[0]), int(common[-1])
    closed = [(a.cut(low, high), b.cut(low, high))] if high > low else []
    prefix = a.cut(a.begin, low), b.cut(b.begin, low)
    return Fragment(prefix, (a.cut(high, int(a.places()[-1])), b.cut(high, int(b.places()[-1]))), closed)


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    inner = right.prefix or right.suffix
    middle = divide(left.suffix[0] + inner[0], left.suffix[1] + inner[1])
    closed = left.closed + middle.closed + right.closed
    if middle.prefix is None:  # neither was divided
        return Fragment(None, middle.suffix, closed)
    return Fragment(left.prefix or middle.prefix, right.suffix if right.prefix else middle.suffix, closed)


# --- closed groups


@dataclass
class Closed:
    """Measures of closed stretches, one entry each, the id pair of every link, and at which link
    each stretch begins."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    texts: list[str | None]
    pairs: np.ndarray
    first_link: np.ndarray
    digests: list[str] | None = None


def close(a: list[Side], b: list[Side], known: Tokenizers) -> Closed:
    """Groups and links of stretches, all in one go: each gets its own place on one line."""
    gaps = np.cumsum([0] + [(int(x.ends[-1]) - x.begin if len(x.ends) else 0) + 1 for x in a])
    shift = [g - x.begin for g, x in zip(gaps[:-1].tolist(), a, strict=True)]
    none = np.zeros(0, np.int64)
    ends_a = np.concatenate([none, *(x.ends + s for x, s in zip(a, shift, strict=True))])
    ends_b = np.concatenate([none, *(x.ends + s for x, s in zip(b, shift, strict=True))])
    ids_a, ids_b = np.concatenate([none, *(x.ids for x in a)]), np.concatenate([none, *(x.ids for x in b)])
    every = np.sort(np.append(ends_a, ends_b), kind="stable")  # two sorted runs
    twice = np.append(every[1:] == every[:-1], False)
    common = every[twice]
    # Between two neighbouring ends of either side lie one token of each: one link.
    every = every[~twice]
    pair = ids_a[np.searchsorted(ends_a, every)] << 20 | ids_b[np.searchsorted(ends_b, every)]
    # A group's tokens in order: all of A's, then all of B's.
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
    upto = np.append(0, np.cumsum(in_a + in_b))
    last_a, last_b = np.zeros(len(ends_a), np.int64), np.zeros(len(ends_b), np.int64)
    last_a[np.cumsum(in_a) - 1] = last_b[np.cumsum(in_b) - 1] = 1
    place_a = np.arange(len(ends_a)) + upto[group_a] - np.append(0, np.cumsum(in_a))[group_a]
    place_b = np.arange(len(ends_b)) + (upto[:-1] + in_a)[group_b] - np.append(0, np.cumsum(in_b))[group_b]
    code = np.empty(len(ends_a) + len(ends_b), np.int64)
    code[place_a] = 2 * ids_a + last_a
    code[place_b] = len(known.text_a) + 2 * ids_b + last_b
    group_at = np.searchsorted(common, gaps)  # the first group of each stretch
    text_at, table, codes = upto[group_at], known.text_of, code.tolist()
    texts = ["".join([table[c] for c in codes[low:high]])[:-1] for low, high in itertools.pairwise(text_at.tolist())]
    n_a, n_b = np.diff(np.searchsorted(ends_a, gaps)), np.diff(np.searchsorted(ends_b, gaps))
    return Closed(n_a, n_b, np.diff(group_at), texts, pair, np.searchsorted(every, gaps))


# --- Spark

_SIDES = ("prefix_a", "prefix_b", "suffix_a", "suffix_b")
_SCHEMA = (
    "kind string, slice string, row long, doc_id long, no long, place long, fits boolean, divided boolean, n_a long, n_b long, n_groups long, "
    "groups string, sha string, n_links long, links binary, pairs array<long>, counts array<long>, " + ", ".join(f"{x} array<long>" for x in _SIDES)
)


def _packed(x: Side) -> list[int]:
    """begin, then ids and ends in turn."""
    return [x.begin, *np.stack([x.ids, x.ends], 1).ravel().tolist()]


def _unpacked(x: list[int]) -> Side:
    both = np.array(x[1:], np.int64).reshape(-1, 2)
    return Side(x[0], both[:, 0], both[:, 1])


def _written(places: np.ndarray) -> bytes:
    """Places in order as steps from one to the next, all lowest bytes first: those above are mostly
    zeros, which compress."""
    steps = np.diff(np.sort(places), prepend=0).astype("<i4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _read(written: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(written, np.uint8).reshape(4, n).T
    return np.cumsum(np.ascontiguousarray(steps).view("<i4")[:, 0])


class _Rows:
    """Collects output rows of one task."""

    def __init__(self, schema: pa.Schema, tag: str):
        self.schema, self.rows, self.tag, self.slices = schema, [], tag, 0

    def add(self, **values) -> None:
        self.rows.append(values)

    def open(self, row: int, doc_id: int | None, no: int, found: Fragment, fits: bool) -> None:
        prefix = found.prefix or (Side(0, np.zeros(0, np.int64), np.zeros(0, np.int64)),) * 2
        sides = dict(zip(_SIDES, map(_packed, (*prefix, *found.suffix)), strict=True))
        self.add(kind="open", row=row, doc_id=doc_id, no=no, fits=fits, divided=found.prefix is not None, **sides)

    def closed(self, found: list[Closed], rows: list[int | None], doc_ids: list[int | None], places: list[int]) -> None:
        """Stretches as one slice: its pairs, and each stretch's links as places among them."""
        self.slices += 1
        name = f"{self.tag}-{self.slices}"
        pairs, links = np.unique(np.concatenate([x.pairs for x in found]), return_inverse=True)
        total = np.bincount(links, minlength=len(pairs)).astype(np.int64)
        self.add(kind="slice", slice=name, row=rows[0], pairs=pairs, counts=total)
        i = begin = 0
        for some in found:
            for k, text in enumerate(some.texts):
                own = links[begin + some.first_link[k] : begin + some.first_link[k + 1]]
                self.add(
                    kind="links", slice=name, row=rows[i], doc_id=doc_ids[i], place=places[i], fits=True, n_a=int(some.n_a[k]), n_b=int(some.n_b[k]),
                    n_groups=int(some.n_groups[k]), groups=text, sha=some.digests[k] if some.digests else None, n_links=len(own), links=_written(own),
                )
                i += 1
            begin += len(some.pairs)

    def batch(self) -> pa.RecordBatch:
        names, rows, self.rows = self.schema.names, self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r.get(x) for r in rows], self.schema.field(x).type) for x in names], schema=self.schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _ranges(raw: bytes, chunk_bytes: int) -> list[tuple[int, int]]:
    """Where A's and B's tokens of each byte range begin."""
    found = [(0, 0)]
    for low in range(chunk_bytes, len(raw), chunk_bytes):
        a, b = (x.start() if (x := safe.search(raw, low)) else len(raw) for safe in (SAFE_A, SAFE_B))
        found.append((a, b))
    return found


def _cut(chunk_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column("text")[i].as_py().encode()
                at = [*_ranges(raw, chunk_bytes), (len(raw), len(raw))]
                for no, ((a, b), (c, d)) in enumerate(itertools.pairwise(at)):
                    if c > a or d > b:
                        values = [batch.column("row")[i].as_py(), batch.column("doc_id")[i].as_py(), no, a, raw[a:c].decode(), b, raw[b:d].decode()]
                        names = ["row", "doc_id", "no", "from_a", "text_a", "from_b", "text_b"]
                        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    return cut


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    low = total = 0
    for i, n in enumerate(sizes):
        if i > low and total + n > most:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(sizes):
        yield low, len(sizes)


def _side(ids: list[int], size: np.ndarray, begin: int) -> Side:
    tokens = np.array(ids, np.int64)
    return Side(begin, tokens, begin + np.cumsum(size[tokens]))


def align(
    docs: DataFrame, byte_path: str, piece_path: str, *,
    chunk_bytes: int = 1 << 16, slice_bytes: int = 4 << 20, batch_bytes: int = 1 << 19, fan: int = 16, keep_groups: bool = False,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, where `keep_groups`
    asks for it, groups (the text `a1,a2|b1;a3|b2,b3`) of every document; texts over `chunk_bytes` are cut."""
    schema = _arrow(_SCHEMA)

    def tag(name: str) -> str:
        return f"{name}{TaskContext.get().partitionId()}"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of one range, many at a time."""
        known, out = tokenizers(byte_path, piece_path), _Rows(schema, tag("s"))
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            size = pc.add(pc.binary_length(texts), 1).to_pylist()
            for low, high in _slices(size, slice_bytes):
                found, pick = [], []
                for begin, end in _slices(size[low:high], batch_bytes):
                    some = [" " + t if t else "" for t in texts.slice(low + begin, end - begin).to_pylist()]
                    a, b = known.encode_a(some), known.encode_b(some)
                    good = [i for i, t in enumerate(some) if t and known.own_a(t, a[i]) and known.own_b(t, b[i])]
                    for i in set(range(end - begin)).difference(good):
                        out.add(kind="links", doc_id=ids[low + begin + i], place=0, fits=False)
                    if good:
                        sides = [[_side(x[i], of, 0) for i in good] for x, of in ((a, known.size_a), (b, known.size_b))]
                        found.append(close(*sides, known))
                        found[-1].digests = [hashlib.sha256(t.encode()).hexdigest() for t in found[-1].texts]
                        if not keep_groups:
                            found[-1].texts = [None] * len(good)
                        pick += [ids[low + begin + i] for i in good]
                if found:
                    out.closed(found, [None] * len(pick), pick, [0] * len(pick))
                yield out.batch()

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fragments of byte ranges of long texts."""
        known, out = tokenizers(byte_path, piece_path), _Rows(schema, tag("r"))
        for batch in batches:
            for r in batch.to_pylist():
                a, b = known.encode_a([r["text_a"]])[0], known.encode_b([r["text_b"]])[0]
                fits = known.own_a(r["text_a"], a) and known.own_b(r["text_b"], b)
                found = divide(_side(a, known.size_a, r["from_a"]), _side(b, known.size_b, r["from_b"]))
                send(out, known, r["row"], r["doc_id"], r["no"], found, fits)
                yield out.batch()

    def send(out: _Rows, known: Tokenizers, row: int, doc_id: int | None, no: int, found: Fragment, fits: bool) -> None:
        out.open(row, doc_id, no, found, fits)
        if found.closed:
            a, b = zip(*found.closed, strict=True)
            n = len(a)
            out.closed([close(list(a), list(b), known)], [row] * n, [doc_id] * n, [x.begin for x in a])

    def reduce(level: int) -> Callable[[tuple, pa.Table], pa.Table]:
        def one(key: tuple, rows: pa.Table) -> pa.Table:
            known = tokenizers(byte_path, piece_path)
            row, no = key[0].as_py(), key[1].as_py()
            out, parts, fits = _Rows(schema, f"{level}.{row}.{no}"), [], True
            for r in sorted(rows.to_pylist(), key=lambda r: r["no"]):
                sides = [_unpacked(r[x]) for x in _SIDES]
                parts.append(Fragment(tuple(sides[:2]) if r["divided"] else None, tuple(sides[2:])))
                fits, doc_id = fits and r["fits"], r["doc_id"]
            total = parts[0]
            if fits:
                for part in parts[1:]:
                    total = compose(total, part)
            send(out, known, row, doc_id, no, total, fits)
            return pa.Table.from_batches([out.batch()])

        return one

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    is_long = F.octet_length("text") >= chunk_bytes
    spoken = rows.where(is_long).select("row", "doc_id", F.concat(F.lit(" "), F.col("text")).alias("text"))
    pieces = spoken.mapInArrow(_cut(chunk_bytes), "row long, doc_id long, no long, from_a long, text_a string, from_b long, text_b string")
    short = rows.where(~is_long).select("doc_id", "text").mapInArrow(whole, _SCHEMA)
    long = pieces.repartition("row", "no").mapInArrow(ranges, _SCHEMA)
    made = staged(short.unionByName(long))
    levels, now = [made], made.where("kind = 'open'")
    most = now.agg(F.max("no")).first()[0] or 0
    while most > 0:
        most //= fan
        step = now.withColumn("above", F.expr(f"no DIV {fan}")).groupBy("row", "above").applyInArrow(reduce(len(levels)), _SCHEMA)
        levels.append(staged(step))
        now = levels[-1].where("kind = 'open'")

    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    slices, links = every.where("kind = 'slice'"), every.where("kind = 'links'")
    # A long text that does not fit anywhere has no tokens at all.
    wrong = made.where("kind = 'open' AND NOT fits").select("row").distinct()
    slices = slices.where("row IS NULL").unionByName(slices.where("row IS NOT NULL").join(wrong, "row", "left_anti").select(slices.columns))
    own = slices.select("slice", F.posexplode(F.arrays_zip("pairs", "counts")).alias("k", "x")).select("slice", "k", "x.pairs", "x.counts")
    totals = own.groupBy("pairs").agg(F.sum("counts").alias("total"))
    # At most as many rows as A has ids.
    totals = totals.withColumn("best", F.max("total").over(Window.partitionBy(F.col("pairs").bitwiseAND(F.lit((1 << 20) - 1)))) == F.col("total"))
    back = own.join(totals, "pairs").select("slice", "k", "total", "best")
    carried = ["row", "doc_id", "place", "n_a", "n_b", "n_groups", "groups", "sha"]
    placed = links.where("fits").select(F.col("slice").alias("of"), *(F.col(x).alias(x) for x in carried), "n_links", "links")
    answer = "row long, doc_id long, place long, n_a long, n_b long, n_groups long, groups string, sha string, n_links long, n_best long, count_sum long"

    def count(mine: pa.Table, totals: pa.Table) -> pa.Table:
        """Links of a slice's stretches, their totals looked up."""
        where = totals["k"].to_numpy()
        total, best = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        # A slice of a text that does not fit has no totals; its rows are left out below.
        total[where], best[where] = totals["total"].to_numpy(), totals["best"].to_numpy(zero_copy_only=False)
        sums = []
        for n, links in zip(mine["n_links"].to_pylist(), mine["links"].to_pylist(), strict=True):
            at = _read(links, n)
            sums.append((len(at), best[at].sum(), total[at].sum()) if len(where) else (0, 0, 0))
        sums = np.array(sums, np.int64).reshape(-1, 3)
        out = mine.select(carried)
        for i, name in enumerate(("n_links", "n_best", "count_sum")):
            out = out.append_column(name, pa.array(sums[:, i], pa.int64()))
        return out

    counted = placed.groupBy("of").cogroup(back.groupBy("slice")).applyInArrow(count, answer)
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    done = counted.where("row IS NULL").select("doc_id", *numbers, "groups", F.col("sha").alias("groups_sha256"))
    nothing = every.where("kind = 'links' AND NOT fits").select("doc_id")
    lost = made.where("kind = 'open'").join(wrong, "row", "left_semi").select("row", "doc_id").distinct().select("doc_id")
    empty = nothing.unionByName(lost).select("doc_id", *(F.lit(0).cast("long").alias(x) for x in numbers), F.lit("").alias("groups"), F.lit("").alias("groups_sha256"))
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "groups"))), lambda x: x["groups"]), ";")
    joined = counted.where("row IS NOT NULL").join(wrong, "row", "left_anti").groupBy("row", "doc_id")
    joined = joined.agg(*(F.sum(x).alias(x) for x in numbers), in_order.alias("groups")).drop("row")
    joined = joined.withColumn("groups_sha256", F.sha2("groups", 256))
    result = done.unionByName(empty).unionByName(joined)
    return result if keep_groups else result.drop("groups")
