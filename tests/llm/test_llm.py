"""Operators of tidebook.llm against brute force, on awkward rows and on planted cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm import ann, html_extract, langid, mixing, near_dup, packing, pii, pylm, quality, topk

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        T.StructField("start", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("node", T.StringType()),
    ]
)
SYLLABLES = {"en": ["the", "er", "th", "ing", "on", "re", "ou", "sh"], "de": ["sch", "ung", "ei", "ä", "ch", "ver", "tz", "ö"]}


def prose(rng, lang, n):
    words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w.capitalize() if i % 9 == 0 else w + "." if i % 9 == 8 else w for i, w in enumerate(words))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", "y", "z")


@pytest.fixture(scope="module")
def corpus():
    """Clean prose, then nulls, empties, repeats, ties, one very long text and odd white space."""
    rng = random.Random(4)
    rows = [row(i, prose(rng, "de" if i % 3 == 0 else "en", rng.randint(30, 120)), "de" if i % 3 == 0 else "en", f"s{i % 4}") for i in range(120)]
    long_ = prose(rng, "en", 9000)
    rows += [
        row(1000, None, None, None), row(1001, "", "en", "s1"), row(1002, " \t\n ", None, "s1"), row(None, prose(rng, "en", 50), "en", None),
        row(1003, long_, "en", "s0"), row(1004, "Short text", "en", "s2"), row(1004, "Short text", "en", "s2"), row(1005, "a\x1cb c d 12 3!", "en", "s2"),
        row(1006, "123 456", "en", "s3"), row(None, None, None, None),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# --- packing


def test_packing_round_trip(docs, corpus):
    rows = packing.pack(docs, TOKENIZER, group_docs=40).collect()
    tokenizer = packing.encoder(TOKENIZER).tokenizer
    want = sorted((str(r[0]), np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in corpus)
    whole = collections.defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 <= 4096
        whole[str(r.doc_id), r.doc_tokens, r.start // 4096].append(bytes(r.ids))
    total = sum(r.length for r in rows)
    assert total == sum(len(b) // 4 for _, b in want)
    single = {k: v for k, v in collections.Counter(i for i, _ in want).items() if v == 1}
    got = {i: b"".join(bytes(r.ids) for r in sorted((r for r in rows if str(r.doc_id) == i), key=lambda r: r.start)) for i in single}
    assert all(got[i] == b for i, b in want if i in single)
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(x)) and sum(n for _, n in x) <= 4096
    # only each group's last bins have room
    assert sum(4096 - sum(n for _, n in x) for x in places.values()) < 4096 * 2 * 5


def test_a_text_with_more_units_than_are_kept(monkeypatch):
    known, times = packing.UnitTokenizer(TOKENIZER, most=50), []
    forget = packing.UnitTokenizer.forget

    def counted(self):
        times.append(1)
        assert len(times) < 10, "forgets without end"
        forget(self)

    monkeypatch.setattr(packing.UnitTokenizer, "forget", counted)
    rng = random.Random(3)
    long_ = prose(rng, "en", 300)
    for texts in ([long_[:100]], [long_, long_[50:90]], [prose(rng, "de", 200) + " x1 €"], [long_[:60]]):
        ids, first = known.encode(*near_dup.flat(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(first)] == [x.tolist() for x in known.direct(texts)]


def test_first_fit_decreasing_is_first_fit():
    lengths = np.random.default_rng(1).integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room = []
    for i in np.argsort(-lengths, kind="stable"):
        b = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        room += [100] * (b == len(room))
        assert bins[i] == b and offsets[i] == 100 - room[b]
        room[b] -= lengths[i]


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, TOKENIZER).count() == 0


# --- mixing


def test_targets_share_what_is_above():
    got = mixing.targets([10, 1000, 1000, 0], 1.5, 2.0)
    assert got[0] == 20 and got[3] == 0 and sum(got) == pytest.approx(1.5 * 2010) and all(t <= 2 * s for t, s in zip(got, [10, 1000, 1000, 0]))


def test_permutation_is_one():
    for n in (1, 2, 7, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))) == list(range(n))


def test_mixing_sizes_targets_and_reruns(docs, corpus):
    how = {"block": 16, "shards": 8}
    rows = mixing.mix(docs, **how).collect()
    assert len(rows) == len(corpus)
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(r[0]), len(WORD.findall(r[1] or ""))) for r in corpus)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    for x in by_source.values():
        assert {r.source_size for r in x} == {sum(r.size for r in x)}
        assert abs(sum(r.taken for r in x) - x[0].target) <= max(0.06 * x[0].target, 120)
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mix(docs.repartition(5), **how).collect()))


def test_mixed_documents_hold_what_is_taken(docs):
    how = {"block": 16, "shards": 8}
    once = docs.dropDuplicates(["doc_id", "text"])
    want = {(r.doc_id, r.size): r.taken for r in mixing.mix(once, **how).where("taken > 0").collect()}
    rows = mixing.mixed_documents(docs, **how)
    assert rows.columns == docs.columns
    got = collections.Counter()
    texts = {r.doc_id: r.text for r in once.collect()}
    for r in rows.collect():
        n = len(WORD.findall(r.text))
        got[r.doc_id, len(WORD.findall(texts[r.doc_id] or ""))] += n
        assert r.n_chars == len(r.text)
    assert dict(got) == want


def test_mixing_of_nothing(nothing):
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


# --- personal data


LOOK = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, x):
    digits = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


PERSONAL = [
    "", None, "write to a.b@c.d.e@f.g or x@y@z.com, a@b..c a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.0003.255 1.2.3",
    "4065474184847466 4065-4741-8484-7466 4065474184847467 é 4111 1111 1111 1111 1", "+1 (688) 555-0921. +49 30 1234567 +12 +1--------9 +1234567890123456",
    "ééé a@b.cc ñ +1 (688) 555-0921 ñ a@b.cc", "a" * 50_000 + "@", "1" * 50_000, "+" + "1 " * 20_000, "x@" + "a." * 20_000 + "b", "😀 10.0.0.1 😀 a@b.co",
]


def test_base_spans_match_brute_force(spark):
    frame = spark.createDataFrame([row(i, t) for i, t in enumerate(PERSONAL)] + [row(2, PERSONAL[2])], DOCS)
    rows = pii.find(frame).select("doc_id", pii.listed(F.col("base")).alias("spans"), "extra").collect()
    assert len(rows) == len(PERSONAL) + 1
    for r in rows:
        want = [f"{k}:{m.start()}:{m.end()}" for k, x in LOOK.items() for m in re.finditer(x, PERSONAL[r.doc_id] or "") if passes(k, m[0])]
        assert r.spans == ",".join(want), PERSONAL[r.doc_id][:60]
        assert r.extra == []


def test_contexts_reveal_unseen_identifiers(spark):
    seeds = [f"please reach account-mail user{i}@host{i}.example.org immediately thanks" for i in range(12)]
    unseen = ["please reach account-mail user99(at)host immediately thanks", "the order 77(at)8 came late"]
    frame = spark.createDataFrame([row(i, t) for i, t in enumerate(seeds + unseen)], DOCS)
    rows = {r.doc_id: r for r in pii.find(frame).select("doc_id", "extra", pii.listed(F.concat("base", "extra")).alias("spans")).collect()}
    start = unseen[0].index("user99")
    assert rows[12].spans == f"email:{start}:{start + len('user99(at)host')}" and rows[13].extra == []
    masked = {r.doc_id: r.text for r in pii.masked_documents(frame).collect()}
    assert masked[0] == "please reach account-mail <EMAIL> immediately thanks" == masked[12] and masked[13] == unseen[1]


def test_masking_keeps_rows_and_columns(spark):
    frame = spark.createDataFrame([row(i, t) for i, t in enumerate(PERSONAL)], DOCS)
    out = pii.masked_documents(frame)
    assert out.columns == frame.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text is None and rows[0].text == "" and rows[11].text == "😀 <IP> 😀 <EMAIL>" and rows[11].n_chars == len(rows[11].text)
    assert not any(passes(k, m[0]) for r in rows.values() for k in ("email", "ip") for m in re.finditer(LOOK[k], r.text or ""))


def test_pii_is_native_and_takes_nothing(nothing):
    assert pii.find(nothing).count() == 0 and pii.masked_documents(nothing).count() == 0
    assert "Python" not in pii.find(nothing)._jdf.queryExecution().toString()


def test_quality_looks_at_slices_of_a_batch(monkeypatch):
    """A batch of many texts is not unfolded at once; a longer text is one slice."""
    texts = [prose(random.Random(i), "en", 100) for i in range(1500)] + ["word " * 100_000, None, ""]
    fitted = quality.Fitted(np.arange(3.0**8), np.linspace(-1, 1, quality.BUCKETS + 1))
    seen, look = [], quality.look
    monkeypatch.setattr(quality, "look", lambda data, at: seen.append((len(data), len(at) - 1)) or look(data, at))
    weak, scores = fitted.judge(pa.array(texts))
    assert max(n for n, rows in seen if rows > 1) <= 500_000 and sum(rows for _, rows in seen) == len(texts)
    for i in (0, 700, 1499, 1500, 1501):
        one = fitted.judge(pa.array([texts[i]], pa.string()))
        assert weak[i] == one[0][0] and math.isclose(scores[i], one[1][0])


# --- near duplicates


def five(text):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def copies():
    """A large group of near copies in a chain, exact copies, a passage that many texts share."""
    rng = random.Random(8)
    words = prose(rng, "en", 200).split()
    rows, current = [], list(words)
    for i in range(12):
        rows.append(row(i, " ".join(current)))
        current[rng.randrange(200)] = f"new{i}"
    rows += [row(100 + i, " ".join(words).upper()) for i in range(5)]
    passage = prose(rng, "de", 40)
    rows += [row(200 + i, prose(rng, "en", 60) + " " + passage) for i in range(25)]
    rows += [row(300, "one two three four five six"), row(301, "one two three four five six"), row(302, "one two"), row(303, "One\ttwo"), row(304, "one three")]
    rows += [row(400, ""), row(401, None), row(402, " "), row(None, "one two"), row(300, "one two three four five six")]
    return rows


@pytest.mark.parametrize("large", [2, 8])
def test_near_duplicates_match_brute_force(spark, copies, large):
    found = near_dup.classes(spark.createDataFrame(copies, DOCS), large=large).collect()
    assert len(found) == len(copies)
    texts = {r[0]: five(r[1]) for r in copies if r[0] is not None}
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(texts, 2):
        if texts[a] and len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b]):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    assert {(r.doc_id, r.class_id) for r in found if r.doc_id is not None} == {(i, top(i)) for i in texts}
    assert [r.class_id for r in found if r.doc_id is None] == [302]
    sizes = collections.Counter(r.class_node for r in found if r.node)
    assert all(r.class_docs == (sizes[r.class_node] if r.node else 1) for r in found)


@pytest.mark.parametrize("seed", [29, 53, 54])
def test_texts_settled_by_different_leaders_meet(spark, seed):
    """A and B are alike, L like A only and thirty copies like B only; every one of them may lead first."""
    words = [f"w{k}" for k in range(130)]
    texts = {"l": " ".join(words[:100]), "a": " ".join(words[10:110]), "b": " ".join(words[20:120])}
    texts |= {f"c{i:02}": " ".join([*words[30:125], f"own{i}", f"more{i}", "x", "y", f"z{i}"]) for i in range(30)}
    runs = {i: five(x) for i, x in texts.items()}
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(texts, 2):
        if len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    assert len({top(i) for i in texts}) == 1
    members = spark.createDataFrame([(0, 7, i) for i in texts], "band int, key long, node string")
    frame = spark.createDataFrame(list(texts.items()), "node string, text string")
    got = {r.node: r["class"] for r in near_dup.connected(members, frame, np.ones(64, np.float32), 0.8, seed, 8).collect()}
    assert {i: got.get(i, i) for i in texts} == {i: "a" for i in texts}


def test_differing_bits_are_at_most_the_runs_apart(spark):
    """Texts of other lengths, so that bitmaps are folded or cannot be compared."""
    rng = random.Random(31)
    texts = [prose(rng, "en", n) for n in (3, 200, 258, 262, 300, 520, 540, 2400)]
    texts += [" ".join([*t.split()[: k + 1], "other", *t.split()[k + 2 :]]) for t in texts[1:] for k in (1, 50, 120)]
    data, at = near_dup.flat(pa.array(texts))
    found, whose, _, _ = near_dup.runs(data, at)
    bits = near_dup.run_bits(found, whose, len(texts)).to_pylist()
    assert len({len(x) for x in bits}) > 2
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(bits)], "i int, bits array<long>")
    other = frame.select(F.col("i").alias("j"), F.col("bits").alias("r_bits"))
    got = {(r.i, r.j): r.d for r in frame.crossJoin(other).select("i", "j", near_dup.apart_at_least(F.col("bits"), F.col("r_bits")).alias("d")).collect()}
    runs = [five(t) for t in texts]
    assert all(d <= len(runs[i] ^ runs[j]) for (i, j), d in got.items()) and all(got[i, i] == 0 for i in range(len(texts)))
    near = [(i, 8 + 3 * (i - 1) + k) for i in range(1, 8) for k in range(3)]
    assert all(got[p] >= 0.6 * len(runs[p[0]] ^ runs[p[1]]) > 0 for p in near)


def test_near_copies_just_unlike_are_not_all_compared(spark, monkeypatch):
    """Each text shares most runs with the group, but no two of them are alike."""
    rng = random.Random(32)
    base = prose(rng, "en", 200).split()
    texts = {}
    for i in range(60):
        current = list(base)
        for k in range(4):
            current[10 + 45 * k + rng.randrange(40)] = f"own{i}x{k}"
        texts[f"{i:02}"] = " ".join(current)
    runs = {i: five(x) for i, x in texts.items()}
    alike = [p for p in itertools.combinations(texts, 2) if len(runs[p[0]] & runs[p[1]]) >= 0.8 * len(runs[p[0]] | runs[p[1]])]
    compared, verified = [], near_dup.verified
    monkeypatch.setattr(near_dup, "verified", lambda pairs, *how: compared.append(pairs.count()) or verified(pairs, *how))
    members = spark.createDataFrame([(0, 7, i) for i in texts], "band int, key long, node string")
    frame = spark.createDataFrame(list(texts.items()), "node string, text string")
    got = {r.node: r["class"] for r in near_dup.connected(members, frame, np.ones(64, np.float32), 0.8, 29, 8).collect()}
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in alike:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert {i: got.get(i, i) for i in texts} == {i: top(i) for i in texts}
    assert sum(compared) < 59 + 3 * len(alike) + 100


def test_large_bucket_of_unlike_leaders(spark):
    """Chains of texts, each like its neighbours only, all in one bucket."""
    rng = random.Random(12)
    texts = {}
    for chain in range(12):
        current = [f"c{chain}w{k}" for k in range(100)]
        for i in range(40):
            texts[f"{chain:02}-{i:02}"] = " ".join(current)
            at = rng.randrange(10, 40)
            current[at], current[at + 30] = f"c{chain}x{i}", f"c{chain}y{i}"
    runs = {i: five(x) for i, x in texts.items()}
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(texts, 2):
        if len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    members = spark.createDataFrame([(0, 7, i) for i in texts], "band int, key long, node string")
    frame = spark.createDataFrame(list(texts.items()), "node string, text string")
    got = {r.node: r["class"] for r in near_dup.connected(members, frame, np.ones(64, np.float32), 0.8, 29, 8).collect()}
    assert {i: got.get(i, i) for i in texts} == {i: top(i) for i in texts} and len(set(got.values())) < 40


def test_one_of_each_class_stays(spark, copies):
    frame = spark.createDataFrame(copies, DOCS)
    out = near_dup.one_of_each(frame)
    assert out.columns == frame.columns
    kept = collections.Counter(r.doc_id for r in out.collect())
    assert max(kept.values()) == 1 and {300, 302, 304, 400, 401, 402} <= set(kept) and not {301, 303, 101, None} & set(kept)
    assert sum(200 <= i < 300 for i in kept) == 25 and sum(i < 12 for i in kept) == 1


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    found = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    one, two = rng.uniform(0.5, 3, 200), rng.uniform(0.5, 3, 200)
    shared = 100
    draw = near_dup.Sampler(1500, 1).draws(np.concatenate([found[:200], found[100:300]]), np.array([0, 200]), np.log(np.concatenate([one, two])))
    least = np.minimum(one[shared:], two[:shared]).sum()
    assert abs((draw[:, 0] == draw[:, 1]).mean() - least / (one.sum() + two.sum() - least)) < 0.04


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("a", "b")], "a string, b string")
    got = {r.node: r["class"] for r in near_dup.components(links).collect()}
    assert all(got[f"{i:03d}"] == "000" for i in range(1, 61)) and got["b"] == "a"


def test_near_duplicates_of_nothing(nothing):
    assert near_dup.classes(nothing).count() == 0 and near_dup.one_of_each(nothing).count() == 0


# --- quality


@pytest.fixture(scope="module")
def mixed_quality():
    rng = random.Random(9)
    good = [row(i, prose(rng, "en" if i % 2 else "de", rng.randint(60, 200))) for i in range(160)]
    bad = []
    for i in range(40):
        text = prose(rng, "en", 80)
        words = text.split()
        kind = i % 4
        bad.append(row(1000 + i, [" ".join(w.upper() + "!!" for w in words), " ".join(w for w in words for _ in range(12)), " ".join(w + "%%%" for w in words), " | ".join(words)][kind]))
    return good + bad + [row(5000, None), row(5001, ""), row(5002, " \n"), row(None, prose(rng, "en", 80)), row(1, good[1][1])]


def test_quality_finds_planted_junk(spark, mixed_quality):
    frame = spark.createDataFrame(mixed_quality, DOCS)
    rows = quality.rate(frame).collect()
    assert len(rows) == len(mixed_quality)
    kept = {r.doc_id: r.keep for r in rows}
    assert all(kept[i] for i in range(160)) and kept[None] and not any(kept[1000 + i] for i in range(40))
    assert not kept[5000] and not kept[5001] and not kept[5002] and all(0 <= r.score <= 1 for r in rows)
    out = quality.kept_documents(frame)
    assert out.columns == frame.columns and out.count() == sum(r.keep for r in rows)


def test_quality_of_nothing(nothing):
    assert quality.rate(nothing).count() == 0 and quality.kept_documents(nothing).count() == 0


def test_accuracies_by_plain_estimation():
    """Three labellers of known accuracy over drawn votes."""
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.8] + [0.85] * 5)
    votes = np.where(rng.random((20_000, 8)) < right, 1, -1) * np.where(good, 1, -1)[:, None]
    counts = np.bincount(quality.pattern_of(votes), minlength=3**8)
    _, chance, share = quality.accuracies(counts)
    assert abs(share - 0.8) < 0.02 and np.abs(chance[1, :, 2] - right).max() < 0.03 and np.abs(chance[0, :, 0] - right).max() < 0.03


# --- pages


PAGE = """<!DOCTYPE html><html><head><title>T{0}</title><style>p{{}}</style></head><body><nav><ul><li><a>Home</a></ul></nav>
<div class="ad">Buy {0}</div>{1}<footer>&copy; site</footer><script>var t="</p>";</script></body>"""


def test_extracts_the_article(spark):
    article = "<article><h1>Head &amp; {0}</h1><p><b>One{0} <i>t</i>wo<br><p>x &lt; y  z<p></article>"
    pages = [(i, f"http://h.org/{i}", PAGE.format(i, article.format(i)), "x") for i in range(6)]
    pages += [(10, None, None, "x"), (11, "http://h.org/e", "", "x"), (12, "https://other.org", "<p>plain<p title='a>b'>text</p>", "x"), (0, "http://h.org/0", pages[0][2], "x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, template string")
    got = {r.page_id: r.text for r in html_extract.main_text(frame).collect()}
    assert html_extract.main_text(frame).count() == len(pages)
    assert all(got[i] == f"Head & {i}\n\nOne{i} two\n\nx < y z" for i in range(6)) and got[10] == got[11] == "" and got[12] == "plain\n\ntext"
    assert html_extract.main_text(frame.limit(0)).count() == 0


def test_wrapper_takes_away_what_pages_share(spark):
    """No telling tags or classes: the template is what does not change between a host's pages."""
    rng = random.Random(1)
    body = "<div class=q1><div class=q2>Our great site</div><div class=q3><p>{}</p><p>{}</p></div><div class=q4>All rights kept</div></div>"
    texts = [(prose(rng, "en", 20), prose(rng, "en", 30)) for _ in range(8)]
    frame = spark.createDataFrame([(i, "http://w.org/x", body.format(*t)) for i, t in enumerate(texts)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(frame).collect()}
    assert all(got[i] == "\n\n".join(t) for i, t in enumerate(texts))


def test_wrapper_comes_from_all_pages_of_a_host(spark):
    """A line that only the first dozen of forty pages share is no template."""
    rng = random.Random(2)
    numbered = spark.range(40).select(F.col("id").alias("page_id")).orderBy(F.xxhash64("page_id")).collect()
    body = "<div class=q1><div class=q2>Our great site</div><div class=q3><p>{}</p></div><div class=q4>{}</div></div>"
    lines = {r.page_id: "All rights kept" if k < 12 else prose(rng, "en", 6) for k, r in enumerate(numbered)}
    texts = {i: prose(rng, "en", 25) for i in lines}
    frame = spark.createDataFrame([(i, "http://w.org/x", body.format(texts[i], lines[i])) for i in lines], "page_id long, url string, html string")
    for most in (16_000_000, 0):  # with broadcast joins and without
        got = {r.page_id: r.text for r in html_extract.main_text(frame, broadcast_bytes=most).collect()}
        assert got == {i: f"{texts[i]}\n\n{lines[i]}" for i in lines}


def test_same_ends_of_children_are_partners():
    first, other = (html_extract.signed(html_extract.parse(f"<div><p>a</p>{x}<ul><li>n</ul></div>")) for x in ("<p>b</p>", "<p>b</p><h2>c</h2><p>d</p>"))
    n, pairs = html_extract.matched(first, other, "", 24)
    assert n == 6 and [(a.label, html_extract.text_of(b)) for a, b, _ in pairs if a.label in ("p", "li")] == [("p", "a"), ("p", "b"), ("li", "n")]


def test_reader_comments_notices_and_forms_go():
    page = (
        '<body class="has-sidebar"><div id="cookie-notice">We use</div><main><article><header><h1>T</h1></header><p>a<b>b</b></p>'
        '<div class="comments"><article>reader</article></div><form>f</form><aside>s</aside><p>c</p></article></main></body>'
    )
    assert html_extract.extract(page, frozenset(), frozenset()) == "T\n\nab\n\nc"
    deep = "<div>" * 3000 + "x"
    assert html_extract.extract(deep, frozenset(), frozenset()) == "x" and html_extract.induce([deep, deep])


def test_values_of_attributes_are_not_names():
    page = (
        '<body><nav>n</nav><article style="overflow: hidden" data-x=\'a class="ad"\'><h1>T</h1><p title="a hidden valley">a</p><p data-a="x" style=\'visibility: hidden\'>b</p>'
        '<p data-note="role=search id=comments">c</p><p HIDDEN>gone</p><p class="x" hidden="">gone</p><p aria-hidden = "true">gone</p><p aria-hidden="false"/ class=ad>gone</p></article></body>'
    )
    assert html_extract.extract(page, frozenset(), frozenset()) == "T\n\na\n\nb\n\nc"


def test_names_of_an_article_are_not_marks():
    def text(page):
        return html_extract.extract(page, frozenset(), frozenset())

    for name in ('class="post category-social tag-search"', 'class="ad-free"', 'id="discussion"', 'class="header"', 'role="search"'):
        assert text(f"<body><nav>n</nav><article {name}><h1>T</h1><p>a</p></article></body>") == "T\n\na"
    page = (
        '<article><h2 id="discussion">D</h2><p>a</p><section id="login"><p>b</p></section><div class="post-header"><p>c</p></div><div class="ad">x</div>'
        '<div class="social-share">x</div><div id="comments"><p>x</p></div></article><div id="cookie-notice">x</div>'
    )
    assert text(page) == "D\n\na\n\nb\n\nc"
    assert text(f'<h2 id="login">T</h2><p>{"a " * 9}</p><div class="sidebar-box"><p>x</p></div>') == "T\n\n" + "a " * 8 + "a"
    # Most of the paragraphs: content whatever the name, unless readers wrote it.
    assert text(f'<div class="widget"><p>{"a " * 9}</p></div><p>b</p>') == "a " * 8 + "a\n\nb"
    for name in ("comments", "cookie-consent", "ad"):
        assert text(f'<div class="{name}"><p>{"a " * 9}</p></div><p>b</p>') == "b"
    assert text('<article><p>a b c</p></article><article class="comment"><p>x y</p></article><article class="comment"><p>x y</p></article>') == "a b c"


def test_small_articles_beside_the_text():
    long_, teaser = "<p>" + "long text " * 20 + "</p>", "<article><p>teaser</p></article>"
    for page in (f"<main>{long_}{teaser}{teaser}</main>", f"<div>{long_}</div>{teaser}{teaser}", f"<main>{long_}</main>{teaser}"):
        assert html_extract.extract(page, frozenset(), frozenset()).startswith(("long text " * 20).strip())
    many = "".join(f"<article><p>teaser {i}</p></article>" for i in range(6))
    assert html_extract.extract(f"<main>{many}</main>", frozenset(), frozenset()).count("teaser") == 6
    one = f"<main><p>by me</p><article>{long_}</article>{teaser}</main>"
    assert html_extract.extract(one, frozenset(), frozenset()) == ("long text " * 20).strip()


# --- vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(700, 12)) / 3.5
    v[100:160] = v[100]  # many copies
    rows = [(i, [float(np.float32(x)) for x in r], 1) for i, r in enumerate(v)]
    odd = [(900, None, 1), (1000, [1.0, None] * 6, 1), (1100, [float("nan")] * 12, 1), (1200, [0.0] * 12, 1), (None, rows[5][1], 1), (1300, [float("inf")] * 12, 1), (1400, [], 1)]
    frame = spark.createDataFrame(rows + odd, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.IntegerType())]))
    return frame, {i: np.array(r) for i, r, _ in rows}


def test_top_k_is_exact(vectors):
    frame, v = vectors
    v = {i: np.floor(1024 * x).astype(int) for i, x in v.items()} | {1200: np.zeros(12, int)}
    got = topk.top_k(frame, F.col("vec_id") % 100 == 0, shard_rows=200, block_queries=3).collect()
    want = set()
    for q in [i for i in v if i % 100 == 0]:
        best = sorted((-int(x @ v[q]), i) for i, x in v.items() if i != q)[:10]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want


def test_few_and_no_vectors(vectors):
    frame, _ = vectors
    some = frame.where("vec_id IN (0, 1, 2)")
    assert topk.top_k(some, F.col("vec_id") % 100 == 0).count() == 2 and ann.nearest(some, F.col("vec_id") % 50 == 0).count() == 2
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0 and ann.nearest(frame.limit(0), F.lit(True)).count() == 0


def test_neighbours_recall_and_scores(vectors):
    frame, v = vectors
    got = ann.nearest(frame, F.col("vec_id") % 50 == 0, shard_rows=300).collect()
    hit = 0
    for q in [i for i in v if i % 50 == 0]:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        score = {i: float(x @ v[q] / math.sqrt(x @ x) / math.sqrt(v[q] @ v[q])) for i, x in v.items() if i != q}
        best = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        assert len(mine) == 5 and all(abs(r.score - score[r.vec_id]) < 1e-12 for r in mine)
        assert [(-round(r.score, 12), r.vec_id) for r in mine] == sorted((-round(r.score, 12), r.vec_id) for r in mine)
        hit += len(set(best) & {r.vec_id for r in mine})
    assert hit >= 0.95 * 5 * 14


# --- language model


def digit(n):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(0))


def test_language_model_base_and_score(docs, corpus):
    rows = pylm.score(docs, digit(10) == 0).collect()
    assert len(rows) == len(corpus)
    tokens = [(r[0], [*WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), r[1] or "")), None]) for r in corpus]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    count = collections.Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), len(t), sum(count[w] > 0 for w in t), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for i, t in tokens)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert all(r.held_out == held(r.doc_id) and r.train_tokens == n and r.score < 0 for r in rows)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_contexts_come_from_all_training_text(spark):
    """A word that is frequent only far into a text is a context, and classes are those of all documents."""
    rng = random.Random(4)
    kinds = [[f"{c}{k}" for k in range(40)] for c in "abcdefgh"]
    texts = [" ".join(rng.choice(kinds[i % 8]) for _ in range(60)) for i in range(160)]
    texts.append(" ".join(["filler"] * 1500 + ["far"] * 3000))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("train", F.lit(True))
    one, two = (pylm.learn_contexts(docs, F.col("train"), 7) for _ in range(2))
    word = pylm.tokens_of(np.frombuffer(b"far", np.uint8), np.array([0, 3]), None).hashes[0]
    assert word in one.frequent and len(one.frequent) == pylm.FREQUENT - 1
    assert np.array_equal(one.class_words, two.class_words) and np.allclose(np.exp(one.class_words).sum(0), 1, atol=1e-3)
    data, at = np.frombuffer("".join(texts[:160]).encode(), np.uint8), np.cumsum([0, *map(len, texts[:160])])
    found = pylm.tokens_of(data, at, one)
    kind = found.context[found.hashes == pylm.END] // pylm.FREQUENT
    assert all(len(set(kind[c::8])) == 1 for c in range(8)) and len(set(kind)) >= 4
    assert pylm.learn_contexts(docs.limit(0), F.col("train"), 7) is None


def test_every_word_before_is_a_context(spark):
    """Words that always follow one word, none of the most frequent, are likelier after it than after others."""
    rng = random.Random(6)
    pairs = [f"left{i} right{i}" for i in range(120)]
    texts = [" ".join(rng.choice(pairs) for _ in range(30)) for _ in range(120)] + ["left3 right3 left4 right4", "left3 right4 left4 right3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in pylm.score(docs, F.col("doc_id") >= 120, range_bytes=5000, part_bytes=7000).collect()}
    assert len(got) == len(texts) and abs(got[120].base_score - got[121].base_score) < 1e-9 and got[120].n_known == got[121].n_known == 5
    assert got[120].score > got[121].score + 2


def test_classes_count_null_texts_as_empty(spark):
    texts = ["a b c d"] * 5 + ["e f g h"] * 7
    one, two = (
        pylm.learn_contexts(spark.createDataFrame([(t, True) for t in [*texts, *[x] * 9]], "text string, train boolean"), F.col("train"), 7) for x in (None, "")
    )
    assert np.array_equal(one.class_share, two.class_share) and np.array_equal(one.class_words, two.class_words)


def test_one_sort_gives_pairs_in_order():
    """Also where hashes share all bits that the sort looks at."""
    rng = np.random.default_rng(3)
    for low in (0, 1 << 62):
        major, minor = (rng.integers(0, 9, 500).astype(np.uint64) * np.uint64(1 << 60) + np.uint64(low) // np.uint64(1 << 58) * rng.integers(0, 3, 500).astype(np.uint64) for _ in range(2))
        a, b, (n,), token, back = pylm.by_before(major, minor, np.ones(500, np.int64))
        want = collections.Counter(zip(major.tolist(), minor.tolist(), strict=True))
        assert list(zip(a.tolist(), b.tolist(), n.tolist(), strict=True)) == [(*k, want[k]) for k in sorted(want)]
        assert np.array_equal(a[back], major) and np.array_equal(b[back], minor) and np.array_equal(major[token], a)


def test_language_model_sums_to_one():
    """Predictive probabilities of one restaurant's words and of all spellings."""
    counts = np.random.default_rng(0).poisson(0.001, pylm.LETTERS**4)
    s = pylm.Spelling.learn(counts, np.ones(257), 1)
    p = s.letter.reshape(-1, pylm.LETTERS)
    assert np.abs(p[:, : pylm.LETTERS].sum(1) - (pylm.LETTERS / (pylm.LETTERS - 1))).max() < 0.05


def test_seats_follow_the_restaurant():
    rng = np.random.default_rng(1)
    n = np.full(20_000, 3)
    t = pylm.seats(n, np.full(20_000, 0.5), np.full(20_000, 0.5), np.full(20_000, 1.0), rng)
    second = 0.5 / (1 - 0.5 + 0.5)
    assert abs((t >= 2).mean() - (second + (1 - second) * 0.5 / (2 - 0.5 + 0.5))) < 0.02 and t.min() == 1 and t.max() == 3


def test_language_model_without_training_rows(docs, nothing):
    rows = pylm.score(docs.limit(3), F.lit(True)).collect()
    assert len(rows) == 3 and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == pytest.approx(0) and r.score < 0 for r in rows)
    assert pylm.score(nothing, F.lit(False)).count() == 0


# --- language identification


def test_languages_of_held_out_documents(docs, corpus):
    rows = langid.identify(docs, digit(4) != 2, steps=150).collect()
    assert len(rows) == len(corpus)
    lang = {r[0]: r[2] for r in corpus}
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 120 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 15 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    none = {r.doc_id: r for r in rows if r.doc_id in (1000, 1001, 1002, 1006)}
    assert all(r.lang_pred == "und" and r.score == 0 for r in none.values())


def test_backpropagation_matches_differences():
    net = langid.ByteNetwork(["a", "b"], 5, 1)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    windows, target = rng.integers(1, 30, (6, 12)), np.array([0, 1, 0, 1, 1, 0])
    windows[2, 7:] = 0
    _, g = net.gradients(windows, target)
    for k, v in net.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        keep, out = v[at], []
        for step in (1e-3, -1e-3):
            v[at] = keep + step
            out.append(net.gradients(windows, target)[0])
        v[at] = keep
        assert (out[0] - out[1]) / 2e-3 == pytest.approx(g[k][at], rel=2e-2, abs=1e-5)


def test_no_labels_to_learn_from(docs, nothing):
    rows = langid.identify(docs.limit(2), F.lit(False)).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)] * 2
    assert langid.identify(nothing, F.lit(True)).count() == 0


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [row(i, prose(rng, "en", 150), "en", f"s{i % 3}") for i in range(90)]
    rows += [row(200 + i, rows[i][1], "en", "s0") for i in range(10)]
    rows += [row(300 + i, " ".join(w.upper() + "!!" for w in prose(rng, "en", 90).split()), "en", "s1") for i in range(12)]
    rows += [row(400, "mail me at a.b@example.org now " + prose(rng, "en", 80), "en", "s2")]
    spark.createDataFrame([r[:5] for r in rows], plain).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == before.columns
    ids = lambda name: sorted(r.doc_id for r in seen[name])
    assert ids("quality") == [*range(90), *range(200, 210), 400]
    assert ids("near_dup") == [*range(90), 400] == ids("pii")
    assert next(r.text for r in seen["pii"] if r.doc_id == 400).startswith("mail me at <EMAIL> now ")
    words = lambda name: sum(len(WORD.findall(r.text)) for r in seen[name])
    assert abs(words("mixing") - 1.5 * words("pii")) < 0.05 * words("pii") and set(ids("mixing")) <= set(ids("pii"))
    tokenizer = packing.encoder(TOKENIZER).tokenizer
    assert sum(r.length for r in seen["packing"]) == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_digest_of_no_spans(spark):
    frame = spark.createDataFrame([row(1, "nothing here")], DOCS)
    got = pii.find(frame).select(F.sha2(pii.listed(F.col("base")), 256).alias("d")).first().d
    assert got == hashlib.sha256(b"").hexdigest()
