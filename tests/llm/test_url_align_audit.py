"""URL verdicts, token alignment and the filter audit against brute force and on awkward rows."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidebook.llm import align, filter_audit, url_filter
from tidebook.llm.queries import URL_RULES

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
OWN = Tokenizer.from_file(BYTE)
OWN.encode_special_tokens = True
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# --- URL filter

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType()), T.StructField("block", T.StringType())])


def brute_verdict(url, listed):
    parts = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), parts[1]), parts[2]) if parts else ("", "")
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    key = brute_key(url)
    return host, path, best.text if best else None, best.verdict if best else ("block" if key is not None and key in listed else "allow")


def brute_key(url):
    parts = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
    if not parts:
        return None
    host = re.sub("[A-Z]", lambda m: m[0].lower(), parts[1]).split("@")[-1]
    host = re.sub(r"^www\.", "", re.sub(r"\.?(:80|:443)?$", "", host, count=1))
    path = re.sub("/$", "", re.sub("/+", "/", parts[2]))
    params = sorted(p for p in (parts[3] or "").split("&") if p and not re.match(r"(utm_[^=]*|gclid|fbclid|msclkid|ref)(=|$)", p))
    return host + path + ("?" + "&".join(params) if params else "")


def urls():
    rng = random.Random(5)
    hosts = ["example.com", "www.example.com", "a.www.EXAMPLE.com", "badexample.com", "x.net", "net", "spam.org", "www.spam.org", "u@spam.org:80", "com", "é.org"]
    paths = ["", "/", "/en/1", "/en", "/es/a", "/fr//b/", "/es", "//en/", "/de/x"]
    tails = ["", "?utm_source=a", "?b=2&a=1", "?a=1&b=2&ref=z#top", "#top", "?"]
    found = [f"{rng.choice(['http', 'HTTPS'])}://{h}{p}{t}" for h in hosts for p in paths for t in tails]
    return found + [None, "", "no scheme", "://", "http://", "a://b://c/es/", "http://x.net/es/\nline"]


def test_url_verdicts_are_those_of_brute_force(spark):
    found = urls()
    listed = ["http://www.spam.org/de/x", "https://spam.org/en/1/?a=1&b=2", None, "nothing", "http://SPAM.org", "http://spam.org/de/x#f"]
    rows = [(i, u, "clash", "clash") for i, u in enumerate(found)] + [(0, found[0], "clash", None), (None, "http://spam.org", None, None)]
    names = spark.createDataFrame([(u,) for u in listed], "url string")
    keys = {brute_key(u) for u in listed} - {None}
    want = sorted((str(i), *map(str, brute_verdict(u, keys))) for i, u, _, _ in rows)
    for most_broadcast in (64 << 20, 0):
        got = url_filter.judge(spark.createDataFrame(rows, PAGES), URL_RULES, names, most_broadcast=most_broadcast)
        assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got.collect()) == want
    assert sum(w[-1] == "block" and w[3] == "None" for w in want) > 20


def test_bloom_filter_passes_every_listed_url_and_few_others(spark):
    listed = spark.range(20_000).selectExpr("concat('http://h', id, '.org/p') AS url")
    pages = spark.range(40_000).selectExpr("id AS page_id", "concat('https://www.h', id, '.org/p/?utm_source=x') AS url")
    rows = url_filter.judge(pages, (), listed).selectExpr("possible", "listed", "page_id < 20000 AS should").collect()
    assert all(r.possible and r.listed for r in rows if r.should) and not any(r.listed for r in rows if not r.should)
    assert 0 < sum(r.possible for r in rows if not r.should) < 800


def test_url_filter_on_empty_tables(spark):
    pages, none = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), spark.createDataFrame([], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(pages, URL_RULES, none).collect()] == ["allow"]
    assert url_filter.judge(none, URL_RULES, pages).count() == 0


def test_url_filter_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = url_filter.judge(pages, URL_RULES, pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- alignment


def brute_alignment(texts):
    """Per text (n_a, n_b, groups, links), and corpus counts of linked pairs; None without tokens."""
    known = align.tokenizers(BYTE, PIECE)
    out, totals = [], collections.Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = OWN.encode(" " + (text or ""), add_special_tokens=False).ids
        b = known.b.encode(text or "")
        if not text or b"".join(known.bytes_a[i] for i in a) != raw or b"".join(known.bytes_b[i] for i in b) != raw:
            out.append(None)
            continue
        owner_a = [k for k, i in enumerate(a) for _ in known.bytes_a[i]]
        owner_b = [k for k, i in enumerate(b) for _ in known.bytes_b[i]]
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        ends = set(itertools.accumulate(len(known.bytes_a[i]) for i in a)) & set(itertools.accumulate(len(known.bytes_b[i]) for i in b))
        groups, low = [], 0
        for high in sorted(ends):
            groups.append((list(dict.fromkeys(owner_a[low:high])), list(dict.fromkeys(owner_b[low:high]))))
            low = high
        text_of = ";".join(",".join(str(a[k]) for k in x) + "|" + ",".join(str(b[k]) for k in y) for x, y in groups)
        pairs = [(a[i], b[j]) for i, j in links]
        totals.update(pairs)
        out.append((len(a), len(b), len(groups), pairs, text_of))
    return out, totals


def expected(texts):
    found, totals = brute_alignment(texts)
    top = collections.Counter()
    for (_, b), n in totals.items():
        top[b] = max(top[b], n)
    return [
        (0, 0, 0, 0, 0, 0, "", "") if x is None
        else (*x[:3], len(x[3]), sum(totals[p] == top[p[1]] for p in x[3]), sum(totals[p] for p in x[3]), x[4], hashlib.sha256(x[4].encode()).hexdigest())
        for x in found
    ]


TEXTS = st.text(st.one_of(st.sampled_from(" \n\tab,.'1_▁<|>é中\U0001f600"), st.characters(codec="utf-8")), max_size=60)


def test_alignment_is_that_of_brute_force(spark):
    rng = random.Random(8)
    words = ["the", "unfathomable", "naïve", "x1", "don't", "<|endoftext|>", "<s>", "  ", "\n", "Straße,", "中文", "a.b.c", "e\u0301", "12345"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(60)]
    texts += [None, "", " ", "  a  ", "a", "x" * 3000, "ab" * 900 + " c", "with ▁ mark", "good " * 300 + "▁ far in", "\x00 nul", texts[0], texts[0], "a,b\nc d."]
    rows = [(None if i == 7 else i % 50, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slice string, row int").repartition(3)
    for chunk, fan in ((1 << 15, 16), (150, 2)):
        got = align.align(docs, BYTE, PIECE, chunk_bytes=chunk, slice_bytes=5000, fan=fan, keep_groups=True).collect()
        want = sorted((str(r[0]), *w) for r, w in zip(rows, expected(texts), strict=True))
        assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups, r.groups_sha256) for r in got) == want


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(3, 30))
def test_safe_cuts_give_the_tokens_of_the_whole(text, chunk):
    known = align.tokenizers(BYTE, PIECE)
    raw = (" " + text).encode()
    at = [*align._ranges(raw, chunk), (len(raw), len(raw))]
    a = [i for (x, _), (y, _) in itertools.pairwise(at) for i in known.a.encode(raw[x:y].decode())]
    assert a == OWN.encode(" " + text, add_special_tokens=False).ids
    if text:
        parts = [raw[x:y].decode() for (_, x), (_, y) in itertools.pairwise(at)]
        assert [i for p in parts if p for i in known.b.encode(p[1:])] == known.b.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.data())
def test_fragments_compose_in_any_order(length, data):
    """Any cuts into ranges, put together in any tree, close the same groups."""

    def tokens():
        inner = data.draw(st.sets(st.integers(1, length - 1))) if length > 1 else set()
        return sorted({*inner, length})

    ends = [tokens(), tokens()]
    cuts = [[0, *sorted(data.draw(st.lists(st.sampled_from([0, *e]), min_size=3, max_size=3))), length] for e in ends]

    def side(which, low, high):
        at = np.array([x for x in ends[which] if low < x <= high], np.int64)
        return align.Side(low, at * 10 + which, at)

    parts = [align.divide(side(0, a, c), side(1, b, d)) for a, c, b, d in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:], strict=False)]
    while len(parts) > 1:
        i = data.draw(st.integers(0, len(parts) - 2))
        parts[i : i + 2] = [align.compose(parts[i], parts[i + 1])]
    total = parts[0]
    assert all(not len(s.ids) for s in (*total.prefix, *total.suffix))
    common, got = sorted(set(ends[0]) & set(ends[1])), []
    for a, b in sorted(total.closed, key=lambda x: x[0].begin):
        got += sorted(set(a.ends.tolist()) & set(b.ends.tolist()))
        assert a.begin == b.begin and a.ends[-1] == b.ends[-1]
    assert got == common
    for which in range(2):
        assert sorted(x for s in total.closed for x in s[which].ends.tolist()) == ends[which]


def test_alignment_of_no_texts(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), BYTE, PIECE).count() == 0


# --- filter audit

DOCS = "doc_id long, text string, source string, part int, salt string"
LABELS = "doc_id long, quality int, toxic int"


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails, out = [], {}
    for i, text, source, *_ in docs:
        text = text or ""
        words = WORD.findall(text)
        hit = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in docs),
        }
        fails.append((source or "", {x for x in hit if hit[x]}, i in good, i in toxic))
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        steps = {}
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                failing = [x for x in mine if f in x[1]]
                removed = [x for x in failing if not x[1] & before]
                steps["".join(order), step] = [
                    f, sum(not x[1] & {*before, f} for x in mine), len(removed), len(failing) - len(removed), sum(x[1] == {f} for x in failing),
                    sum(x[2] for x in removed), sum(x[3] for x in removed),
                ]
        for (order, step), (f, *counts) in steps.items():
            out[part, order, step] = (*counts, sum(s[2] for s in steps.values() if s[0] == f))
    return out


def test_audit_is_that_of_brute_force(spark):
    rng = random.Random(2)
    docs = []
    for i in range(150):
        words = [rng.choice(["a", "b", "Word", "c" * 5, "Ü", "$", "x\x1cy"]) + str(rng.randint(0, rng.choice([3, 500]))) for _ in range(rng.choice([0, 20, 60, 90]))]
        docs.append((i, rng.choice([" ", "\t", "\n"]).join(words), rng.choice(["s1", "s2", "", None]), 1, "x"))
    docs += [(200, docs[60][1], "s1", 1, "x"), (3, docs[60][1], "s2", 1, "x"), (200, docs[60][1], "s1", 1, "x"), (None, docs[0][1], "s1", 1, None)]
    docs += [(300, None, None, None, None), (301, "", "s1", None, None), (None, None, None, None, None), (302, "w " * 30_000, "s2", 0, "y")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 400, 3)] + [(3, 1, None), (None, 1, 1), (6, None, None)]
    want = brute_audit(docs, labels)
    frame, marks = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)
    for range_docs in (1 << 16, 7):
        rows = filter_audit.audit(frame, marks, range_docs).collect()
        got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
        assert len(rows) == len(got) and got == want
    assert filter_audit.audit(frame.limit(0), marks).count() == 0
    assert all(r.good_lost == 0 for r in filter_audit.audit(frame, marks.limit(0)).collect())


def test_audit_broadcasts_neither_labels_nor_repeats(spark):
    """A salted copy of labels is many times their file, and the driver would hold it; rows of one id keep their label."""
    docs = [(i, f"text {i // 2}", "s", 1, "x") for i in range(200)] + [(7, f"more {k}", "s", 1, "x") for k in range(300)] + [(None, "w", "s", 1, "x")] * 50
    frame, marks = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame([(i, 1, i % 2) for i in range(0, 300)], LABELS)
    judged = filter_audit.judged(frame, marks)
    rows = judged.collect()
    assert "Broadcast" not in judged._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == len(docs) and sum(r.good for r in rows) == 500 and sum(r.toxic for r in rows) == 400
    assert sorted(r.doc_id for r in rows if r.fails >> 4 & 1) == list(range(1, 200, 2))


@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)))
def test_posting_lists_unite_and_differ_as_sets(x, y):
    a, b = np.array(sorted(x), np.int32), np.array(sorted(y), np.int32)
    assert filter_audit.union(a, b).tolist() == sorted(x | y)
    assert a[~filter_audit.member(a, b)].tolist() == sorted(x - y)


def test_posting_lists_hold_sorted_places_by_part_and_range(spark):
    rows = spark.range(100).selectExpr("id DIV 2 AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS part", "CAST(id % 32 AS INT) AS fails", "id % 5 = 0 AS good", "false AS toxic", "CAST(id AS INT) AS salt")
    found = filter_audit.postings(rows, 16).collect()
    assert sum(r.docs for r in found) == 100 and all(r.first_id <= r.last_id for r in found)
    for i, f in enumerate("ABCDE"):
        assert sum(len(r[f]) for r in found) == sum(k % 32 >> i & 1 for k in range(100))
    assert all(list(r[f]) == sorted(set(r[f])) for r in found for f in filter_audit.LISTS)
    assert max(sum(r.docs for r in found if r.first_id <= i <= r.last_id) for i in range(50)) <= 64
