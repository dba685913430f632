"""Personal data: patterns of four kinds, and bootstrapped extraction from their contexts.

Base spans are the leftmost non-overlapping matches of each kind's expression that pass the
kind's test.  They are the seeds.  A seed's neighbouring words induce lexical patterns: the word
before it, the word after it, both.  Tokens that look like identifiers (a digit or @, four
characters at least, outside of base spans) are instances too, with the patterns around them.
Patterns and instances form a graph that is scored in rounds: a pattern's score for a kind is the
share of its different instances that are of that kind, smoothed; an unseen instance's is the
chance that at least one of its patterns is right.  Patterns need `support` different instances of
the kind and a score of `trust`; instances of score `trust` become seeds of the next round.  In the
end every occurrence of such an instance beside a trusted pattern is a span of its kind.

Everything is a DataFrame operation: positions come from the lengths of matches and of the gaps
between them, scores from joins and aggregates over different (pattern, instance) pairs, which
are reduced in each task before they are dealt.

Defined results: a null text is empty and has no spans; positions count code points, ends are
exclusive; repeated rows get the same spans each; an empty table gives no rows.  The expressions
are possessive where nothing can be gained by giving back, so that long runs cost linear time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import staged

KINDS = ("email", "ip", "card", "phone")
#: What each kind looks like.  A match can only begin where the one before ended or
#: where no longer one could have begun.
LOOK = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A quick sign that a text may hold the kind.
SIGN = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: An identifier-like token: four characters at least, one of them a digit or @.
TOKEN = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S{4,}+"
EDGE = ".,;:!?()[]{}<>\"'`|"
SPAN = "array<struct<kind:int,start:int,end:int,value:string,left:string,right:string>>"


def _test(kind: str) -> Callable[[Column], Column]:
    return lambda s: _passes(kind, s["value"])


def _passes(kind: str, x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        # Luhn: from the right, every second digit counts twice, less 9 where that is over 9.
        places = F.sequence(F.lit(1), n)
        digit = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        luhn = F.aggregate(places, F.lit(0), lambda s, i: s + F.when(i % 2 == 1, digit(i)).otherwise((digit(i) * 2) % 10 + F.floor(digit(i) / 5).cast("int")))
        return n.between(16, 19) & (luhn % 10 == 0)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _word(gap: Column, last: bool) -> Column:
    """The last or first word of the text between two matches, as patterns name it."""
    plain = F.translate(gap, "\t\n\r\x0b\x0c", "     ")
    word = F.substring_index(F.rtrim(plain), " ", -1) if last else F.substring_index(F.ltrim(plain), " ", 1)
    return F.regexp_replace(F.lower(F.trim(word, F.lit(EDGE))), "[0-9]", "0")


def _matches(df: DataFrame, out: str, look: str, sign: str, kind: int) -> DataFrame:
    """Adds `out`: all matches of an expression in text, with places and neighbouring words.

    The text is cut at the matches: a match begins after all gaps up to it and all matches
    before it."""
    may = F.col("text").rlike(sign)
    df = df.withColumn("_m", F.when(may, F.regexp_extract_all("text", F.lit(look), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split("text", look, -1)))
    df = df.withColumn("_ends", F.expr("aggregate(zip_with(_m, slice(_g, 1, size(_m)), (m, g) -> length(m) + length(g)), array(0), (a, n) -> array_append(a, element_at(a, -1) + n))"))

    def span(m: Column, i: Column) -> Column:
        before = F.get("_g", i)
        start = F.get("_ends", i) + F.length(before)
        return F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"),
            _word(before, True).alias("left"), _word(F.get("_g", i + 1), False).alias("right"),
        )

    return df.withColumn(out, F.transform("_m", span).cast(SPAN)).drop("_m", "_g", "_ends")


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds `base`, all base spans in order, to rows with a column text (not null)."""
    for k, kind in enumerate(KINDS):
        docs = _matches(docs, f"_{kind}", LOOK[kind], SIGN[kind], k)
        docs = docs.withColumn(f"_{kind}", F.filter(f"_{kind}", _test(kind)))
    return docs.withColumn("base", F.concat(*[f"_{kind}" for kind in KINDS])).drop(*[f"_{kind}" for kind in KINDS])


def candidates(docs: DataFrame) -> DataFrame:
    """Adds `tokens`: identifier-like tokens outside of base spans, without marks at their edges."""
    docs = _matches(docs, "tokens", TOKEN, "[0-9@]", -1)

    def trimmed(s: Column) -> Column:
        front = F.ltrim(s["value"], F.lit(EDGE))
        value = F.rtrim(front, F.lit(EDGE))
        start = s["end"] - F.length(front)
        return F.struct(F.lit(-1).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), s["left"].alias("left"), s["right"].alias("right"))

    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return docs.withColumn("tokens", F.filter(F.transform("tokens", trimmed).cast(SPAN), lambda s: (F.length(s["value"]) >= 4) & apart(s)))


def _pattern_keys(s: str) -> Column:
    return F.array(
        F.when(F.col(f"{s}.left") != "", F.concat(F.lit("l "), f"{s}.left")),
        F.when(F.col(f"{s}.right") != "", F.concat(F.lit("r "), f"{s}.right")),
        F.when((F.col(f"{s}.left") != "") & (F.col(f"{s}.right") != ""), F.concat(F.lit("b "), f"{s}.left", F.lit(" "), f"{s}.right")),
    )


def bootstrapped(found: DataFrame, support: int, trust: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (pattern, kind) and instances (value, kind), from rows with base and tokens."""
    every = found.select(F.explode(F.concat("base", "tokens")).alias("s"))
    edges = every.select(F.explode(_pattern_keys("s")).alias("pattern"), F.lower("s.value").alias("value"), F.col("s.kind").alias("seed")).where("pattern IS NOT NULL")
    edges = staged(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    scores = edges.where("seed >= 0").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    patterns = None
    for _ in range(rounds):
        scores = staged(scores)
        size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
        sums = edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("known"))
        patterns = sums.where(F.col("known") >= support).join(size, "pattern").withColumn("trust", F.col("sum") / (F.col("n") + 0.5))
        patterns = staged(patterns.where(F.col("trust") >= trust).select("pattern", "kind", "trust"))
        unseen = edges.where("seed < 0").join(patterns, "pattern").groupBy("value", "kind")
        fresh = unseen.agg((1 - F.exp(F.sum(F.log(1 - F.col("trust") * 0.999)))).alias("score")).where(F.col("score") >= trust)
        seeds = edges.where("seed >= 0").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
        scores = seeds.unionByName(fresh.join(seeds.select("value").distinct(), "value", "left_anti"))
    return patterns, staged(scores)


def find(
    docs: DataFrame, support: int = 5, trust: float = 0.8, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, _k1, _k2, base, extra) of every document: base spans, and those that the contexts
    reveal, as arrays of (kind, start, end, value, left, right).  _k1 and _k2 name the row by its
    id and text."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(id_col, text_col).alias("_k1"), F.hash(text_col, id_col).alias("_k2")
    )
    found = staged(candidates(base_spans(rows)).select("doc_id", "_k1", "_k2", "base", "tokens"))
    patterns, instances = bootstrapped(found, support, trust, rounds)
    tokens = found.where(F.size("tokens") > 0).select("_k1", "_k2", "tokens").dropDuplicates(["_k1", "_k2"])
    tokens = tokens.select("_k1", "_k2", F.explode("tokens").alias("s"))
    around = tokens.select("_k1", "_k2", "s", F.lower("s.value").alias("value"), F.explode(_pattern_keys("s")).alias("pattern"))
    known = around.join(patterns.select("pattern", "kind"), "pattern").join(instances.select("value", "kind"), ["value", "kind"])
    # A token beside patterns of two kinds gets the first of them.
    spans = known.groupBy("_k1", "_k2", F.col("s.start").alias("start")).agg(F.min(F.struct("kind", "s")).alias("best"))
    extra = F.struct(F.col("best.kind").alias("kind"), "start", F.col("best.s.end").alias("end"), F.col("best.s.value").alias("value"), F.col("best.s.left").alias("left"), F.col("best.s.right").alias("right"))
    added = spans.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(extra)).cast(SPAN).alias("extra"))
    joined = found.drop("tokens").join(added, ["_k1", "_k2"], "left")
    return joined.select("doc_id", "_k1", "_k2", "base", F.coalesce("extra", F.array().cast(SPAN)).alias("extra"))


def listed(spans: Column) -> Column:
    """kind:start:end, by kind and start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """All documents, each span of text replaced by its kind in capitals and angle brackets.

    n_chars, where there is one, follows the text.  The text is read once more and never shuffled:
    base spans are found in the row, and the few rows with spans from contexts come by a join that
    sends only those with such spans where they are few."""
    found = find(docs, id_col=id_col, text_col=text_col, **how)
    extra = staged(found.where(F.size("extra") > 0).select("_k1", "_k2", "extra").dropDuplicates(["_k1", "_k2"]))
    # Up to this many rows go to every task; more are joined by a shuffle.
    few = extra.limit(50_001).count() <= 50_000
    keyed = docs.select(
        F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(id_col, text_col).alias("_k1"), F.hash(text_col, id_col).alias("_k2")
    )
    spanned = base_spans(keyed.join(F.broadcast(extra) if few else extra, ["_k1", "_k2"], "left"))
    spans = F.array_sort(F.transform(F.concat("base", F.coalesce("extra", F.array().cast(SPAN))), lambda s: F.struct(s["start"], -s["end"], s["kind"])))
    spanned = spanned.withColumn("_spans", spans)
    cut = F.expr(
        """aggregate(_spans, struct(0 AS at, cast(array() AS array<string>) AS out), (a, s) -> CASE
             WHEN s.start >= a.at THEN struct(-s.col2 AS at, concat(a.out, array(substring(text, a.at + 1, s.start - a.at), element_at(array('<EMAIL>', '<IP>', '<CARD>', '<PHONE>'), s.kind + 1))) AS out)
             ELSE struct(greatest(a.at, -s.col2) AS at, a.out AS out) END,
           a -> concat(array_join(a.out, ''), substring(text, a.at + 1)))"""
    )
    spanned = spanned.withColumn("_text", F.when(F.size("_spans") > 0, cut).otherwise(F.col(f"_row.{text_col}")))
    columns = {c: F.col(f"_row.{c}") for c in docs.columns}
    columns[text_col] = F.col("_text")
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.coalesce(F.when(F.size("_spans") > 0, F.length("_text")), F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return spanned.select(*[columns[c].alias(c) for c in docs.columns])
