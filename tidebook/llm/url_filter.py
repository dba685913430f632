"""Verdicts on URLs: a few prefix rules, then a list of canonical URLs behind a Bloom filter.

A rule names a host and a path; it fits that host and its subdomains where the URL's path starts
with the rule's, and of several the longest text (host and path) wins, then the first in order.
URLs without a rule are blocked if their canonical form is listed and allowed otherwise.

The list may be of any size.  Its canonical URLs set one bit in each of eight 64-bit words of one
block, so that a test reads one row: the filter is a table (block, eight words) made by one
aggregate, some 12 bits a listed URL.  Pages meet it by block; only possible hits, the listed ones
and about one in a hundred others, are exchanged for the exact join that removes the false ones.
That join takes different URLs only, and a URL that very many pages share is salted when the
answer goes back to the pages.  The filter is broadcast if its size, which follows from the number
of its blocks, is at most `most_broadcast` bytes, and joined by an exchange beyond it.  All of it
is SQL functions.

Canonical form: no scheme, user, fragment, port 80 or 443, leading `www.` or final dot of the
host; A-Z of the host lower-cased; runs of slashes one, no slash at the end; query parameters in
order, those that only track a visit dropped.

Defined results: a URL that is null or has no `://` has an empty host and path, fits no rule, is
never listed and so is allowed; repeated rows are judged once each; an empty table gives no rows,
an empty list blocks nothing; null or repeated listed URLs count once or not at all; other columns
of the pages, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
#: Query parameters that name a visit, not a page.  Fixed values.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|msclkid|ref)(=|$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; empty without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One text for all spellings of an address; null without `://`."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^.*@", ""), r"^www\.|\.?(:80|:443)?$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), "/+", "/"), "/$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(F.lit(""))
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, tail))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    """The bit that a key sets in one word: six bits of its second hash."""
    place = F.shiftright(F.xxhash64(key, F.lit(1)), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of the column `key`: one row for each block that has a bit."""
    bits = [F.bit_or(_bit(F.col("key"), i)).alias(f"w{i}") for i in range(WORDS)]
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*bits)


def judge(
    pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, *,
    bits_per_url: int = 12, most_broadcast: int = 64 << 20, salts: int = 16,
) -> DataFrame:
    """page_id, url, host, path, rule, verdict, possible (the filter's answer) and listed of every page.

    `listed` has a column url.  A verdict without a rule is "block" where listed, else "allow"."""
    keys = listed.select(canonical(F.col("url")).alias("key")).where(F.col("key").isNotNull()).distinct()
    blocks = max(1, -(-keys.count() * bits_per_url // (64 * WORDS)))
    held = bloom(keys, blocks)
    if blocks * 8 * (WORDS + 1) <= most_broadcast:
        held = F.broadcast(held)
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    text, verdict = rule_of(host, path, rules)
    rows = rows.withColumns({"rule": text, "ruled": verdict, "key": canonical(url)})
    # Pages without an address take part under blocks of their own, which are in no filter.
    none = F.lit(-1) - F.pmod(F.monotonically_increasing_id(), F.lit(1024))
    rows = rows.withColumn("block", F.when(F.col("key").isNull(), none).otherwise(_block(F.col("key"), blocks)))
    met = rows.join(held, "block", "left")
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(_bit(F.col("key"), i)) != 0)
    met = met.select(*(c for c in rows.columns if c != "block"), F.coalesce(hit, F.lit(False)).alias("possible"))
    hits, misses = met.where("possible"), met.where("NOT possible")
    # The exact join: different possible URLs against the list itself.
    true = keys.join(hits.select("key").distinct(), "key", "left_semi")
    salted = true.select("key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(True).alias("listed"))
    hits = hits.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    hits = hits.join(salted, ["key", "salt"], "left").drop("salt")
    both = hits.unionByName(misses.withColumn("listed", F.lit(False)))
    found = F.coalesce(F.col("listed"), F.lit(False))
    return both.select(
        "page_id", "url", "host", "path", "rule",
        F.coalesce("ruled", F.when(found, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "possible", found.alias("listed"),
    )
