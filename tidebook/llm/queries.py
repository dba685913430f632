"""One query per operator over its whole table, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import align, ann, filter_audit, html_extract, langid, mixing, near_dup, packing, pii, pylm, quality, topk, url_filter
from tidebook.llm.common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = {k})) AS BIGINT) AS n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.concat("base", "extra")).alias("spans"), F.size("extra").cast("long").alias("n_extra"),
    )


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_docs")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents")).select("doc_id", "weak", "score", "keep")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def _digit(modulus: int):
    """crc32 of doc_id as text, modulo; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(0))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pylm.score(table(spark, sf_dir, "documents"), _digit(10) == 0)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"), _digit(4) != 2)
    return found.select("doc_id", (_digit(4) == 2).alias("held_out"), "lang_pred", "score")


#: Longest fitting rule first: host and path.  Fixed values.
URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)
#: Host labels whose pages the list names: a label, or a part of it between hyphens.
LISTED_NAMES = r"(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)"


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(url_filter.host_of(F.col("url")).rlike(LISTED_NAMES)).select("url")
    return url_filter.judge(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_near_dup": op2_near_dup,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_html": op6_html,
    "op7_exact_topk": op7_exact_topk,
    "op8_ann": op8_ann,
    "op9_lm": op9_lm,
    "op10_langid": op10_langid,
    "op11_url_filter": op11_url_filter,
    "op12_align": op12_align,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE: dict[str, str] = {
    "op7_exact_topk": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_url_filter": r"""
        WITH u AS (
            SELECT page_id, url,
                   coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
                   list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
                             lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid|msclkid|ref)(=|$)'))) AS params
            FROM pages
        ), k AS (
            SELECT *, CASE WHEN contains(url, '://') THEN
                       regexp_replace(regexp_replace(host, '^.*@', ''), '^www\.|\.?(:80|:443)?$', '', 'g')
                       || regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '')
                       || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS key
            FROM u
        ), l AS (
            SELECT DISTINCT key FROM k WHERE key IS NOT NULL AND regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)')
        ), rules(verdict, host, path) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
        ), fits AS (
            SELECT k.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
            FROM k JOIN rules r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path)
            GROUP BY k.page_id
        )
        SELECT k.page_id, k.host, k.path, f.rule, coalesce(f.verdict, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
               l.key IS NOT NULL AS listed
        FROM k LEFT JOIN fits f ON k.page_id = f.page_id LEFT JOIN l ON k.key = l.key
    """,
    "op13_filter_audit": r"""
        WITH t AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
        ), w AS (
            SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t
        ), m AS (
            SELECT w.doc_id, part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
                   list_filter([CASE WHEN len(words) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' END,
                    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' END,
                    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN w.doc_id > least THEN 'E' END], lambda x: x IS NOT NULL) AS fails
            FROM w LEFT JOIN (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
                              FROM labels GROUP BY doc_id) l ON w.doc_id = l.doc_id
        ), g AS (
            SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL
        ), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), steps AS (
            SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
            FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
        ), s AS (
            SELECT part, filter_order, step, f,
                   sum(CASE WHEN gone THEN 0 ELSE n END) FILTER (NOT contained) AS kept, sum(n) FILTER (contained AND NOT gone) AS removed,
                   sum(n) FILTER (contained AND gone) AS redundant, sum(n) FILTER (contained AND len(fails) = 1) AS unique_fails,
                   sum(n) FILTER (contained AND NOT gone AND good) AS good_lost, sum(n) FILTER (contained AND NOT gone AND toxic) AS toxic_lost
            FROM (SELECT *, list_contains(fails, f) AS contained, len(list_filter(fails, lambda x: contains(before, x))) > 0 AS gone FROM g, steps)
            GROUP BY part, filter_order, step, f
        )
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
               CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
               CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
        FROM s
    """,
}
