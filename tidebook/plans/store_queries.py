"""Queries over what sinks leave behind: checked writes, audits, stored diagnostics, JSON files, SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook import config as C
from tidebook.functions.frames import one_row, staged
from tidebook.operators import evidence, funnel, normalize
from tidebook.operators.scan import in_result_order
from tidebook.plans import catalogue as Q
from tidebook.plans.catalogue import query
from tidebook.plans.oracle_views import even
from tidebook.sources import sinks, sql_functions
from tidebook.sources import tables as T


@query(
    "run_id written:i mismatch",
    """SELECT 'GOOD' AS run_id, count(*) AS written, CAST(NULL AS VARCHAR) AS mismatch FROM signals
       UNION ALL SELECT 'SHORT', count(*) FILTER (WHERE ticker NOT LIKE '%3'),
         'run SHORT: expected ' || count(*) || ' rows, found ' || count(*) FILTER (WHERE ticker NOT LIKE '%3') FROM signals""",
)
def results_checked(spark, root):
    """One run is written whole; a faulty writer loses some tickers of another, which fails."""
    path = f"{Q._home(spark, 'results')}/table"
    rows = T.signals(spark, root).select("ticker", "as_of_date")

    def faulty(df: DataFrame) -> None:
        df.where("ticker NOT LIKE '%3'").write.mode("append").partitionBy("run_id").parquet(path)

    sinks.write_results(rows, path, "GOOD")
    try:
        sinks.write_results(rows, path, "SHORT", faulty)
        said = None
    except sinks.WriteMismatch as error:
        said = str(error)
    held = spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("written"))
    return held.withColumn("mismatch", F.when(F.col("run_id") == "SHORT", F.lit(said).cast("string")))


@query(
    "provider dataset status rows_received:i rows_accepted:i rows_rejected:i held:i",
    """SELECT 'CHART' AS provider, 'OHLCV_DAILY' AS dataset, 'COMPLETED' AS status, count(*) AS rows_received, count(*) FILTER (WHERE volume > 30) AS rows_accepted,
         count(*) FILTER (WHERE NOT volume > 30) AS rows_rejected, count(*) FILTER (WHERE volume > 30) AS held FROM bars
       UNION ALL SELECT 'CHART', 'NONE', 'INSUFFICIENT', count(*), 0, count(*), count(*) FILTER (WHERE volume > 30) FROM bars""",
)
def ingestion_counts(spark, root):
    """Bars landed with a condition, and with one that is always null; the table then holds the first."""
    home, bars = Q._home(spark, "landing"), T.bars(spark, root)
    sinks.land_accepted(bars, F.col("volume") > 30, f"{home}/bars", f"{home}/audit", "CHART", "OHLCV_DAILY")
    sinks.land_accepted(bars, F.lit(None).cast("boolean"), f"{home}/bars", f"{home}/audit", "CHART", "NONE")
    return spark.read.parquet(f"{home}/audit").withColumn("held", F.lit(spark.read.parquet(f"{home}/bars").count()))


@query(
    "run_id ticker kind rank:i score:4 status",
    """SELECT run_id, ticker, kind, CASE WHEN kind IN (0, 1) THEN n % 50 END AS rank, CASE WHEN kind = 0 THEN n / 4.0 END AS score,
         CASE WHEN kind = 0 THEN 'S' || n END AS status
       FROM (SELECT run_id, ticker, CAST(substr(run_id, 2) AS INT) AS n, CAST(substr(run_id, 2) AS INT) % 7 AS kind FROM signals)""",
)
def diagnostics_parsed(spark, root):
    """Stored diagnostics of seven kinds: whole, partly of other types, null, empty, cut off, an array and a number."""
    n = F.substring("run_id", 2, 9).cast("int")
    text = (
        F.when(n % 7 == 0, F.format_string('{"guarded_rank": %d, "guarded_score": %s, "broker_verification_status": "S%d", "more": {"a": [1]}}', n % 50, (n / 4).cast("string"), n))
        .when(n % 7 == 1, F.format_string('{"guarded_rank": %d, "guarded_score": "high"}', n % 50))
        .when(n % 7 == 3, F.lit(" ")).when(n % 7 == 4, F.lit('{"guarded_rank": 1')).when(n % 7 == 5, F.lit('[{"guarded_rank": 1}]')).when(n % 7 == 6, F.lit("7"))
    )
    path = f"{Q._home(spark, 'diagnostics')}/table"
    stored = T.signals(spark, root).select("run_id", "ticker", (n % 7).alias("kind"), text.alias("diagnostics"))
    funnel.parse_diagnostics(stored).write.parquet(path)  # as variants
    held = spark.read.parquet(path)
    fields = {"rank": ("guarded_rank", "int"), "score": ("guarded_score", "double"), "status": ("broker_verification_status", "string")}
    return held.select("run_id", "ticker", "kind", *(funnel._diag_field(held, name, kind).alias(out) for out, (name, kind) in fields.items()))


@query(
    "ticker guarded_rank:i guarded_score:2 broker_verification_status broker_rank:i",
    "SELECT * FROM merged WHERE guarded_rank IS NOT NULL",
)
def funnel_views_stored(spark, root):
    """The broker view from results stored with their diagnostics as text, beside rows of bad text."""
    first, _, second = Q._funnel(spark, root)
    merged = funnel.merge_verified_finalists(first, second)
    path = f"{Q._home(spark, 'stored-results')}/table"
    stored = merged.select("ticker", "final_score", F.to_json("diagnostics").alias("diagnostics"))
    bad = stored.select(F.concat(F.lit("BAD"), "ticker").alias("ticker"), "final_score", F.lit('{"guarded_rank": 0').alias("diagnostics"))
    stored.unionByName(bad).write.parquet(path)
    return funnel.recover_funnel_views(spark.read.parquet(path))[1]


@query(
    "ticker trade_date open:4 high:4 low:4 close:4 volume:4",
    "SELECT ticker, date AS trade_date, open, high, low, close, volume FROM pos WHERE rn <= 120",
)
def sql_price_cache(spark, root):
    sql_functions.register_prices(spark, T.daily_prices(spark, root))
    return spark.sql("SELECT * FROM price_cache(NULL, 120)")


@query(
    "ticker trade_date place:i close:4",
    "SELECT ticker, date AS trade_date, least(300, count(*) OVER (PARTITION BY ticker)) - rn AS place, close FROM pos WHERE rn <= 300 AND ticker IN (SELECT ticker FROM universe WHERE ticker LIKE '%1')",
)
def sql_price_cache_by_ticker(spark, root):
    """Tickers asked for by untidy names."""
    sql_functions.register_prices(spark, T.daily_prices(spark, root))
    names = [r.ticker for r in T.universe(spark, root).where("ticker LIKE '%1'").collect()]
    asked = ", ".join(f"' {n.lower()} '" for n in names)
    return spark.sql(f"SELECT ticker, place, b.trade_date, b.close FROM price_cache_by_ticker(array({asked}), 300) LATERAL VIEW posexplode(payload) AS place, b")


@query("run_id foreign_evidence_tickers:i foreign_evidence_days:i official:i vendor:i", Q.TELEMETRY_SQL)
def sql_run_telemetry(spark, root):
    flows = T.foreign_flows(spark, root)
    vendor, official = (flows.where(F.col("source") == s) for s in (C.VENDOR_FOREIGN_FLOW, C.OFFICIAL_STOCK_SUMMARY))
    sql_functions.register_telemetry(spark, Q._telemetry_results(spark, root), vendor, official)
    sources = "foreign_evidence_sources"
    return spark.sql(f"SELECT *, {sources}['{C.OFFICIAL_STOCK_SUMMARY}'] AS official, {sources}['{C.VENDOR_FOREIGN_FLOW}'] AS vendor FROM run_telemetry(NULL)")


@query(
    "ticker position:i real_money_state",
    f"""SELECT ticker, row_number() OVER (ORDER BY real_money_state, final_score DESC, ticker) AS position, real_money_state
        FROM (SELECT ticker, real_money_state, {even('score', 2)} AS final_score FROM scan_part)""",
)
def results_in_order(spark, root):
    """Scan results as a caller lists them: what may be bought first, then by score."""
    ordered = in_result_order(Q._scan(spark, root, "part"))
    path = f"{Q._home(spark, 'ordered-results')}/table"
    # One file holds the rows in their order; a scan has one row per ticker.
    ordered.select("ticker", "real_money_state").coalesce(1).write.parquet(path)
    return spark.read.parquet(path).withColumn("position", F.monotonically_increasing_id() + 1)


@query(
    "rows:i tickers:i days:i verified_tickers:i freshest",
    """SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, count(DISTINCT trade_date) AS days, count(DISTINCT CASE WHEN source_verified THEN ticker END) AS verified_tickers,
       strftime(max(trade_date), '%Y-%m-%d') AS freshest FROM broker""",
)
def cache_meta(spark, root):
    """Statistics of the broker rows as the JSON file beside a cache, read back."""
    path = f"{Q._home(spark, 'meta')}/json"
    sinks.write_meta(evidence.data_stats(T.broker_flows(spark, root)), path)
    return spark.read.schema("rows long, tickers long, days long, verified_tickers long, freshest string").json(path)


@query(
    "lacks error bars:i",
    """SELECT unnest(['close', 'date', 'high', 'low', 'none', 'open', 'ticker', 'volume']) AS lacks,
         unnest(['price frame lacks close, by any of their names', 'price frame lacks date, by any of their names', 'price frame lacks high, by any of their names',
                 'price frame lacks low, by any of their names', NULL, 'price frame lacks open, by any of their names', 'price frame lacks ticker, by any of their names', NULL]) AS error,
         count(*) AS bars FROM bars""",
)
def schema_errors(spark, root):
    """A price frame without one of its columns: all but the volume are required, before anything runs."""
    bars = staged(T.bars(spark, root).drop("traded_value"), "bars")
    found, last = [], None
    for name in sorted([*bars.columns, "none"]):
        try:
            last, error = normalize.normalize_price_frame(bars.drop(name)), None
        except ValueError as said:
            error = str(said)
        found.append((name, error))
    rows = spark.createDataFrame(found, "lacks string, error string")
    return rows.withColumn("bars", one_row(last.agg(F.count(F.lit(1)).alias("bars")))["bars"])
