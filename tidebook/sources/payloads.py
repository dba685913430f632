"""Provider JSON payloads to typed rows.

Each input frame holds one payload per row in the text column ``payload``,
next to the request columns ``ticker`` and/or ``trade_date`` that the payload
answers. Items are unfolded with one ``json_tuple`` parse per item. Bad
payloads yield no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.config import (
    EXACT_DAY_STATE,
    OFFICIAL_BROKER_STATE,
    OFFICIAL_BROKER_SUMMARY,
    OFFICIAL_MARKET_SUMMARY,
    OFFICIAL_STOCK_SUMMARY,
    VENDOR_EXACT_DAY,
    VENDOR_FOREIGN_FLOW,
    VENDOR_NET_SIDE,
    VENDOR_STOCK_SUMMARY,
)
from tidebook.functions.frames import latest_by_key
from tidebook.functions.scalars import canonical_ticker, day, number

def _json(column: Column | str, path: str) -> Column:
    return F.get_json_object(column, path)


def _is_list(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("["), F.lit(False))


def _is_object(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("{"), F.lit(False))


def _items(df: DataFrame, rows: Column, fields: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One output row per list element; the fields come as text columns ``f_<field>``."""
    listed = df.select(*keep, F.from_json(F.when(_is_list(rows), rows), "array<string>").alias("_items"))
    single = listed.select(*keep, F.explode("_items").alias("_item")).where(_is_object(F.col("_item")))
    # json_tuple is case-sensitive; numbered names keep fields that differ in case apart.
    parsed = single.select(*keep, F.json_tuple("_item", *fields).alias(*[f"_{i}" for i in range(len(fields))]))
    return parsed


def _pick(fields: Sequence[str]):
    index = {f: i for i, f in enumerate(fields)}

    def text(*names: str) -> Column:
        """First alias that is present and not empty."""
        return F.coalesce(*[F.when(F.col(f"_{index[n]}") != "", F.col(f"_{index[n]}")) for n in names])

    def num(*names: str) -> Column:
        """First alias that is a number, else zero."""
        return F.coalesce(*[number(F.col(f"_{index[n]}")) for n in names], F.lit(0.0))

    return text, num


STOCK_FIELDS = (
    "StockCode",
    "Date",
    "ForeignBuy",
    "ForeignSell",
    "Value",
    "Volume",
    "Frequency",
    "Bid",
    "Offer",
    "BidVolume",
    "OfferVolume",
    "ListedShares",
    "TradebleShares",
)


def _stock_summary(df: DataFrame, rows: Column, source: str) -> DataFrame:
    text, num = _pick(STOCK_FIELDS)
    items = _items(df, rows, STOCK_FIELDS, ["trade_date"])
    return items.select(
        canonical_ticker(text("StockCode")).alias("ticker"),
        F.coalesce(day(text("Date")), F.col("trade_date")).alias("trade_date"),
        num("ForeignBuy").alias("foreign_buy"),
        num("ForeignSell").alias("foreign_sell"),
        (num("ForeignBuy") - num("ForeignSell")).alias("foreign_net"),
        num("Value").alias("traded_value"),
        num("Volume").alias("volume"),
        num("Frequency").alias("frequency"),
        num("Bid").alias("bid"),
        num("Offer").alias("offer"),
        num("BidVolume").alias("bid_volume"),
        num("OfferVolume").alias("offer_volume"),
        num("ListedShares").alias("listed_shares"),
        num("TradebleShares").alias("tradable_shares"),
        F.lit(source).alias("source"),
    ).where(F.col("ticker") != "")


def official_stock_summary(df: DataFrame) -> DataFrame:
    return _stock_summary(df, _json("payload", "$.data"), OFFICIAL_STOCK_SUMMARY)


def vendor_stock_summary(df: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    out = _stock_summary(df, _json(_unwrapped(F.col("payload")), "$.data"), VENDOR_STOCK_SUMMARY)
    return out if universe is None else out.join(universe.select("ticker"), "ticker", "left_semi")


def _unwrapped(payload: Column) -> Column:
    """The inner object where the answer is wrapped in a project envelope."""
    # Keys that mark an endpoint object.
    inner = _json(payload, "$.data")
    marks = [_json(inner, f"$.{k}").isNotNull() for k in ("dataset", "provider", "recordsTotal", "total", "items")]
    marked = marks[0] | marks[1] | marks[2] | marks[3] | marks[4]
    return F.when(_is_object(inner) & marked, inner).otherwise(payload)


FOREIGN_FIELDS = ("code", "foreignBuyShares", "foreignSellShares", "netForeignShares", "value", "volume")


def split_by_unit(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payloads in shares, payloads in any other unit)."""
    # Names of the share unit.
    body = _unwrapped(F.col("payload"))
    unit = F.lower(F.trim(F.coalesce(F.when(_json(body, "$.unit") != "", _json(body, "$.unit")), F.lit("shares"))))
    ok = unit.isin("share", "shares", "lembar", "lembar saham")
    return df.where(ok), df.where(~ok)


def vendor_foreign_flow(df: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Share-unit foreign flow; payloads in another unit are left to ``split_by_unit``."""
    text, num = _pick(FOREIGN_FIELDS)
    good, _ = split_by_unit(df)
    body = good.withColumn("_body", _unwrapped(F.col("payload")))
    body = body.withColumn("_day", F.coalesce(day(_json("_body", "$.date")), F.col("trade_date")))
    items = _items(body, _json("_body", "$.data"), FOREIGN_FIELDS, ["_day"])
    buy, sell = num("foreignBuyShares"), num("foreignSellShares")
    out = items.select(
        canonical_ticker(text("code")).alias("ticker"),
        F.col("_day").alias("trade_date"),
        buy.alias("foreign_buy"),
        sell.alias("foreign_sell"),
        F.coalesce(number(text("netForeignShares")), buy - sell).alias("foreign_net"),
        num("value").alias("traded_value"),
        num("volume").alias("volume"),
        F.lit(VENDOR_FOREIGN_FLOW).alias("source"),
    ).where(F.col("ticker") != "")
    return out if universe is None else out.join(universe.select("ticker"), "ticker", "left_semi")


BROKER_FIELDS = (
    "StockCode",
    "stockCode",
    "Symbol",
    "symbol",
    "IDFirm",
    "BrokerCode",
    "brokerCode",
    "Code",
    "code",
    "FirmName",
    "BrokerName",
    "brokerName",
    "Date",
    "date",
    "BuyValue",
    "buyValue",
    "Buy",
    "buy",
    "SellValue",
    "sellValue",
    "Sell",
    "sell",
    "BuyVolume",
    "buyVolume",
    "BuyQty",
    "buyQty",
    "SellVolume",
    "sellVolume",
    "SellQty",
    "sellQty",
    "BuyAvg",
    "buyAvg",
    "BuyAverage",
    "buyAverage",
    "SellAvg",
    "sellAvg",
    "SellAverage",
    "sellAverage",
)


def official_broker_summary(df: DataFrame, source_url: str | None = None) -> DataFrame:
    """Stock-level broker rows; other tickers and all-zero rows are dropped."""
    text, num = _pick(BROKER_FIELDS)
    data = _json("payload", "$.data")
    nested = F.coalesce(*[_json(data, f"$.{k}") for k in ("data", "results", "aaData")])
    rows = F.when(_is_object(data), nested).otherwise(data)
    items = _items(df, rows, BROKER_FIELDS, ["ticker", "trade_date"])
    symbol = canonical_ticker(F.col("ticker"))
    out = items.select(
        symbol.alias("ticker"),
        canonical_ticker(F.coalesce(text("StockCode", "stockCode", "Symbol", "symbol"), F.col("ticker"))).alias("_row"),
        F.coalesce(day(text("Date", "date")), F.col("trade_date")).alias("trade_date"),
        F.upper(F.trim(text("IDFirm", "BrokerCode", "brokerCode", "Code", "code"))).alias("broker_code"),
        F.trim(F.coalesce(text("FirmName", "BrokerName", "brokerName"), F.lit(""))).alias("broker_name"),
        num("BuyValue", "buyValue", "Buy", "buy").alias("buy_value"),
        num("SellValue", "sellValue", "Sell", "sell").alias("sell_value"),
        num("BuyVolume", "buyVolume", "BuyQty", "buyQty").alias("buy_volume"),
        num("SellVolume", "sellVolume", "SellQty", "sellQty").alias("sell_volume"),
        num("BuyAvg", "buyAvg", "BuyAverage", "buyAverage").alias("buy_avg"),
        num("SellAvg", "sellAvg", "SellAverage", "sellAverage").alias("sell_avg"),
        F.lit("RG").alias("market_type"),
        F.lit(OFFICIAL_BROKER_SUMMARY).alias("source"),
        F.lit(True).alias("source_verified"),
        F.lit(source_url).cast("string").alias("source_url"),
        F.lit(OFFICIAL_BROKER_STATE).alias("provenance_state"),
    )
    some = (
        (F.col("buy_value") != 0) | (F.col("sell_value") != 0) | (F.col("buy_volume") != 0) | (F.col("sell_volume") != 0)
    )
    return out.where((F.col("_row") == F.col("ticker")) & (F.col("broker_code") != "") & some).drop("_row")


MARKET_FIELDS = ("IDFirm", "FirmName", "Date", "Volume", "Value", "Frequency")


def market_broker_totals(df: DataFrame) -> DataFrame:
    """Market-wide totals per broker, a health signal only."""
    text, num = _pick(MARKET_FIELDS)
    items = _items(df, _json("payload", "$.data"), MARKET_FIELDS, ["trade_date"])
    return items.select(
        F.coalesce(day(text("Date")), F.col("trade_date")).alias("trade_date"),
        F.upper(F.trim(text("IDFirm"))).alias("broker_code"),
        F.trim(F.coalesce(text("FirmName"), F.lit(""))).alias("broker_name"),
        num("Volume").alias("volume"),
        num("Value").alias("value"),
        num("Frequency").alias("frequency"),
        F.lit(OFFICIAL_MARKET_SUMMARY).alias("source"),
    ).where(F.col("broker_code") != "")


EXACT_FIELDS = ("code", "buy_value", "sell_value", "buy_volume", "sell_volume", "buy_avg", "sell_avg")


def exact_day_broker(df: DataFrame, market: str = "RG", investor: str = "all", source_url: str | None = None) -> DataFrame:
    """Gross broker rows of one exact day; negatives count as zero, empty rows drop out."""
    text, num = _pick(EXACT_FIELDS)
    good = df.where(_json("payload", "$.success") == "true")
    items = _items(good, _json("payload", "$.data"), EXACT_FIELDS, ["ticker", "trade_date"])
    state = EXACT_DAY_STATE.replace("_ALL_RG_", f"_{investor.upper()}_{market.upper()}_")
    out = items.select(
        canonical_ticker(F.col("ticker")).alias("ticker"),
        "trade_date",
        F.upper(F.trim(text("code"))).alias("broker_code"),
        *[F.greatest(num(c), F.lit(0.0)).alias(c) for c in EXACT_FIELDS[1:]],
        F.lit(market.upper()).alias("market_type"),
        F.lit(VENDOR_EXACT_DAY).alias("source"),
        F.lit(True).alias("source_verified"),
        F.lit(source_url).cast("string").alias("source_url"),
        F.lit(state).alias("provenance_state"),
    )
    some = (F.col("buy_value") > 0) | (F.col("sell_value") > 0) | (F.col("buy_volume") > 0) | (F.col("sell_volume") > 0)
    return out.where((F.col("broker_code") != "") & some)


NET_FIELDS = ("code", "broker", "side", "transaction_type", "symbol", "date", "lot", "value", "avg")


def net_side_broker(df: DataFrame, investor: str = "ALL", url_prefix: str | None = None) -> DataFrame:
    """One-sided net rows to two-sided columns; lots of 100 become shares."""
    # 100 shares per lot.
    text, num = _pick(NET_FIELDS)
    items = _items(df, _json("payload", "$.data.results"), NET_FIELDS, ["ticker", "trade_date"])
    nested = _json(text("broker"), "$.code")
    rows = items.select(
        canonical_ticker(F.col("ticker")).alias("ticker"),
        canonical_ticker(F.coalesce(text("symbol"), F.col("ticker"))).alias("_row"),
        F.coalesce(day(text("date")), F.col("trade_date")).alias("trade_date"),
        F.upper(F.trim(F.coalesce(text("code"), nested))).alias("broker_code"),
        F.upper(F.trim(text("side"))).alias("_side"),
        F.upper(F.trim(F.coalesce(text("transaction_type"), F.lit("NET")))).alias("_kind"),
        (num("lot") * 100.0).alias("_shares"),
        num("value").alias("_value"),
        num("avg").alias("_avg"),
    ).where(
        (F.col("broker_code") != "")
        & F.col("_side").isin("BUY", "SELL")
        & (F.col("_kind") == "NET")
        & (F.col("_row") == F.col("ticker"))
    )

    def on(side: str, value: str, name: str) -> Column:
        return F.when(F.col("_side") == side, F.col(value)).otherwise(F.lit(0.0)).alias(name)

    url = F.lit(None).cast("string")
    if url_prefix is not None:
        url = F.concat(F.lit(url_prefix), F.col("ticker"), F.lit("/broker_summary"))
    return rows.select(
        "ticker",
        "trade_date",
        "broker_code",
        on("BUY", "_value", "buy_value"),
        on("SELL", "_value", "sell_value"),
        on("BUY", "_shares", "buy_volume"),
        on("SELL", "_shares", "sell_volume"),
        on("BUY", "_avg", "buy_avg"),
        on("SELL", "_avg", "sell_avg"),
        F.lit("ALL").alias("market_type"),
        F.lit(VENDOR_NET_SIDE).alias("source"),
        F.lit(True).alias("source_verified"),
        url.alias("source_url"),
        F.lit(f"VERIFIED_VENDOR_API_NET_SIDE_{investor.upper()}").alias("provenance_state"),
    )


def chart_bars(df: DataFrame, positive_only: bool = False) -> DataFrame:
    """Parallel chart arrays (epoch seconds, OHLCV) to bars; the last bar of a day stays."""
    base = "$.chart.result[0]"
    fields = ("open", "high", "low", "close", "volume")
    arrays = df.select(
        canonical_ticker(F.col("ticker")).alias("ticker"),
        F.from_json(_json("payload", f"{base}.timestamp"), "array<bigint>").alias("ts"),
        *[F.from_json(_json("payload", f"{base}.indicators.quote[0].{f}"), "array<double>").alias(f) for f in fields],
    )
    # ``get`` past the end of a shorter array is null.
    bars = arrays.select("ticker", *fields, F.posexplode("ts").alias("pos", "sec")).select(
        "ticker",
        F.timestamp_seconds("sec").cast("date").alias("date"),
        *[F.get(F.col(f), F.col("pos")).alias(f) for f in fields],
        "pos",
    )
    keep = F.col("date").isNotNull() & F.col("close").isNotNull()
    if positive_only:
        keep = keep & (F.col("close") > 0)
    return latest_by_key(bars.where(keep), ["ticker", "date"], [F.col("pos")]).drop("pos")


def wide_bars(df: DataFrame, date_column: str = "date", separator: str = ":") -> DataFrame:
    """Wide columns named ``<symbol>:<field>`` to one row per symbol and day."""
    wide = [c for c in df.columns if separator in c]
    long = df.select(F.col(date_column).alias("date"), *[F.col(f"`{c}`").cast("double").alias(c) for c in wide])
    long = long.unpivot("date", [f"`{c}`" for c in wide], "_name", "_value")
    field = F.lower(F.replace(F.element_at(F.split("_name", separator), 2), F.lit(" "), F.lit("_")))
    named = long.select(
        canonical_ticker(F.element_at(F.split("_name", separator), 1)).alias("ticker"), "date", field.alias("_field"), "_value"
    )
    names = ["open", "high", "low", "close", "adj_close", "volume"]
    return named.groupBy("ticker", "date").agg(*[F.max(F.when(F.col("_field") == n, F.col("_value"))).alias(n) for n in names])
