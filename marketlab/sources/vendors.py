"""Vendor payloads to bars and snapshots: one payload string for each row, parsed in the JVM.

Payload frames have ``payload`` (text) and ``vendor_symbol``; other columns are dropped.  What does not parse gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close", "volume")
#: Header spellings of the exchange's daily files, in lower case without punctuation.
BHAVCOPY_COLUMNS = {
    "symbol": ("symbol", "tckrsymb"),
    "series": ("series", "sctysrs"),
    "open": ("open", "openprice", "opnpric"),
    "high": ("high", "highprice", "hghpric"),
    "low": ("low", "lowprice", "lwpric"),
    "close": ("close", "closeprice", "clspric"),
    "volume": ("tottrdqty", "ttltrdqnty", "ttltradgvol"),
}


def known(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def instant(text: Column) -> Column:
    """ISO text, or seconds or milliseconds (beyond 1e12) since 1970."""
    number = text.try_cast("double")
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    return F.coalesce(F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")), F.try_to_timestamp(text))


def yahoo_bars(payloads: DataFrame) -> DataFrame:
    """{"bars": [{ts, open, high, low, close, volume, adj_close}]}: a missing volume is 0, a NaN adjusted close null."""
    shape = "bars array<struct<ts string, open double, high double, low double, close double, volume double, adj_close double>>"
    rows = payloads.select("vendor_symbol", F.explode(F.from_json("payload", shape, {"allowNonNumericNumbers": "true"})["bars"]).alias("b"))
    return rows.select("vendor_symbol", instant(F.col("b.ts")).alias("ts"), *(F.col(f"b.{c}") for c in PRICES[:4]), F.coalesce("b.volume", F.lit(0.0)).alias("volume"), known(F.col("b.adj_close")).alias("adj_close"))


def alphavantage_status(payloads: DataFrame) -> DataFrame:
    """Payloads with status: ok, quota (notes and information) or permanent (errors)."""
    keys = F.map_keys(F.from_json("payload", "map<string,string>"))
    has = lambda *names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    return payloads.withColumn("status", F.when(has("Note", "Information"), "quota").when(has("Error Message"), "permanent").otherwise("ok"))


def alphavantage_bars(payloads: DataFrame) -> DataFrame:
    """A "Time Series" object keyed by stamp; fields are numbered differently by endpoint, so they are found by name.  Stamps are the venue's wall clock."""
    series = F.map_filter(F.from_json("payload", "map<string,string>"), lambda k, _: k.startswith("Time Series"))
    days = F.from_json(F.get(F.map_values(series), 0), "map<string,map<string,string>>")
    rows = payloads.select("vendor_symbol", F.explode(days).alias("stamp", "f"))

    def field(name: str) -> Column:
        return F.get(F.map_values(F.map_filter("f", lambda k, _: F.regexp_replace(k, r"^[0-9]+[a-z]*\. ", "") == name)), 0).try_cast("double")

    return rows.select("vendor_symbol", F.try_to_timestamp("stamp").alias("ts"), *(field(c).alias(c) for c in PRICES[:4]), F.coalesce(field("volume"), F.lit(0.0)).alias("volume"), field("adjusted close").alias("adj_close"))


def _cells(c: Column, milli: bool) -> list[Column]:
    at = F.timestamp_micros(F.round(c[0] * (1_000 if milli else 1_000_000)).cast("long")).alias("ts")
    return [at, *(c[i].alias(name) for i, name in enumerate(PRICES, 1))]


def kline_bars(payloads: DataFrame, start=None, end=None) -> DataFrame:
    """[[ms, open, high, low, close, volume]]: entries of six numbers at least, from start up to but without end."""
    rows = payloads.select("vendor_symbol", F.explode(F.from_json("payload", "array<array<double>>")).alias("k")).where(F.size("k") >= 6)
    out = rows.select("vendor_symbol", *_cells(F.col("k"), True))
    out = out if start is None else out.where(F.col("ts") >= F.lit(start))
    return out if end is None else out.where(F.col("ts") < F.lit(end))


def gecko_bars(payloads: DataFrame) -> DataFrame:
    """data.attributes.ohlcv_list with seconds; pages overlap, so a stamp counts once (the largest row: a defined choice)."""
    shape = "data struct<attributes struct<ohlcv_list array<array<double>>>>"
    rows = payloads.select("vendor_symbol", F.explode(F.from_json("payload", shape)["data"]["attributes"]["ohlcv_list"]).alias("k")).where(F.size("k") >= 6)
    rows = rows.groupBy("vendor_symbol", F.col("k")[0].alias("__t")).agg(F.max("k").alias("k"))
    return rows.select("vendor_symbol", *_cells(F.col("k"), False))


PAIR = """struct<chainId string, dexId string, pairAddress string, url string, priceUsd string, priceNative string, pairCreatedAt string, fdv double, marketCap double,
baseToken struct<symbol string, address string>, quoteToken struct<symbol string, address string>, liquidity struct<usd double>,
volume struct<m5 double, h1 double, h6 double, h24 double>, priceChange struct<h24 double>>"""


def pairs(payloads: DataFrame) -> DataFrame:
    """Every pair of a payload: {"pairs": [...]}, or {"pair": {...}} where there is no list."""
    got = F.from_json("payload", f"pairs array<{PAIR}>, pair {PAIR}")
    found = F.coalesce(got["pairs"], F.when(got["pair"].isNotNull(), F.array(got["pair"])))
    return payloads.select("vendor_symbol", F.explode(found).alias("p")).select("vendor_symbol", "p.*")


def snapshot_quality(price: Column, liquidity: Column) -> Column:
    """suspect without a finite price or without liquidity above 0."""
    ok = price.isNotNull() & ~F.isnan(price) & (F.abs(price) < float("inf")) & liquidity.isNotNull() & (liquidity > 0)
    return F.when(ok, "ok").otherwise("suspect")


def snapshots(payloads: DataFrame, polled_at: Column) -> DataFrame:
    price, usd = F.col("priceUsd").try_cast("double"), F.col("liquidity.usd")
    return pairs(payloads).select(
        F.lit("dexscreener").alias("source"), F.col("chainId").alias("chain_id"), F.col("dexId").alias("dex_id"), F.col("pairAddress").alias("pair_address"),
        F.col("baseToken.symbol").alias("base_symbol"), F.col("quoteToken.symbol").alias("quote_symbol"), F.col("baseToken.address").alias("base_address"), F.col("quoteToken.address").alias("quote_address"),
        price.alias("price_usd"), F.col("priceNative").try_cast("double").alias("price_native"), usd.alias("liquidity_usd"), *(F.col(f"volume.{x}").alias(f"volume_{x}") for x in ("m5", "h1", "h6", "h24")),
        F.col("priceChange.h24").alias("price_change_h24"), "fdv", F.col("marketCap").alias("market_cap"), instant(F.col("pairCreatedAt")).alias("pair_created_at"), polled_at.alias("polled_at_utc"),
        snapshot_quality(price, usd).alias("quality"), "url",
    )


def ranked_pairs(found: DataFrame) -> DataFrame:
    """For each query the pair of highest liquidity and the others in that order (ties by address).

    Alternatives are those of one query, a vendor page at most.
    """
    usd = F.coalesce("liquidity_usd", F.lit(0.0))
    listed = F.array_sort(F.collect_list(F.struct((-usd).alias("o"), "pair_address")))
    return found.groupBy("vendor_symbol").agg(listed.alias("l")).select("vendor_symbol", F.col("l")[0]["pair_address"].alias("best"), F.slice(F.col("l")["pair_address"], F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))).alias("alternatives"))


def bhavcopy_bars(table: DataFrame, day: str = "session_date") -> DataFrame:
    """Rows of the exchange's daily file read with its header, and their session date: series EQ, opening 09:15 in India, adjusted close as the close.

    An unknown header is an error: columns are not guessed.
    """
    plain = {"".join(ch for ch in c.lower() if ch.isalnum()): c for c in table.columns if c != day}
    bound = {role: next((plain[s] for s in spellings if s in plain), None) for role, spellings in BHAVCOPY_COLUMNS.items()}
    lacking = [role for role, c in bound.items() if c is None]
    if lacking:
        raise ValueError(f"columns changed; missing {', '.join(lacking)}; found {', '.join(sorted(plain))}")
    at = F.to_utc_timestamp(F.col(day).cast("timestamp") + F.expr("INTERVAL '09:15' HOUR TO MINUTE"), "Asia/Kolkata")
    text = lambda role: F.upper(F.trim(F.col(f"`{bound[role]}`")))
    rows = table.where(text("series") == "EQ").select(text("symbol").alias("vendor_symbol"), at.alias("ts"), *(F.col(f"`{bound[c]}`").try_cast("double").alias(c) for c in PRICES))
    return rows.dropna(subset=list(PRICES)).withColumn("adj_close", F.col("close"))


def top_by_liquidity(found: DataFrame, n: int = 1) -> DataFrame:
    w = Window.partitionBy("vendor_symbol").orderBy(F.col("liquidity_usd").desc_nulls_last(), "pair_address")
    return found.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")
