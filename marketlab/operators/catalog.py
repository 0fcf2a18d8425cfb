"""Instrument identifiers and vendor spellings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Index tickers that the vendor spells with a caret.
INDEX_TICKERS = ("IRX", "NDX")


def parsed_id(instrument_id: Column) -> Column:
    """struct(asset_class, venue, symbol) of KIND:venue:symbol; null for other text.  A symbol may hold colons."""
    parts = F.split(instrument_id, ":", 3)
    kind, venue, symbol = F.upper(F.get(parts, 0)), F.get(parts, 1), F.get(parts, 2)
    equity = kind == "EQ"
    cls = F.when(equity, "equity").when(kind == "CRYPTO", "crypto").when(kind == "DEX", "dex")
    made = F.struct(cls.alias("asset_class"), F.when(equity, F.upper(venue)).otherwise(F.lower(venue)).alias("venue"), F.when(equity, F.upper(symbol)).otherwise(symbol).alias("symbol"))
    return F.when((F.size(parts) == 3) & cls.isNotNull(), made)


def vendor_ticker(asset_class: Column, venue: Column, symbol: Column) -> Column:
    """The quote vendor's spelling: .NS for Indian equities, =X for currencies, a caret for indices."""
    big = F.upper(symbol)
    return (
        F.when(symbol.startswith("^"), symbol)
        .when(F.upper(venue) == "XNSE", F.when(big.endswith(".NS"), symbol).otherwise(F.concat(symbol, F.lit(".NS"))))
        .when(F.upper(venue) == "CCY", F.when(big.endswith("=X"), symbol).otherwise(F.concat(symbol, F.lit("=X"))))
        .when((asset_class == "equity") & big.isin(*INDEX_TICKERS), F.concat(F.lit("^"), big))
        .otherwise(symbol)
    )


def inferred_class(query: Column) -> Column:
    """The asset class that a bare query looks like: a pool's address or chain:address, a currency pair, else an equity."""
    big = F.upper(F.trim(query))
    pool = F.trim(query).rlike(r"^(?:[a-zA-Z0-9]+:)?0x[0-9a-fA-F]{40}$")
    pair = big.rlike(r"^[A-Z0-9]{2,10}[/-]?(?:USDT|USDC|BTC|ETH)$")
    return F.when(pool, "dex").when(pair, "crypto").otherwise("equity")


def resolve(queries: DataFrame, instruments: DataFrame) -> DataFrame:
    """queries (query) with instrument_id and how it was found: stored (an identifier), alias (one instrument's), parsed (written KIND:venue:symbol),
    made (an equity by its ticker), ambiguous (several instruments' alias) or null (unknown).

    Case and outer space do not count; the catalogue is joined by key, twice.
    """
    key = lambda c: F.lower(F.trim(c))
    stored = instruments.select(key(F.col("instrument_id")).alias("__q"), F.col("instrument_id").alias("__stored")).dropDuplicates(["__q"])
    names = instruments.select("instrument_id", F.explode("aliases").alias("a")).select(key(F.col("a")).alias("__q"), "instrument_id").distinct()
    names = names.groupBy("__q").agg(F.min("instrument_id").alias("__alias"), F.count("*").alias("__n"))
    rows = queries.withColumn("__q", key(F.col("query"))).join(stored, "__q", "left").join(names, "__q", "left")
    written = F.col("query").rlike(r"(?i)^\s*(EQ|CRYPTO|DEX):[^:]+:.+$")
    ticker = (inferred_class(F.col("query")) == "equity") & F.col("query").rlike(r"^\s*[A-Za-z^][A-Za-z0-9.^=-]{0,14}\s*$")
    made = F.concat(F.lit("EQ:XNAS:"), F.upper(F.trim("query")))
    how = F.when(F.col("__stored").isNotNull(), "stored").when(F.col("__n") > 1, "ambiguous").when(F.col("__alias").isNotNull(), "alias").when(written, "parsed").when(ticker, "made")
    found = F.when(how == "stored", F.col("__stored")).when(how == "alias", F.col("__alias")).when(how == "parsed", F.trim("query")).when(how == "made", made)
    return rows.withColumn("instrument_id", found).withColumn("how", how).drop("__q", "__stored", "__alias", "__n")
