"""Vendor bars to stored bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlab.functions.windows import safe_div

#: A level slip is a tenfold error: this share of the neighbours' level, or its inverse.
SLIP_LOW, SLIP_HIGH = 0.07, 0.13
NEIGHBOURS, LEAST_ROWS = 5, 6


def finite(x: str) -> Column:
    c = F.col(x)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def ohlc_valid() -> Column:
    """All four finite, low at or below and high at or above open and close."""
    ok = finite("open") & finite("high") & finite("low") & finite("close")
    return ok & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))


def to_utc(time: str, kind: str, zone: str, asset_class: str) -> Column:
    """UTC from a vendor's clock: utc as is; naive_session in the venue's zone; session_date at 09:30 there for equities, else midnight."""
    at = F.col(time).cast("timestamp")
    open_ = F.date_trunc("day", at) + F.when(F.col(asset_class) == "equity", F.expr("INTERVAL '09:30' HOUR TO MINUTE")).otherwise(F.expr("INTERVAL '00:00' HOUR TO MINUTE"))
    return F.when(F.col(kind) == "utc", at).when(F.col(kind) == "naive_session", F.to_utc_timestamp(at, F.col(zone))).otherwise(F.to_utc_timestamp(open_, F.col(zone)))


def with_adj_close(bars: DataFrame) -> DataFrame:
    """A missing adjusted close is the close."""
    return bars.withColumn("adj_close", F.coalesce("adj_close", "close") if "adj_close" in bars.columns else F.col("close"))


def total_return(bars: DataFrame) -> DataFrame:
    """Prices scaled by adjusted over plain close where both are known and the close is not 0."""
    scale = F.when(finite("close") & (F.abs("close") > 1e-12) & F.col("adj_close").isNotNull(), safe_div(F.col("adj_close"), F.col("close"))).otherwise(1.0)
    bars = bars.withColumn("__k", scale)
    for c in ("open", "high", "low", "close"):
        bars = bars.withColumn(c, F.col(c) * F.col("__k"))
    return bars.drop("__k")


def repair_levels(bars: DataFrame) -> DataFrame:
    """Bars a tenth (or ten times) of both neighbouring levels are scaled back, the adjusted close with them, volume the other way.

    Looks five bars ahead by design, so it belongs to normalisation and to no strategy.
    """
    w = Window.partitionBy("instrument_id").orderBy("ts_utc")

    def middle(step) -> Column:
        known = F.array_sort(F.filter(F.array(*(step(k) for k in range(1, NEIGHBOURS + 1))), lambda x: x.isNotNull()))
        n = F.size(known)
        return F.when(n > 0, (F.get(known, ((n - 1) / 2).cast("int")) + F.get(known, (n / 2).cast("int"))) / 2)

    bars = bars.withColumn("__p", middle(lambda k: F.lag("close", k).over(w))).withColumn("__q", middle(lambda k: F.lead("close", k).over(w)))
    p, q = safe_div(F.col("close"), F.col("__p")), safe_div(F.col("close"), F.col("__q"))
    enough = F.count("*").over(Window.partitionBy("instrument_id")) >= LEAST_ROWS
    low = p.between(SLIP_LOW, SLIP_HIGH) & q.between(SLIP_LOW, SLIP_HIGH)
    high = p.between(1 / SLIP_HIGH, 1 / SLIP_LOW) & q.between(1 / SLIP_HIGH, 1 / SLIP_LOW)
    bars = bars.withColumn("__k", F.when(enough & low, 10.0).when(enough & high, 0.1).otherwise(1.0))
    for c in ("open", "high", "low", "close", *(["adj_close"] if "adj_close" in bars.columns else [])):
        bars = bars.withColumn(c, F.col(c) * F.col("__k"))
    return bars.withColumn("volume", F.col("volume") / F.col("__k")).drop("__p", "__q", "__k")


def normalize(rows: DataFrame, timeframe: str, now: str) -> DataFrame:
    """Rows of one timeframe, not beyond now and one interval, valid, the last page's row for each time; repaired.

    rows: instrument_id, timeframe, ts_utc, OHLCV, adj_close and page_seq.
    """
    from marketlab.operators.joins import keep_latest
    from marketlab.schema import TIMEFRAMES

    step = F.make_interval(mins=F.lit(TIMEFRAMES[timeframe]))
    kept = rows.where((F.col("timeframe") == timeframe) & (F.col("ts_utc") <= F.lit(now).cast("timestamp") + step) & ohlc_valid() & finite("volume"))
    kept = keep_latest(with_adj_close(kept), ["instrument_id", "ts_utc"], "page_seq").drop("page_seq")
    return repair_levels(kept).withColumn("is_partial", F.col("ts_utc") + step > F.lit(now).cast("timestamp"))
