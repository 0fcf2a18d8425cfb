"""Panels: metadata, session sampling, currency and cash overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlab.operators import calendar, joins
from marketlab.operators.normalize import total_return, with_adj_close

OHLC = ("open", "high", "low", "close")


def with_metadata(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """Columns of the universe (one row for each instrument) beside the bars; the planner picks the join by size."""
    return panel.join(universe, "instrument_id", "left")


def sample_daily(daily: DataFrame, grid: DataFrame, zone: str | Column = "America/New_York") -> DataFrame:
    """Each instrument's daily bar at each session's decision time, by the venue's local date (a zone or a column of zones); a session without one has null prices.

    Every (instrument, session) is a row of the result, so the grid, a row for each session, is crossed with the names on purpose and broadcast to them.
    """
    names = daily.select("instrument_id").distinct()
    own = daily.withColumn("session_date", F.to_date(F.from_utc_timestamp("ts_utc", zone))).drop("ts_utc")
    wanted = grid.select("session_date", F.col("decision_ts").alias("ts_utc"))
    return names.crossJoin(F.broadcast(wanted)).join(own, ["instrument_id", "session_date"], "left")


def sample_hourly(hours: DataFrame, grid: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """One bar for each instrument and session from the hours that end after its open and by its decision time."""
    rows = hours.withColumn("session_date", F.to_date(F.from_utc_timestamp("ts_utc", zone))).withColumn("__end", F.col("ts_utc") + F.expr("INTERVAL 1 HOUR"))
    rows = rows.join(grid, "session_date").where((F.col("__end") > F.col("open_utc")) & (F.col("__end") <= F.col("decision_ts")))
    more = [F.max_by("adj_close", "ts_utc").alias("adj_close")] if "adj_close" in hours.columns else []
    return rows.groupBy("instrument_id", "session_date").agg(
        F.first("decision_ts").alias("__at"), F.min_by("open", "ts_utc").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts_utc").alias("close"), F.sum("volume").alias("volume"), *more
    ).withColumnRenamed("__at", "ts_utc")


def to_base(panel: DataFrame, quotes: DataFrame, base: str, currency: str = "currency") -> DataFrame:
    """Prices of names in another currency divided by the last quote (ts_utc, fx) where there is one other than 0."""
    rows = joins.asof_backward(panel, quotes, "ts_utc", "fx")
    foreign = (F.col(currency) != base) & F.col("fx").isNotNull() & (F.col("fx") != 0)
    for c in (*OHLC, "adj_close"):
        if c in panel.columns:
            rows = rows.withColumn(c, F.when(foreign, F.try_divide(c, "fx")).otherwise(F.col(c)))
    return rows.drop("fx")


def period_cash(stamps: DataFrame) -> DataFrame:
    """daily_tbill: the rate for a day (tbill_per_day) times the days since the last stamp; the first stamp earns nothing."""
    w = Window.partitionBy(F.lit(0)).orderBy("ts_utc")
    days = (F.unix_micros("ts_utc") - F.unix_micros(F.lag("ts_utc").over(w))) / 86_400_000_000
    return stamps.select("ts_utc", (F.coalesce("tbill_per_day", F.lit(0.0)) * F.coalesce(days, F.lit(0.0))).alias("daily_tbill"))


def with_cash(panel: DataFrame, yields: DataFrame, percent: float = 100.0, year: float = 365.0) -> DataFrame:
    """Panel with daily_tbill from the last known yearly yield in percent (ts_utc, close) at each stamp."""
    rates = yields.select("ts_utc", (F.col("close") / percent / year).alias("tbill_per_day"))
    stamps = joins.asof_backward(panel.select("ts_utc").distinct(), rates, "ts_utc", "tbill_per_day")
    return panel.join(period_cash(stamps), "ts_utc", "left").fillna({"daily_tbill": 0.0})


def native_panel(bars: DataFrame, universe: DataFrame, names: int, holidays: DataFrame, quotes: DataFrame | None = None, base: str = "USD", yields: DataFrame | None = None, scale: bool = False) -> DataFrame:
    """Bars at stamps that all names have, with metadata (currency, calendar), in the base currency, with session flags, cash and total-return prices."""
    rows = with_metadata(joins.align(with_adj_close(bars), names), universe)
    rows = to_base(rows, quotes, base) if quotes is not None else rows
    rows = calendar.session_flags(rows, holidays)
    rows = with_cash(rows, yields) if yields is not None else rows.withColumn("daily_tbill", F.lit(0.0))
    return total_return(rows) if scale else rows


def session_panel(daily: DataFrame, universe: DataFrame, grid: DataFrame, quotes: DataFrame | None = None, base: str = "USD", yields: DataFrame | None = None, scale: bool = False) -> DataFrame:
    """Daily bars at the decision times of a grid, by each venue's own date (calendar NSE: India's), with the steps of ``native_panel``.

    A name without a bar keeps a row with null prices; decision times at which no name has a close go.  Every row is a session.
    """
    zones = universe.select("instrument_id", F.when(F.col("calendar") == "NSE", "Asia/Kolkata").otherwise("America/New_York").alias("__zone"))
    rows = sample_daily(with_adj_close(daily).join(zones, "instrument_id"), grid, F.col("__zone")).drop("__zone")
    rows = with_metadata(joins.drop_dead_stamps(rows), universe)
    rows = to_base(rows, quotes, base) if quotes is not None else rows
    rows = rows.withColumn("is_session", F.lit(True))
    rows = with_cash(rows, yields) if yields is not None else rows.withColumn("daily_tbill", F.lit(0.0))
    return total_return(rows) if scale else rows
