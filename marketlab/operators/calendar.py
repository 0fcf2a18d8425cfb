"""Exchange calendars as a dimension table, decision grids and period ends.

Sessions come from rules: weekdays less the venue's holidays.  The New York list has the exchange's regular
full-day holidays and its early closes by rule, and its one-off closures since 1990; the Indian list is given to ``sessions`` as data.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def easter(year: int) -> date:
    """Western Easter Sunday (the anonymous Gregorian computus)."""
    a, b, c = year % 19, year // 100, year % 100
    d = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    e = (32 + 2 * (b % 4) + 2 * (c // 4) - d - c % 4) % 7
    f = d + e - 7 * ((a + 11 * d + 22 * e) // 451) + 114
    return date(year, f // 31, f % 31 + 1)


def nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th (from 1; -1: the last) given weekday (Monday: 0) of a month."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def nyse_holidays(year: int) -> set[date]:
    """Regular full-day holidays; fixed dates move from Sunday to Monday and from Saturday to Friday (New Year's Day does not)."""

    def observed(day: date) -> date:
        return day + timedelta({5: -1, 6: 1}.get(day.weekday(), 0))

    out = {nth_weekday(year, 2, 0, 3), easter(year) - timedelta(2), nth_weekday(year, 5, 0, -1), observed(date(year, 7, 4)), nth_weekday(year, 9, 0, 1), nth_weekday(year, 11, 3, 4), observed(date(year, 12, 25))}
    if date(year, 1, 1).weekday() != 5:
        out.add(observed(date(year, 1, 1)))
    if year >= 1998:
        out.add(nth_weekday(year, 1, 0, 3))
    if year >= 2022:
        out.add(observed(date(year, 6, 19)))
    return out


#: One-off full-day closures of the New York exchange since 1990.
CLOSURES = (
    date(1994, 4, 27), date(2001, 9, 11), date(2001, 9, 12), date(2001, 9, 13), date(2001, 9, 14), date(2004, 6, 11),
    date(2007, 1, 2), date(2012, 10, 29), date(2012, 10, 30), date(2018, 12, 5), date(2025, 1, 9),
)


def nyse_early_closes(year: int) -> set[date]:
    """Sessions that end at 13:00: the day after Thanksgiving, 24 December, and 3 July, where these are sessions (3 July from Monday to Thursday, and Christmas Eve not on Friday)."""
    out = {nth_weekday(year, 11, 3, 4) + timedelta(1)}
    out |= {d for d in (date(year, 7, 3), date(year, 12, 24)) if d.weekday() < 4}
    return out - nyse_holidays(year)


def sessions(spark: SparkSession, first: date, last: date, holidays: set[date] | None = None) -> DataFrame:
    """session_date of every weekday that is no holiday; the default list is New York's."""
    if holidays is None:
        holidays = set().union(CLOSURES, *(nyse_holidays(y) for y in range(first.year, last.year + 1)))
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS session_date").where(F.weekday("session_date") < 5)
    off = spark.createDataFrame([(d,) for d in sorted(holidays)], "session_date date") if holidays else None
    return days.join(F.broadcast(off), "session_date", "left_anti") if off is not None else days


def decision_grid(days: DataFrame, zone: str, open_: str, close: str) -> DataFrame:
    """open_utc and decision_ts of each session on a fixed clock, early closes included."""

    def at(clock: str):
        return F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format("session_date", "yyyy-MM-dd"), F.lit(f" {clock}:00"))), zone)

    return days.select("session_date", at(open_).alias("open_utc"), at(close).alias("decision_ts"))


def nyse_grid(days: DataFrame) -> DataFrame:
    return decision_grid(days, "America/New_York", "09:30", "16:00")


def nyse_hours(days: DataFrame, first: int, last: int) -> DataFrame:
    """exchange, session_date, open_utc and close_utc of New York sessions in the years from first to last; early closes are at 13:00."""
    early = sorted(set().union(*(nyse_early_closes(y) for y in range(first, last + 1))))
    whole, short = (decision_grid(days, "America/New_York", "09:30", c) for c in ("16:00", "13:00"))
    # bounded: three dates a year
    is_early = F.col("session_date").isin(early)
    both = whole.where(~is_early).unionByName(short.where(is_early))
    return both.select(F.lit("XNYS").alias("exchange"), "session_date", "open_utc", F.col("decision_ts").alias("close_utc"))


def nse_grid(days: DataFrame) -> DataFrame:
    return decision_grid(days, "Asia/Kolkata", "09:15", "15:30")


def session_flags(panel: DataFrame, holidays: DataFrame, exchange: str = "calendar") -> DataFrame:
    """is_session: names on the New York calendar by UTC weekday and holiday, all others always."""
    days = holidays.select(F.col("session_date").alias("__d"), F.lit(True).alias("__off"))
    rows = panel.withColumn("__d", F.to_date("ts_utc")).join(F.broadcast(days), "__d", "left")
    ok = (F.weekday("__d") < 5) & F.col("__off").isNull()
    return rows.withColumn("is_session", F.when(F.col(exchange) == "NYSE", ok).otherwise(F.lit(True))).drop("__d", "__off")


def period_ends(stamps: DataFrame, unit: str, zone: str = "America/New_York") -> DataFrame:
    """Distinct stamps whose next one lies in another period of the zone; the last stamp never ends a period."""
    w = Window.partitionBy(F.lit(0)).orderBy("ts_utc")
    rows = stamps.select("ts_utc").distinct().withColumn("period", F.to_date(F.date_trunc(unit, F.from_utc_timestamp("ts_utc", zone))))
    return rows.withColumn("__n", F.lead("period").over(w)).where("__n <> period").select("ts_utc", "period")


def session_windows(names: DataFrame, days: DataFrame, start, end, timeframe: str, extended: bool = False) -> DataFrame:
    """Half-open UTC ranges from start up to end in which each name (instrument_id, asset_class, venue) should have bars.

    Crypto, pool and currency names: the whole range.  Others: their exchange's sessions in ``days`` (exchange, session_date,
    open_utc, close_utc), clipped; Indian names use XNSE, the rest XNYS.  A daily bar stands for the day from its open and is
    kept where the open lies in the range.  Extended New York sessions open at 04:00 and close with the regular session, as late as 20:00.
    """
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    always = F.col("asset_class").isin("crypto", "dex") | (F.upper("venue") == "CCY")
    whole = names.where(always).select("instrument_id", a.alias("start_utc"), b.alias("end_utc"))
    listed = names.where(~always).withColumn("exchange", F.when(F.upper("venue") == "XNSE", "XNSE").otherwise("XNYS")).join(days, "exchange")
    if extended:

        def clock(at: str):
            return F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format("session_date", "yyyy-MM-dd"), F.lit(f" {at}:00"))), "America/New_York")

        here = F.col("exchange") == "XNYS"
        listed = listed.withColumn("open_utc", F.when(here, clock("04:00")).otherwise(F.col("open_utc"))).withColumn("close_utc", F.when(here, F.least(clock("20:00"), "close_utc")).otherwise(F.col("close_utc")))
    if timeframe == "1d":
        listed = listed.where((F.col("open_utc") >= a) & (F.col("open_utc") < b)).select("instrument_id", F.col("open_utc").alias("start_utc"), (F.col("open_utc") + F.expr("INTERVAL 1 DAY")).alias("end_utc"))
    else:
        listed = listed.select("instrument_id", F.greatest("open_utc", a).alias("start_utc"), F.least("close_utc", b).alias("end_utc"))
    return whole.unionByName(listed).where("start_utc < end_utc")
