"""Target weights.  Null holds, 0 exits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlab.functions.windows import by_time, mean, so_far

OUT = ("instrument_id", "ts_utc", "weight")


def price(panel: DataFrame) -> Column:
    """What signals compare: the adjusted close, or the close where there is none."""
    return F.coalesce("adj_close", "close") if "adj_close" in panel.columns else F.col("close")


def names_per_stamp(panel: DataFrame) -> DataFrame:
    """(instrument, time) is unique in a panel, so a count of rows counts names."""
    return panel.withColumn("n_names", F.count("*").over(Window.partitionBy("ts_utc")))


def buy_hold(panel: DataFrame) -> DataFrame:
    return names_per_stamp(panel).withColumn("weight", F.lit(1.0) / F.col("n_names")).select(*OUT)


def static(panel: DataFrame, weights: dict[str, float]) -> DataFrame:
    weight = F.lit(0.0)
    if weights:
        known = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
        weight = F.coalesce(F.try_element_at(known, F.col("instrument_id")), F.lit(0.0))
    return panel.withColumn("weight", weight).select(*OUT)


def sma_cross(panel: DataFrame, fast: int, slow: int, side: str = "long_short") -> DataFrame:
    """Plus or minus 1/N by the order of two means; a tie is 0, warm-up null."""
    rows = names_per_stamp(panel).withColumn("__f", mean("close", fast)).withColumn("__s", mean("close", slow))
    sign = F.when(F.col("__f") > F.col("__s"), 1.0).when(F.col("__f") < F.col("__s"), -1.0 if side == "long_short" else 0.0).when(F.col("__f") == F.col("__s"), 0.0)
    return rows.withColumn("weight", sign / F.col("n_names")).select(*OUT)


def periodic(panel: DataFrame, weights: dict[str, float], unit: str = "quarter") -> DataFrame:
    """Weights on the first stamp and at period ends, else null."""
    from marketlab.operators.calendar import period_ends

    stamps = panel.select("ts_utc").distinct()
    resets = period_ends(stamps, unit).select("ts_utc").unionByName(stamps.agg(F.min("ts_utc").alias("ts_utc"))).distinct().withColumn("__r", F.lit(True))
    rows = static(panel, weights).join(F.broadcast(resets), "ts_utc", "left")
    return rows.withColumn("weight", F.when(F.col("__r"), F.col("weight"))).select(*OUT)


def guard(panel: DataFrame, name: str, exit_n: int, enter_n: int, on: dict[str, float], off: dict[str, float], rise_bars: int = 0) -> DataFrame:
    """Two books by a latch on one name: below its exit mean off, above its entry mean (and a rising exit mean) on.

    A bar with both signals turns the latch over, one with neither keeps it; so the state is the last
    single signal (on at first), turned over as often as both came since: a window, not a loop.
    """
    g = panel.where(F.col("instrument_id") == name).select("instrument_id", "ts_utc", price(panel).alias("close"))
    g = g.withColumn("__x", mean("close", exit_n)).withColumn("__e", mean("close", enter_n))
    rising = F.col("__x") > F.lag("__x", rise_bars).over(by_time()) if rise_bars else F.lit(True)
    leave = F.coalesce(F.col("close") < F.col("__x"), F.lit(False))
    enter = F.coalesce((F.col("close") > F.col("__e")) & rising, F.lit(False))
    g = g.withColumn("__l", leave).withColumn("__i", enter)
    g = g.withColumn("__both", F.when(F.col("__l") & F.col("__i"), 1).otherwise(0)).withColumn("__const", F.when(F.col("__l") & ~F.col("__i"), False).when(F.col("__i") & ~F.col("__l"), True))
    g = g.withColumn("__group", F.count("__const").over(so_far()))
    turns = F.sum("__both").over(so_far("instrument_id", "__group"))
    state = F.coalesce(F.last("__const", ignorenulls=True).over(so_far()), F.lit(True)) != (turns % 2 == 1)
    g = g.select("ts_utc", state.alias("__on"))
    stamps = panel.select("ts_utc").distinct().join(g, "ts_utc", "left")
    w = Window.partitionBy(F.lit(0)).orderBy("ts_utc").rowsBetween(Window.unboundedPreceding, 0)
    stamps = stamps.withColumn("__on", F.coalesce(F.last("__on", ignorenulls=True).over(w), F.lit(True)))
    a, b = static(panel, on), static(panel, off).withColumnRenamed("weight", "__off")
    rows = a.join(b, ["instrument_id", "ts_utc"]).join(stamps, "ts_utc")
    return rows.withColumn("weight", F.when(F.col("__on"), F.col("weight")).otherwise(F.col("__off"))).select(*OUT)


def year_winner(panel: DataFrame, n: int, min_prints: int, zone: str = "Asia/Kolkata") -> DataFrame:
    """At each year end the n names of highest full-year return (of adjusted closes), equally weighted; ties by name.

    A name counts with ``min_prints`` closes at least, the first in the year's first month, the last on the year's last stamp.
    """
    from marketlab.operators.calendar import period_ends

    rows = panel.withColumn("close", price(panel)).where("close is not null").withColumn("__local", F.from_utc_timestamp("ts_utc", zone)).withColumn("period", F.to_date(F.date_trunc("year", "__local")))
    ends = period_ends(panel, "year", zone)
    year = rows.groupBy("instrument_id", "period").agg(
        F.min_by("close", "ts_utc").alias("first"), F.max_by("close", "ts_utc").alias("last"), F.count("*").alias("prints"), F.min("__local").alias("from"), F.max("ts_utc").alias("to")
    )
    year = year.join(F.broadcast(ends), "period").where((F.col("prints") >= min_prints) & (F.month("from") == 1) & (F.col("to") == F.col("ts_utc")) & (F.col("first") > 0))
    year = year.withColumn("ret", F.col("last") / F.col("first") - 1)
    rank = F.row_number().over(Window.partitionBy("ts_utc").orderBy(F.col("ret").desc(), "instrument_id"))
    won = year.withColumn("__k", rank).where(F.col("__k") <= n)
    won = won.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy("ts_utc"))).select("instrument_id", "ts_utc", "weight")
    some = won.select("ts_utc").distinct().withColumn("__any", F.lit(True))
    grid = panel.select("instrument_id", "ts_utc").join(F.broadcast(some), "ts_utc", "left").join(won, ["instrument_id", "ts_utc"], "left")
    return grid.withColumn("weight", F.when(F.col("__any"), F.coalesce("weight", F.lit(0.0)))).select(*OUT)


def trailing_winners(panel: DataFrame, n: int, min_prints: int, sleeves: DataFrame | None = None, zone: str = "Asia/Kolkata") -> DataFrame:
    """(ts_utc, sleeve, instrument_id) of the n best names at each quarter end, by return since the same quarter's end a year before.

    Both ends need a price (the first above 0) and ``min_prints`` prints from one to the other, both included.
    ``sleeves`` (sleeve, instrument_id, n) ranks each sleeve by itself with its own n.
    """
    from marketlab.operators.calendar import period_ends

    prints = panel.withColumn("close", price(panel)).where("close is not null").select("instrument_id", "ts_utc", "close", F.row_number().over(by_time()).alias("__n"))
    ends = period_ends(panel, "quarter", zone)
    spans = ends.join(ends.select(F.col("ts_utc").alias("__from"), F.add_months("period", 12).alias("period")), "period").select("ts_utc", "__from")
    start = prints.select("instrument_id", F.col("ts_utc").alias("__from"), F.col("close").alias("__a"), F.col("__n").alias("__na"))
    rows = prints.join(spans, "ts_utc").join(start, ["instrument_id", "__from"]).where((F.col("__a") > 0) & (F.col("__n") - F.col("__na") + 1 >= min_prints))
    rows = rows.withColumn("ret", F.col("close") / F.col("__a") - 1)
    rows = rows.withColumn("sleeve", F.lit("all")).withColumn("__most", F.lit(n)) if sleeves is None else rows.join(sleeves.withColumnRenamed("n", "__most"), "instrument_id")
    rank = F.row_number().over(Window.partitionBy("ts_utc", "sleeve").orderBy(F.col("ret").desc(), "instrument_id"))
    return rows.withColumn("__k", rank).where(F.col("__k") <= F.col("__most")).select("ts_utc", "sleeve", "instrument_id")


def winner_weights(panel: DataFrame, winners: DataFrame) -> DataFrame:
    """Equal shares of all places at a reset, 0 for the other names, null between; a name in two sleeves counts twice in the divisor and is held once."""
    places = winners.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy("ts_utc")))
    book = places.groupBy("ts_utc", "instrument_id").agg(F.first("weight").alias("weight"))
    resets = book.select("ts_utc").distinct().withColumn("__any", F.lit(True))
    rows = panel.select("instrument_id", "ts_utc").join(resets, "ts_utc", "left").join(book, ["instrument_id", "ts_utc"], "left")
    return rows.withColumn("weight", F.when(F.col("__any"), F.coalesce("weight", F.lit(0.0)))).select(*OUT)


def quarter_winner(panel: DataFrame, n: int, min_prints: int) -> DataFrame:
    return winner_weights(panel, trailing_winners(panel, n, min_prints))


def cap_mix(panel: DataFrame, sleeves: DataFrame, min_prints: int) -> DataFrame:
    return winner_weights(panel, trailing_winners(panel, 0, min_prints, sleeves))


def with_stop(panel: DataFrame, targets: DataFrame, bars: int) -> DataFrame:
    """Targets with an exit: between resets the first close of a held name under its mean of ``bars`` closes emits 0, once.

    The book of a reset is carried to each name's rows by a window, so the first breach is a minimum over (name, reset).
    """
    resets = targets.where("weight is not null").select("ts_utc").distinct().withColumn("__reset", F.col("ts_utc"))
    rows = panel.withColumn("__mean", mean("close", bars)).select("instrument_id", "ts_utc", "close", "__mean").join(targets, ["instrument_id", "ts_utc"], "left")
    stamps = Window.partitionBy(F.lit(0)).orderBy("ts_utc").rowsBetween(Window.unboundedPreceding, 0)
    clock = panel.select("ts_utc").distinct().join(resets, "ts_utc", "left").withColumn("__reset", F.last("__reset", ignorenulls=True).over(stamps))
    rows = rows.join(clock, "ts_utc")
    # a name without a row at the reset is held all the same where it won, so winners are joined by reset
    held = targets.where("weight > 0").select("instrument_id", F.col("ts_utc").alias("__reset"), F.lit(True).alias("__held"))
    rows = rows.join(held, ["instrument_id", "__reset"], "left")
    breach = F.col("__held") & (F.col("ts_utc") > F.col("__reset")) & (F.col("close") < F.col("__mean"))
    first = F.min(F.when(breach, F.col("ts_utc"))).over(Window.partitionBy("instrument_id", "__reset"))
    return rows.withColumn("weight", F.when(F.col("ts_utc") == first, 0.0).otherwise(F.col("weight"))).select(*OUT)
