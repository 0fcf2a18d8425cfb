"""Problems of a series: gaps, flags and spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlab.functions.windows import by_time, median

SPIKE_RATIO, SPIKE_ROWS, SPIKE_LEAST = 8.0, 21, 5


def expected_opens(windows: DataFrame, minutes: int) -> DataFrame:
    """Each bar open before the end of the half-open windows (instrument_id, start_utc, end_utc); the last bar of a window may be short."""
    opens = F.expr(f"sequence(start_utc, end_utc - INTERVAL '0.000001' SECOND, INTERVAL '{minutes}' MINUTE)")
    return windows.where(F.col("start_utc") < F.col("end_utc")).select("instrument_id", F.explode(opens).alias("ts_utc"))


def missing_opens(bars: DataFrame, windows: DataFrame, minutes: int) -> DataFrame:
    return expected_opens(windows, minutes).join(bars.select("instrument_id", "ts_utc"), ["instrument_id", "ts_utc"], "left_anti")


def gap_spans(missing: DataFrame, minutes: int) -> DataFrame:
    """Adjacent missing opens as spans; the end is exclusive."""
    step = F.make_interval(mins=F.lit(minutes))
    prior = F.lag("ts_utc").over(by_time())
    rows = missing.withColumn("__new", F.when(prior.isNull() | (F.col("ts_utc") != prior + step), 1).otherwise(0))
    rows = rows.withColumn("__span", F.sum("__new").over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("instrument_id", "__span").agg(F.min("ts_utc").alias("ts_utc"), (F.max("ts_utc") + step).alias("end_utc"), F.count("*").alias("n_missing")).drop("__span")


def point_flags(bars: DataFrame) -> DataFrame:
    """suspect, partial and zero_volume, one row for each flag of a bar."""
    kinds = F.array(F.when(F.col("quality") == "suspect", "suspect"), F.when(F.col("is_partial"), "partial"), F.when(F.col("volume") <= 0, "zero_volume"))
    return bars.select("instrument_id", "ts_utc", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


def spikes(bars: DataFrame) -> DataFrame:
    """Bars whose range exceeds 8 times its rolling median, where that is above 0, in series of 21 rows or more."""
    rows = bars.withColumn("__r", F.col("high") - F.col("low")).withColumn("__n", F.count("*").over(Window.partitionBy("instrument_id")))
    rows = rows.withColumn("__m", median("__r", SPIKE_ROWS, SPIKE_LEAST))
    return rows.where((F.col("__n") >= SPIKE_ROWS) & (F.col("__m") > 0) & (F.col("__r") > F.col("__m") * SPIKE_RATIO)).select("instrument_id", "ts_utc", F.lit("spike").alias("kind"))


def find_problems(bars: DataFrame, windows: DataFrame, minutes: int) -> DataFrame:
    """kind, ts_utc and end_utc of every problem."""
    gaps = gap_spans(missing_opens(bars, windows, minutes), minutes).select("instrument_id", F.lit("gap").alias("kind"), "ts_utc", "end_utc")
    none = F.lit(None).cast("timestamp").alias("end_utc")
    points = point_flags(bars).unionByName(spikes(bars)).select("instrument_id", "kind", "ts_utc", none)
    return gaps.unionByName(points)
