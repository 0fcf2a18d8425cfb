"""Resampling and display-zone projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.schema import TIMEFRAMES


def with_local(bars: DataFrame, zone: str) -> DataFrame:
    """ts_local (wall clock) and utc_offset in minutes, which keeps a repeated hour apart."""
    local = F.from_utc_timestamp("ts_utc", zone)
    return bars.withColumn("ts_local", local.cast("timestamp_ntz")).withColumn("utc_offset", ((F.unix_micros(local) - F.unix_micros("ts_utc")) / 60_000_000).cast("int"))


def resample(bars: DataFrame, timeframe: str, zone: str = "UTC") -> DataFrame:
    """Coarser bars, labelled by their first bar's time, in buckets of the zone's wall clock.

    Of source, is_partial and quality, where bars have them, the last counts; with a zone other than UTC the bucket's wall clock (ts_local) and
    utc_offset in minutes come too.
    """
    minutes = TIMEFRAMES[timeframe]
    local = F.from_utc_timestamp("ts_utc", zone)
    day = F.date_trunc("day", local)
    bucket = day if minutes == 1440 else F.timestamp_micros(F.unix_micros(day) + F.floor((F.unix_micros(local) - F.unix_micros(day)) / (minutes * 60_000_000)).cast("long") * minutes * 60_000_000)
    offset = F.lit(0) if minutes == 1440 else ((F.unix_micros(local) - F.unix_micros("ts_utc")) / 60_000_000).cast("int")
    rows = bars.withColumn("__b", bucket).withColumn("__o", offset)
    last = [F.max_by(c, "ts_utc").alias(c) for c in ("source", "is_partial", "quality") if c in bars.columns]
    out = rows.groupBy("instrument_id", "__b", "__o").agg(
        F.min("ts_utc").alias("ts_utc"), F.min_by("open", "ts_utc").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts_utc").alias("close"), F.sum("volume").alias("volume"), *last
    )
    out = out.withColumn("timeframe", F.lit(timeframe))
    if zone != "UTC":
        start = F.to_utc_timestamp(F.col("__b"), zone)
        out = out.withColumn("ts_local", F.col("__b").cast("timestamp_ntz")).withColumn("utc_offset", F.when(F.lit(minutes == 1440), ((F.unix_micros("__b") - F.unix_micros(start)) / 60_000_000).cast("int")).otherwise(F.col("__o")))
    return out.drop("__b", "__o")
