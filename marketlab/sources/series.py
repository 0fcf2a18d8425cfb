"""Bar series derived from event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ohlcv(rows: DataFrame, key: str, time: str, price: str, order: str, unit: str) -> DataFrame:
    """Bars per key and time unit: one shuffle, with everything pre-aggregated before it."""
    at = F.struct(time, order)
    out = rows.groupBy(F.col(key).alias("instrument_id"), F.date_trunc(unit, F.col(time).cast("timestamp")).alias("ts_utc")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return out


def bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Bars of each event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id", "value")
    return ohlcv(events, "event_type", "ts", "value", "event_id", unit)


def px_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices, one series for each order priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")
    return ohlcv(orders, "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", "day")


def px_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily open and close as half-day means of event values; a half without events is null."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value")
    morning = F.hour("ts") < 12
    return events.groupBy(F.col("event_type").alias("instrument_id"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts_utc")).agg(
        F.avg(F.when(morning, F.col("value"))).alias("open"), F.avg(F.when(~morning, F.col("value"))).alias("close")
    )


BARS_SQL = """SELECT event_type AS instrument_id, date_trunc('{unit}', ts) AS ts_utc, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2"""
PX_DAILY_SQL = """SELECT o_orderpriority AS instrument_id, date_trunc('day', o_orderdate) AS ts_utc, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2"""
PX_SMOOTH_SQL = """SELECT event_type AS instrument_id, date_trunc('day', ts) AS ts_utc, avg(value) FILTER (WHERE hour(ts) < 12) AS open, avg(value) FILTER (WHERE hour(ts) >= 12) AS close
  FROM events GROUP BY 1, 2"""
