"""Streams: ticks to bars under a watermark, and micro-batches into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketlab.operators.store import Store


def tick_bars(ticks: DataFrame, timeframe: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of (instrument_id, ts, price, seq) in UTC buckets; ticks later than the watermark are not counted.

    The state is one row for each instrument and open bucket, whatever the number of ticks.
    """
    at = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("instrument_id", F.window("ts", timeframe).alias("__w"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").cast("double").alias("volume"))
        .select("instrument_id", F.col("__w.start").alias("ts_utc"), "open", "high", "low", "close", "volume")
    )


def upsert_bars(bars: DataFrame, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append every micro-batch of stored-shape bars; a later row of a key replaces the earlier on read, however late, so a batch run twice changes nothing."""
    writer = bars.writeStream.foreachBatch(lambda batch, _: store.write_bars(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
