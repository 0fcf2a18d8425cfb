"""As-of and alignment joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, time: str, value: str, *key: str) -> DataFrame:
    """left with the last known value of right at its time or before: one union and one window per key, no theta join.

    Without a key all quotes form one series; then only distinct stamps of the left side are sorted.
    """
    keys = [F.col(k) for k in key]
    stamps = left.select(*keys, time).distinct().withColumn("__side", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    quotes = right.select(*keys, time, F.lit(0).alias("__side"), value)
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = stamps.select(*keys, time, "__side", value).unionByName(quotes)
    filled = both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("__side = 1").drop("__side")
    return left.join(filled, [*key, time], "left")


def align(panel: DataFrame, names: int) -> DataFrame:
    """Rows at stamps that every name has: one count and a semi-join, not a join for each name."""
    full = panel.groupBy("ts_utc").agg(F.countDistinct("instrument_id").alias("n")).where(F.col("n") == names)
    return panel.join(full, "ts_utc", "left_semi")


def drop_dead_stamps(panel: DataFrame) -> DataFrame:
    """Rows at stamps where some name has a close."""
    live = panel.groupBy("ts_utc").agg(F.count("close").alias("n")).where("n > 0")
    return panel.join(live, "ts_utc", "left_semi")


def keep_latest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """One row for each key, the last by the order columns; an aggregate, so hot keys are reduced before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__r")).select(*key, *(F.col(f"__r.{c}").alias(c) for c in others)).select(*rows.columns)
