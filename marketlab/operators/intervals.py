"""Interval algebra over coverage and sessions, as gaps-and-islands windows and equi-joins.

Coverage ranges are inclusive at both ends; holes and session windows are half-open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def micro():
    return F.make_interval(secs=F.lit("0.000001").cast("decimal(18,6)"))


def merge(rows: DataFrame, *key: str, start: str = "start_utc", end: str = "end_utc", touch_micro: bool = True) -> DataFrame:
    """Union of ranges per key: a range joins the last when it starts at its end (plus 1 microsecond) or before."""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) > (reach + micro() if touch_micro else reach)
    rows = rows.withColumn("__new", F.when(reach.isNull() | apart, 1).otherwise(0))
    rows = rows.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def subtract(rows: DataFrame, cut: DataFrame, *key: str) -> DataFrame:
    """Inclusive ranges less one inclusive cut per key (cut_start, cut_end); what is left on either side stays."""
    rows = rows.join(cut, list(key), "left")
    meets = F.col("cut_start").isNotNull() & (F.col("start_utc") <= F.col("cut_end")) & (F.col("end_utc") >= F.col("cut_start"))
    whole = F.struct(F.col("start_utc").alias("s"), F.col("end_utc").alias("e"))
    left = F.when(F.col("start_utc") < F.col("cut_start"), F.struct(F.col("start_utc").alias("s"), (F.col("cut_start") - micro()).alias("e")))
    right = F.when(F.col("end_utc") > F.col("cut_end"), F.struct((F.col("cut_end") + micro()).alias("s"), F.col("end_utc").alias("e")))
    parts = F.when(meets, F.filter(F.array(left, right), lambda x: x.isNotNull())).otherwise(F.array(whole))
    return rows.withColumn("p", F.explode(parts)).select(*key, F.col("p.s").alias("start_utc"), F.col("p.e").alias("end_utc"))


def holes(coverage: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """Half-open parts of wanted (want_start, want_end per key) that inclusive coverage leaves open."""
    merged = merge(coverage, *key)
    rows = wanted.join(merged, list(key), "left")
    rows = rows.withColumn("__s", F.greatest("start_utc", "want_start")).withColumn("__e", F.least(F.col("end_utc") + micro(), "want_end"))
    meets = (F.col("start_utc") < F.col("want_end")) & (F.col("end_utc") >= F.col("want_start"))
    rows = rows.withColumn("__s", F.when(meets, F.col("__s"))).withColumn("__e", F.when(meets, F.col("__e")))
    w = Window.partitionBy(*key, "want_start", "want_end").orderBy(F.col("__s").asc_nulls_last())
    rows = rows.withColumn("__next", F.lead("__s").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    gap = lambda a, b: F.when(a < b, F.struct(a.alias("s"), b.alias("e")))
    head = F.when(F.col("__first"), gap(F.col("want_start"), F.coalesce("__s", "want_end")))
    tail = F.when(F.col("__e").isNotNull(), gap(F.col("__e"), F.coalesce("__next", "want_end")))
    rows = rows.withColumn("p", F.explode(F.filter(F.array(head, tail), lambda x: x.isNotNull())))
    return rows.select(*key, F.col("p.s").alias("start_utc"), F.col("p.e").alias("end_utc"))


def overlap(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """Intersections of half-open ranges (a_start, a_end) and (b_start, b_end) that meet, by key and day.

    Ranges are dealt by the days they touch, so the join is an equi-join and not a nested loop.
    """

    def by_day(rows: DataFrame, s: str, e: str) -> DataFrame:
        return rows.withColumn("__day", F.explode(F.sequence(F.to_date(s), F.to_date(F.col(e) - micro()))))

    a, b = a.where("a_start < a_end"), b.where("b_start < b_end")
    on = [*key, "__day"]
    rows = by_day(a, "a_start", "a_end").join(by_day(b, "b_start", "b_end"), on)
    rows = rows.where("a_start < b_end AND b_start < a_end").withColumn("start_utc", F.greatest("a_start", "b_start")).withColumn("end_utc", F.least("a_end", "b_end"))
    # a pair meets on each day of its intersection; its first day stands for it
    return rows.where(F.to_date("start_utc") == F.col("__day")).drop("__day")
