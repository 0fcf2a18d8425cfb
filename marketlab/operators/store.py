"""Stored tables as Parquet folders: bars, coverage, snapshots and instruments.

One writer appends; readers keep the latest row of each key.  Deleted months are tombstones that hide what
was written before them, so nothing is rewritten in place and a failed job leaves the tables as they were.
"""

from __future__ import annotations

import time
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.operators import intervals, joins
from marketlab.operators.normalize import with_adj_close
from marketlab.schema import BAR, COVERAGE, INSTRUMENT, SNAPSHOT, missing

BAR_KEY = ["instrument_id", "source", "timeframe", "ts_utc"]
SERIES = ["instrument_id", "timeframe", "source"]
COARSE = ("1h", "1d")


def one_batch(rows: DataFrame) -> DataFrame:
    """A batch with one row for each instrument, timeframe and time: the last source by name wins."""
    return joins.keep_latest(rows, ["instrument_id", "timeframe", "ts_utc"], "source")


def latest_poll(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("instrument_id", "source").agg(F.max("polled_at").alias("polled_at"))


def by_alias(instruments: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (alias) with the instrument that has it; case and outer space do not count."""
    key = F.lower(F.trim(F.col("alias")))
    names = instruments.select("instrument_id", F.explode("aliases").alias("alias")).select("instrument_id", key.alias("__k")).distinct()
    return wanted.withColumn("__k", key).join(names, "__k", "left").drop("__k")


def prune_candidates(bars: DataFrame, coverage: DataFrame, cutoff: datetime) -> DataFrame:
    """Months of one-minute bars with rows before the cutoff, of series that coarser coverage stands in for, and how many such rows."""
    old = bars.where((F.col("timeframe") == "1m") & (F.col("ts_utc") < F.lit(cutoff)))
    months = old.groupBy("instrument_id", "source", F.date_format("ts_utc", "yyyyMM").alias("ym")).agg(F.count("*").alias("n"))
    coarse = coverage.where(F.col("timeframe").isin(*COARSE)).select("instrument_id", "source").distinct()
    return months.join(coarse, ["instrument_id", "source"], "left_semi")


class Store:
    """Tables under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._tables = {
            "bars": (", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BAR) + ", ingest_seq long, ym string", ("timeframe", "ym")),
            "dropped": ("instrument_id string, source string, timeframe string, ym string, dropped_seq long", ()),
            "snapshots": (SNAPSHOT, ()),
            "instruments": (", ".join(f"{f.name} {f.dataType.simpleString()}" for f in INSTRUMENT) + ", put_seq long", ()),
            "coverage": (", ".join(f"{f.name} {f.dataType.simpleString()}" for f in COVERAGE) + ", version long", ("version",)),
        }
        for name, (schema, parts) in self._tables.items():
            spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*parts).parquet(f"{self.root}/{name}")
        self._seq = 0

    def _next(self) -> int:
        self._seq = max(self._seq + 1, time.time_ns())
        return self._seq

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._tables[name][0]).parquet(f"{self.root}/{name}")

    def write_bars(self, rows: DataFrame) -> None:
        lacking = missing(BAR, rows.columns)
        if lacking:
            raise ValueError(f"bars lack {', '.join(lacking)}")
        out = one_batch(with_adj_close(rows).select(*BAR.fieldNames())).withColumn("ingest_seq", F.lit(self._next())).withColumn("ym", F.date_format("ts_utc", "yyyyMM"))
        # a large month is split over tasks and files by its size, a small one is one file; sorted rows let readers skip row groups by name
        out = out.hint("rebalance", F.col("timeframe"), F.col("ym")).sortWithinPartitions("timeframe", "ym", "instrument_id", "ts_utc")
        out.write.mode("append").partitionBy("timeframe", "ym").parquet(f"{self.root}/bars")

    def bars(self) -> DataFrame:
        """All current rows; the timeframe and month are partitions, so filters on them prune files."""
        gone = self._read("dropped").groupBy("instrument_id", "source", "timeframe", "ym").agg(F.max("dropped_seq").alias("dropped_seq"))
        rows = joins.keep_latest(self._read("bars"), [*BAR_KEY, "ym"], "ingest_seq").join(gone, ["instrument_id", "source", "timeframe", "ym"], "left")
        return rows.where(F.col("dropped_seq").isNull() | (F.col("ingest_seq") > F.col("dropped_seq"))).drop("dropped_seq")

    def scan(self, instrument_id: str, timeframe: str, start: datetime, end: datetime, columns: list[str] | None = None, source: str | None = None) -> DataFrame:
        """Rows of one series from start to end, both included, by time; the time is always among the columns and unknown names are left out."""
        rows = self.bars().where((F.col("instrument_id") == instrument_id) & (F.col("timeframe") == timeframe) & F.col("ts_utc").between(F.lit(start), F.lit(end)))
        rows = rows.where(F.col("ym").between(f"{start:%Y%m}", f"{end:%Y%m}"))
        if source:
            rows = rows.where(F.col("source") == source)
        names = BAR.fieldNames() if columns is None else ["ts_utc", *(c for c in columns if c in BAR.fieldNames() and c != "ts_utc")]
        return rows.select(*names).orderBy("ts_utc")

    def write_snapshots(self, rows: DataFrame) -> None:
        """Append polled pairs: the known columns that rows have, the others null."""
        have = [c.split()[0] for c in SNAPSHOT.split(", ") if c.split()[0] in rows.columns]
        if not have:
            raise ValueError("no snapshot column")
        kinds = dict(c.split() for c in SNAPSHOT.split(", "))
        rows.select(*(F.col(c).cast(kinds[c]) if c in have else F.lit(None).cast(kinds[c]).alias(c) for c in kinds)).write.mode("append").parquet(f"{self.root}/snapshots")

    def polls(self) -> DataFrame:
        """The latest poll of each pair and source."""
        rows = self._read("snapshots").where("chain_id is not null and pair_address is not null and polled_at_utc is not null")
        return latest_poll(rows.select(F.concat_ws(":", F.lit("DEX"), "chain_id", "pair_address").alias("instrument_id"), "source", F.col("polled_at_utc").alias("polled_at")))

    def put_instruments(self, rows: DataFrame) -> None:
        """Add instruments or replace those with the same identifier."""
        rows.select(*INSTRUMENT.fieldNames(), F.lit(self._next()).alias("put_seq")).write.mode("append").parquet(f"{self.root}/instruments")

    def instruments(self) -> DataFrame:
        return joins.keep_latest(self._read("instruments"), ["instrument_id"], "put_seq").drop("put_seq")

    def truncate(self) -> None:
        """Empty every table."""
        for name, (schema, parts) in self._tables.items():
            self.spark.createDataFrame([], schema).write.mode("overwrite").partitionBy(*parts).parquet(f"{self.root}/{name}")

    def coverage(self, instrument_id: str | None = None, timeframe: str | None = None, source: str | None = None) -> DataFrame:
        """The newest version of the coverage table, by series and start."""
        rows = self._read("coverage")
        last = rows.agg(F.max("version")).first()[0]
        rows = rows.where(F.col("version") == F.lit(last)).drop("version")
        for c, v in (("instrument_id", instrument_id), ("timeframe", timeframe), ("source", source)):
            rows = rows if v is None else rows.where(F.col(c) == v)
        return rows.orderBy(*SERIES, "start_utc")

    def _put_coverage(self, rows: DataFrame) -> None:
        names = COVERAGE.fieldNames()
        rows.select(*names).withColumn("version", F.lit(self._next())).write.mode("append").partitionBy("version").parquet(f"{self.root}/coverage")

    def add_coverage(self, ranges: DataFrame) -> None:
        """Join inclusive ranges to the table; what touches within a microsecond becomes one range."""
        both = self.coverage().unionByName(ranges.select(*COVERAGE.fieldNames()))
        self._put_coverage(intervals.merge(both, *SERIES))

    def drop_coverage(self, cuts: DataFrame) -> None:
        """Take inclusive cuts (series, cut_start, cut_end) out; several cuts of a series at one go must not overlap its same range."""
        self._put_coverage(intervals.subtract(self.coverage(), cuts, *SERIES))

    def prune_hot(self, hot_days: int, now: datetime) -> int:
        """Hide whole months of one-minute bars older than ``hot_days`` where coarser coverage exists; the number of rows before the cutoff."""
        found = prune_candidates(self.bars(), self.coverage(), now - timedelta(days=hot_days))
        seq = self._next()
        marks = found.select("instrument_id", "source", F.lit("1m").alias("timeframe"), "ym", F.lit(seq).alias("dropped_seq"), "n")
        total = marks.agg(F.sum("n")).first()[0] or 0
        if total:
            marks.drop("n").write.mode("append").parquet(f"{self.root}/dropped")
            months = self._read("dropped").where(F.col("dropped_seq") == seq).select("ym").distinct().orderBy("ym").collect()
            for (ym,) in months:
                first = F.to_timestamp(F.concat(F.col("ym"), F.lit("01")), "yyyyMMdd")
                cut = self._read("dropped").where((F.col("dropped_seq") == seq) & (F.col("ym") == ym))
                self.drop_coverage(cut.select(*SERIES, first.alias("cut_start"), (F.add_months(first, 1).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")).alias("cut_end")))
        return total
