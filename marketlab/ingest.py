"""The ingest loop: what coverage lacks is fetched page by page, normalised, appended, and then counts as covered.

A source is an object with ``name``, ``pages(instrument_id, timeframe, start, end)``, which yields frames of vendor bars
(``ROWS``) from start to end, both included as coverage is, and ``truncated()``, whether its last answer was cut short.  Progress is the coverage table and nothing else: a request
that is covered fetches nothing, and one that failed half way starts at what is still open.  The loop runs over ranges and
pages on the driver; rows stay in frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.errors import Incomplete, NotCovered, Quota
from marketlab.operators import intervals
from marketlab.operators.normalize import normalize
from marketlab.operators.store import Store

ROWS = "ts timestamp, open double, high double, low double, close double, volume double, adj_close double"
#: Vendors that answer one call for a whole range, so that several holes are fetched as one.
WHOLE_RANGE = ("yahoo", "alphavantage")


class Source(Protocol):
    name: str

    def pages(self, instrument_id: str, timeframe: str, start: datetime, end: datetime) -> Iterator[DataFrame]: ...

    def truncated(self) -> bool: ...


class Recorded:
    """A source that answers from a frame of recorded bars, ``size`` rows a page, oldest first; rows before ``since`` are beyond its depth."""

    def __init__(self, name: str, rows: DataFrame, size: int = 500, since: datetime | None = None):
        self.name, self.rows, self.size, self.since, self.calls, self._cut = name, rows, size, since, [], False

    def pages(self, instrument_id: str, timeframe: str, start: datetime, end: datetime) -> Iterator[DataFrame]:
        self.calls.append((instrument_id, timeframe, start, end))
        self._cut = self.since is not None and start < self.since
        at = max(start, self.since) if self.since else start
        while True:
            page = self.rows.where((F.col("ts") >= F.lit(at)) & (F.col("ts") <= F.lit(end))).orderBy("ts").limit(self.size)
            n, last = page.agg(F.count("*"), F.max("ts")).first()
            if n:
                yield page
            if n < self.size:
                return
            at = last + timedelta(microseconds=1)

    def truncated(self) -> bool:
        return self._cut


@dataclass
class Result:
    """What a request did."""

    rows: int = 0
    holes: int = 0
    noop: bool = False
    warnings: list[str] = field(default_factory=list)


def open_ranges(store: Store, instrument_id: str, timeframe: str, source: str, start: datetime, end: datetime, windows: DataFrame | None = None) -> list[tuple[datetime, datetime]]:
    """Half-open ranges from start up to end that coverage lacks, within the session windows (instrument_id, start_utc, end_utc) where these are given."""
    spark = store.spark
    wanted = spark.createDataFrame([(instrument_id, start, end)], "instrument_id string, want_start timestamp, want_end timestamp")
    holes = intervals.holes(store.coverage(instrument_id, timeframe, source).select("instrument_id", "start_utc", "end_utc"), wanted, "instrument_id")
    if windows is not None:
        named = windows.where(F.col("instrument_id") == instrument_id).select("instrument_id", F.col("start_utc").alias("b_start"), F.col("end_utc").alias("b_end"))
        holes = intervals.overlap(holes.withColumnsRenamed({"start_utc": "a_start", "end_utc": "a_end"}), named, "instrument_id")
        holes = intervals.merge(holes.select("instrument_id", "start_utc", "end_utc"), "instrument_id", touch_micro=False)
    got = [(r.start_utc, r.end_utc) for r in holes.orderBy("start_utc").collect()]
    return [(got[0][0], got[-1][1])] if got and source in WHOLE_RANGE else got


def ingest(store: Store, source: Source, instrument_id: str, timeframe: str, start: datetime, end: datetime, now: Callable[[], datetime], windows: DataFrame | None = None) -> Result:
    """Fill what coverage lacks.  A range counts as covered once all its pages are written; of one that the vendor cut short, only the span of the rows it gave."""
    out = Result()
    holes = open_ranges(store, instrument_id, timeframe, source.name, start, end, windows)
    if not holes:
        out.noop = True
        return out

    def cover(first: datetime, last: datetime) -> None:
        store.add_coverage(store.spark.createDataFrame([(instrument_id, timeframe, source.name, first, last)], "instrument_id string, timeframe string, source string, start_utc timestamp, end_utc timestamp"))

    cut = False
    try:
        for first, last in holes:
            spans = []
            for k, page in enumerate(source.pages(instrument_id, timeframe, first, last)):
                rows = page.withColumnRenamed("ts", "ts_utc").withColumn("instrument_id", F.lit(instrument_id)).withColumn("timeframe", F.lit(timeframe)).withColumn("page_seq", F.lit(k))
                if "adj_close" not in rows.columns:
                    rows = rows.withColumn("adj_close", F.lit(None).cast("double"))
                rows = normalize(rows, timeframe, now().isoformat(sep=" ")).withColumn("source", F.lit(source.name)).withColumn("quality", F.lit("ok"))
                n, low, high = rows.agg(F.count("*"), F.min("ts_utc"), F.max("ts_utc")).first()
                if n:
                    store.write_bars(rows)
                    spans.append((low, high))
                    out.rows += n
            out.holes += 1
            if not source.truncated():
                cover(first, last)
            else:
                cut = True
                if spans:
                    cover(min(a for a, _ in spans), max(b for _, b in spans))
    except (Incomplete, Quota) as e:
        out.warnings.append(str(e))
    if cut or source.truncated():
        out.warnings.append(f"{source.name} gave part of the history; only what it gave is covered")
    out.noop = not out.rows and not out.warnings
    return out


def preflight(store: Store, universe: list[str], timeframe: str, start: datetime, end: datetime) -> None:
    """Every name's coverage must meet the span; else an error that names what to ingest."""
    have = {r[0] for r in store.coverage(timeframe=timeframe).where((F.col("start_utc") <= F.lit(end)) & (F.col("end_utc") >= F.lit(start))).select("instrument_id").distinct().collect()}
    lacking = [x for x in universe if x not in have]
    if lacking:
        raise NotCovered("; ".join(f"no {timeframe} coverage of {x} from {start} to {end}: ingest {x} {timeframe} {start:%Y-%m-%d} {end:%Y-%m-%d}" for x in lacking))
