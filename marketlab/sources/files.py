"""Files: bulk loads of stored Parquet and the exchange's daily archives."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.operators.store import Store
from marketlab.schema import BAR
from marketlab.sources.vendors import bhavcopy_bars
from marketlab.workers import importable

#: Fixed value: the first session whose archive has the new name and header.
NEW_NAMES = date(2024, 7, 8)


def load_bars(spark: SparkSession, root: str) -> DataFrame:
    """Every Parquet file below a folder as bars, with null for columns that a file lacks; what is no bar column is left out."""
    rows = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(root)
    return rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in BAR))


def bulk_load(store: Store, root: str) -> None:
    """Append a folder of Parquet bars to the store; where two files hold one bar, the store keeps one row of the batch."""
    store.write_bars(load_bars(store.spark, root))


def migrated(parts: list[DataFrame]) -> DataFrame:
    """Frames of unlike columns in one, by name, null where a frame lacks a column."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def archive_name(day: date) -> str:
    """The exchange's file name for a session."""
    if day >= NEW_NAMES:
        return f"BhavCopy_NSE_CM_0_0_0_{day:%Y%m%d}_F_0000.csv.zip"
    return f"cm{day:%d}{day:%b}{day:%Y}bhav.csv.zip".replace(f"{day:%b}", f"{day:%b}".upper())


def archive_day(name: str) -> date | None:
    """The session that a file name stands for."""
    if m := re.search(r"_([0-9]{4})([0-9]{2})([0-9]{2})_F_", name):
        return date(*map(int, m.groups()))
    if m := re.search(r"cm([0-9]{2})([A-Z]{3})([0-9]{4})bhav", name):
        months = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
        return date(int(m[3]), months.index(m[2]) + 1, int(m[1])) if m[2] in months else None
    return None


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """path and line of every line of the archives (zip, or plain csv) that a path or pattern names; an archive is unpacked in one task."""
    importable(spark)

    def unpack(batches):
        import io
        import zipfile

        import pandas as pd

        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                data = bytes(content)
                if data[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        data = b"\n".join(z.read(x) for x in z.namelist() if x.lower().endswith(".csv"))
                out += [(name, x) for x in data.decode("utf-8-sig", "replace").splitlines() if x.strip()]
            yield pd.DataFrame(out, columns=["path", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, "path string, line string")


def bhavcopies(spark: SparkSession, path: str) -> DataFrame:
    """Bars of all sessions whose archives a path or pattern names; files of one header are read together, and an unknown header is an error."""
    lines = archive_lines(spark, path).withColumn("__k", F.monotonically_increasing_id())
    # one header line a file, so what comes to the driver is the distinct headers
    first = lines.groupBy("path").agg(F.min_by("line", "__k").alias("header"), F.min("__k").alias("__first"))
    headers = [r[0] for r in first.select("header").distinct().collect()]
    day = F.udf(archive_day, "date")
    out = None
    for header in headers:
        names = [x.strip() for x in header.split(",")]
        rows = lines.join(first.where(F.col("header") == header), "path").where(F.col("__k") != F.col("__first"))
        # a file's day is parsed once for each file
        days = first.where(F.col("header") == header).select("path", day(F.col("path")).alias("session_date"))
        cells = F.split("line", ",", -1)
        table = rows.select("path", *(F.trim(F.get(cells, i)).alias(n or f"column{i}") for i, n in enumerate(names))).join(days, "path").drop("path")
        part = bhavcopy_bars(table)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no archive at {path}")
    return out
