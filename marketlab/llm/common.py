"""What the operators of this subpackage share: scratch tables, stable splits and worker imports."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words and is stripped from lines: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of a batch of rows on its way to Python (one row at least); Spark's default is 64 MB, or 10,000 rows.
BATCH = 4 << 20

_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package when it was found through ``sys.path`` alone."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of ``BATCH`` bytes at most from now on, unless the session asks for smaller ones: a batch is held several times over, in the executor and in its worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(min(BATCH, int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))))))


def give_back() -> None:
    """Return what this process has freed to the system: Arrow's pool and the C library keep it otherwise, and workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="marketlab-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/marketlab-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, what a table's plan has shuffled goes once the table is written, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


def mark() -> set[str]:
    """The scratch tables that exist now; see ``release``."""
    return set(_written)


def release(before: set[str] = frozenset()) -> None:
    """Remove the scratch tables written since ``mark``; only once what reads them has been written elsewhere."""
    for path in [x for x in _written if x not in before]:
        try:
            remove(_written[path], path)
        except Exception:  # noqa: BLE001  the session has ended: nothing can be removed through it any more
            _written.pop(path, None)


atexit.register(release)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df has not."""
    out = f"__{name}"
    while out in df.columns:
        out += "_"
    return out


def split_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo ``modulus``; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def mapped(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    importable(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches):
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def slices(batch, column: str = "text", most: int = 4_000_000):
    """Parts of an Arrow batch with about ``most`` bytes of text each (one row at least), for bounded memory in a task."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
