"""Line dedup over levelled sorted runs of line hashes.

A run is a table (key, n) bucketed and sorted by key: 128-bit hashes of line keys and in how many
documents of some batches each was found.  ``LineRuns.add`` deals a batch's counts by key as the runs are, merge-anti-joins them
with the keys condemned before, merges them with the runs for their totals, and adds the rest as a run of level 0; when a level
holds ``fanout`` runs they are merged into one run of the next, where counts add up.  A key
is condemned once its counts reach ``min_docs``.

Lines are what ``\\n`` separates; a line's key is the line without the white space at its ends, A-Z in
lower case.  A null or empty text is one empty line.  Keys shorter than ``min_chars`` code points are
never dropped.  A document counts once for a key however often it has it; repeated rows are documents
each.  Other columns pass through ``drop_lines`` unchanged.

The condemned keys are broadcast to the tasks that filter only while there are ``broadcast_keys`` of them
at most (16 bytes each); beyond, each document's own condemned keys are joined to it.  Very long texts are split whole.  An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.llm.common import SPACES, mapped, remove, scratch_path, slices, stored

WHITE = SPACES.encode()
FLUSH = 300_000
BROADCAST_KEYS = 1_000_000
#: Documents for each batch beyond the third, and parts that rows of one line are dealt to.
BATCH, SALTS = 5_000_000, 16


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def _long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars if min_chars <= 1 else len(key.decode("utf-8", "replace")) >= min_chars


def digest(key: bytes) -> bytes:
    return hashlib.md5(key, usedforsecurity=False).digest()


def keys_of(text: bytes | None, min_chars: int) -> set[bytes]:
    """Distinct line keys of one text, hashed."""
    return {digest(k) for k in {line_key(x) for x in (text or b"").split(b"\n")} if _long(k, min_chars)}


def batch_counts(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """batch, key and n: partial document counts of each task, by the batch that a document's hash puts it in."""

    def count(parts):
        def flush():
            out = [(b, k, n) for b, c in enumerate(seen) for k, n in c.items()]
            for c in seen:
                c.clear()
            b, k, n = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(n, pa.int64())], ["batch", "key", "n"])

        seen = [Counter() for _ in range(batches)]
        for part in parts:
            for b, text in zip(part.column("batch").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                seen[b].update(keys_of(text, min_chars))
                if sum(map(len, seen)) > FLUSH:
                    yield flush()
        yield flush()

    rows = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "text")
    return mapped(rows, count, "batch int, key binary, n long")


class LineRuns:
    """Levels of sorted runs; level 0 holds the newest.

    A run is a table (key, n, total) in ``buckets`` files by key, each sorted by key, so that runs, and batches dealt the same way, are merged in
    order, without a shuffle or a sort.  ``total`` is what all runs counted when the run was added.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.bad: str | None = None  # the keys condemned so far, a table like a run
        self._paths: dict[str, str] = {}

    def _read(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def _write(self, rows: DataFrame, kind: str) -> str:
        path = scratch_path(self.spark, kind)
        name = f"marketlab_{kind}_{path[-32:]}"
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        self._paths[name] = path
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, self._paths.pop(name))

    @contextmanager
    def _in_order(self):
        """Scans of runs tell the planner that their files are sorted."""
        key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(key, "false")
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            self.spark.conf.set(key, before)

    def condemned(self) -> DataFrame:
        return self._read(self.bad).select("key") if self.bad else self.spark.createDataFrame([], "key binary")

    def totals(self) -> DataFrame:
        """key and n over all runs."""
        parts = [self._read(x).select("key", "n") for level in self.levels for x in level]
        return reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], "key binary, n long")).groupBy("key").agg(F.sum("n").alias("n"))

    def add(self, counts: DataFrame) -> None:
        """A batch's (key, n): what is condemned already needs no further count; the rest is a new run, and its keys' totals tell which are condemned now."""
        new = counts.repartition(self.buckets, "key").groupBy("key").agg(F.sum("n").alias("n"))
        with self._in_order():
            if self.bad:
                new = new.join(self.condemned().hint("merge"), "key", "left_anti")
            total = F.col("n")
            for i, run in enumerate(x for level in self.levels for x in level):
                new = new.join(self._read(run).select("key", F.col("n").alias(f"n{i}")).hint("merge"), "key", "left")
                total = total + F.coalesce(f"n{i}", F.lit(0))
            run = self._write(new.select("key", "n", total.alias("total")), "run")
            found = self._read(run).where(F.col("total") >= self.min_docs).select("key")
            old, self.bad = self.bad, self._write(found.unionByName(self.condemned()).repartition(self.buckets, "key"), "bad")
            if old:
                self._drop(old)
            self.levels = self.levels or [[]]
            self.levels[0].append(run)
            level = 0
            while len(self.levels[level]) >= self.fanout:
                self.compact(level)
                level += 1

    def compact(self, level: int) -> None:
        """Merge a level's runs into one run of the next; the old ones go."""
        old, self.levels[level] = self.levels[level], []
        both = self._read(old[0]).select("key", "n")
        for name in old[1:]:
            both = both.join(self._read(name).select("key", F.col("n").alias("more")).hint("merge"), "key", "full_outer").select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
        made = self._write(both.select("key", "n", F.col("n").alias("total")), "run")
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(made)
        for name in old:
            self._drop(name)

    def close(self) -> None:
        for name in [*(x for level in self.levels for x in level), *([self.bad] if self.bad else [])]:
            self._drop(name)
        self.levels, self.bad = [], None


def condemned_keys(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int | None = None) -> DataFrame:
    """Hashes of the line keys found in ``min_docs`` documents at least, gathered batch by batch; three batches, and one more for each ``BATCH`` documents."""
    batches = batches or 3 + min(docs.count() // BATCH, 61)
    runs = LineRuns(docs.sparkSession, min_docs)
    counts = stored(batch_counts(docs, min_chars, batches), "lines", ("batch",))
    for b in range(batches):
        runs.add(counts.where(F.col("batch") == b).select("key", "n"))
    out = stored(runs.condemned(), "condemned")
    runs.close()
    return out


def split_kept(text: bytes | None, keys, min_chars: int) -> tuple[int, int, bytes]:
    """Lines before, lines dropped, and the text that is left."""
    lines = (text or b"").split(b"\n")
    kept = [x for x in lines if not (_long(k := line_key(x), min_chars) and digest(k) in keys)]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _split_rows(docs: DataFrame, keys: DataFrame, min_chars: int, broadcast_keys: int, digests: bool) -> DataFrame:
    """Columns of docs with the text left (or, in its place, the digest of it), then __lines and __dropped."""
    spark = docs.sparkSession
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    small = keys.count() <= broadcast_keys
    if small:
        sent = spark.sparkContext.broadcast(frozenset(r[0] for r in keys.toLocalIterator()))
        rows = docs
    else:
        sent = None
        rows = _with_own_keys(docs, keys, min_chars)

    def run(batches):
        at = names.index("text")
        for batch in (part for whole in batches for part in slices(whole)):
            own = [sent.value] * batch.num_rows if small else [set(x or ()) for x in batch.column("__own").to_pylist()]
            out = [split_kept(t, k, min_chars) for t, k in zip(batch.column(at).cast(pa.binary()).to_pylist(), own, strict=True)]
            n, dropped, texts = zip(*out, strict=True)
            cols = [batch.column(i) for i in range(len(names))]
            cols[at] = pa.array([hashlib.sha256(t).hexdigest() for t in texts]) if digests else pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], [*names, "__lines", "__dropped"])

    return mapped(rows, run, f"{kinds}, __lines long, __dropped long")


def drop_lines(docs: DataFrame, keys: DataFrame, min_chars: int = 1, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """All columns of docs with the text left, then __lines and __dropped."""
    return _split_rows(docs, keys, min_chars, broadcast_keys, digests=False)


def _with_own_keys(docs: DataFrame, keys: DataFrame, min_chars: int) -> DataFrame:
    """Each document with its own condemned keys, joined by a hash of the text."""

    def explode(batches):
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            found = [(digest(t or b""), k) for t in texts for k in keys_of(t, min_chars)]
            t, k = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.binary()), pa.array(k, pa.binary())], ["__text", "key"])

    # a line may stand in most texts: its rows are dealt by key and salt
    lines = mapped(docs.select("text").distinct(), explode, "__text binary, key binary").withColumn("salt", F.pmod(F.xxhash64("__text"), F.lit(SALTS)).cast("int"))
    own = lines.join(keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"]).groupBy("__text").agg(F.collect_set("key").alias("__own"))
    return docs.withColumn("__text", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))).join(own, "__text", "left").drop("__text").select(*docs.columns, "__own")


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    """Counts of lines, and the digest of what is left of every whole text."""
    rows = docs.select("doc_id", "text")
    out = _split_rows(rows, condemned_keys(rows), 1, BROADCAST_KEYS, digests=True)
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.col("text").alias("kept_sha256"))


ORACLE = r"""
WITH ls AS (SELECT doc_id, row_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, row_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
    FROM (SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce("text", ''), chr(10)) AS parts FROM documents))),
bad AS (SELECT key FROM ls WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_id) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM bad)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM bad)), '')) AS kept_sha256
FROM ls GROUP BY row_id
"""
