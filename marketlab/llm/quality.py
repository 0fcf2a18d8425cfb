"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class gets the mean and covariance of its documents' statistics.  A covariance is drawn by ``shrink``
towards the pooled one and by ``ridge`` towards the pooled variances, factored once by Cholesky, and a
document's score is the logistic of the Mahalanobis log-density difference plus the log odds of the classes.
The moments are sums over all labelled training rows, made by one distributed aggregate; no row is
collected.

Null text counts as empty, whose statistics are all defined.  Several labels of one document count by
their mean (1 from a half).  Labels without a document, null labels and documents without a label do
not train.  Where a class has fewer than two rows, scores are the share of class 1 (1/2 without
labels).  Equal texts get equal scores, and each of repeated rows trains and is scored.  Very long texts are worked whole, a few MB of
texts at a time.  An empty table gives no rows.  Other columns are not read or, when filtering, kept.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import importable, mapped, slices, small_batches, split_of, stored

NAMES = ("words", "word_size", "word_spread", "capitals", "digits", "symbols", "stops", "pipes", "distinct", "again", "top", "breaks", "marked", "high", "empty")
COLUMNS = [f"s_{x}" for x in NAMES]
#: Labelled documents that are broadcast at most; beyond, labels are joined to the statistics by a shuffle.
SMALL = 1_000_000

_kind = np.zeros(256, np.int64)
_kind[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_kind[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_kind[list(b"0123456789")] = 3
_kind[list(b".,'")] = 4
_kind[list(b"|")] = 5
_kind[list(b" \t\n\r\x0b\x0c")] = 6
_kind[[c for c in range(33, 127) if not _kind[c]]] = 7
_kind[128:] = 8
_ends = frozenset(c for c in range(33, 127) if _kind[c] in (5, 7))


def statistics(text: bytes | None) -> list[float]:
    """Transformed statistics of one whole text: logarithms of sizes, square roots of shares."""
    if not text:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    other, lower, upper, digits, stops, pipes, _, symbols, high = np.bincount(_kind, weights=count, minlength=9)
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    sizes = np.fromiter(map(len, words), np.int64, n)
    tally = Counter(words)
    size = len(text)
    return [
        math.log1p(n),
        math.log(sizes.mean()),
        math.log1p(sizes.std()),
        math.sqrt(upper / max(1.0, upper + lower)),
        math.sqrt(digits / size),
        math.sqrt((symbols + other) / size),
        math.sqrt(stops / size),
        math.sqrt(pipes / size),
        math.log(len(tally) / n) / math.log(n + 1),
        math.sqrt(sum(map(eq, words, words[1:])) / n),
        math.sqrt((max(tally.values()) - 1) / n),
        math.sqrt(count[10] / size),
        math.sqrt(sum([w[-1] in _ends for w in words]) / n),
        math.sqrt(high / size),
        0.0,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """Columns of docs other than text, and one double for each statistic; texts do not come back from Python."""
    keep = [c for c in docs.columns if c != "text"]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            got = np.array([statistics(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x) for x in got.T)], [*keep, *COLUMNS])

    return mapped(docs, run, kinds + ", ".join(f"{x} double" for x in COLUMNS))


class Discriminant:
    """Two Gaussian classes with regularised covariances."""

    def __init__(self, n: np.ndarray, total: np.ndarray, outer: np.ndarray, shrink: float = 0.1, ridge: float = 0.02):
        self.prior = (n[1] + 1e-9) / (n.sum() + 2e-9)
        self.usable = bool(n.min() >= 2)
        if not self.usable:
            return
        mean = total / n[:, None]
        cov = outer / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        pooled = (cov * n[:, None, None]).sum(0) / n.sum()
        floor = np.diag(np.diag(pooled) + 1e-6)
        self.mean = mean
        self.factor = [np.linalg.cholesky((1 - shrink - ridge) * c + shrink * pooled + ridge * floor) for c in cov]
        self.inverse = [np.linalg.inv(f) for f in self.factor]
        self.log_det = [2 * np.log(np.diag(f)).sum() for f in self.factor]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.full(len(x), self.prior)
        density = [-0.5 * (((x - m) @ i.T) ** 2).sum(1) - 0.5 * d for m, i, d in zip(self.mean, self.inverse, self.log_det, strict=True)]
        odds = density[1] - density[0] + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def labels_of(labels: DataFrame, column: str = "quality") -> DataFrame:
    """doc_id and y, the class that most labels of a document name."""
    return labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("y"))


def fit(rows: DataFrame, known: DataFrame) -> Discriminant:
    """Moments of all labelled rows (doc_id and statistics), summed in place; 2 rows reach the driver."""
    rows = rows.join(known, "doc_id")
    d, cols = len(NAMES), [F.col(x) for x in COLUMNS]
    sums = [F.sum(c).alias(f"t{i}") for i, c in enumerate(cols)]
    pairs = [F.sum(cols[i] * cols[j]).alias(f"o{i}_{j}") for i in range(d) for j in range(i, d)]
    n, total, outer = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows.groupBy("y").agg(F.count("*").alias("n"), *sums, *pairs).collect():
        n[r.y] = r.n
        total[r.y] = [r[f"t{i}"] for i in range(d)]
        for i in range(d):
            for j in range(i, d):
                outer[r.y, i, j] = outer[r.y, j, i] = r[f"o{i}_{j}"]
    return Discriminant(n, total, outer)


def scored(rows: DataFrame, model: Discriminant) -> DataFrame:
    """Columns of rows other than the statistics, and score."""
    keep = [c for c in rows.columns if c not in COLUMNS]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in keep)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in COLUMNS], 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sent.value.score(x))], [*keep, "score"])

    return mapped(rows, run, f"{kinds}score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, column: str = "quality") -> DataFrame:
    """The rows of docs, all columns, that score ``least`` or more by a discriminant fitted to those with a label and a split (modulo 3) that is not 1.

    Only labelled rows get statistics for the fit.  When the rows are scored, a text goes to Python and one number comes back.
    """
    known = labels_of(labels, column)
    small = known.count() <= SMALL
    rows = training(docs).join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi") if small else training(docs)
    model = fit(with_statistics(rows), F.broadcast(known) if small else known)
    importable(docs.sparkSession)
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [np.array([statistics(t) for t in part.column(0).cast(pa.binary()).to_pylist()]) for part in slices(batch)]
        return pa.array(np.concatenate([sent.value.score(x) for x in parts]) if parts else np.zeros(0), pa.float64())

    return docs.where(F.arrow_udf(score, "double")(F.col("text").cast("string")) >= least)


def training(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").where(split_of(F.col("doc_id"), 3) != 1)


def op10_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a discriminant fitted to the labels of those whose split (modulo 3) is not 1.

    Every text is read once: its statistics are written, fitted and scored.
    """
    rows = docs.select("doc_id", (split_of(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    rows = stored(with_statistics(rows), "statistics")
    out = scored(rows.select("doc_id", "held_out", *COLUMNS), fit(rows.where(~F.col("held_out")), labels_of(labels)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
