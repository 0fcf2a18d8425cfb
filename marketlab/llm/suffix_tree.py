"""Language-model scoring with a probabilistic suffix tree over words.

A context (the last 1 to ``depth`` words) becomes a state when it stands in the N training
tokens ``min_context`` times the root of N at least and its next-word counts diverge from those of its longest proper
suffix: the log-likelihood gain must reach ``divergence`` times ln(N).  Every suffix of a state is a
state too.  A state's distribution gives its counts to the words seen after it ``min_pair`` times the root
of N or more, and all other mass, with one pseudo-count for each such word, to
its suffix's distribution; the root is the word frequency with half a count added.  So every state's
distribution sums to 1 over the vocabulary and one unknown word.

Size: a level holds at most the root of N over ``min_context`` states and the root of N over ``min_pair`` next words, so the tree grows with the
corpus, by half its power: four times the tokens hold up to twice the states.  That is what is broadcast.  Word counts grow with the corpus too: they stay in a
table, to which the rarer words of each text are joined.

Null text counts as empty, an empty text is its end token alone; repeated rows are scored each; an
empty training part gives every token probability 1 (one unknown word and nothing else).
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import mapped, slices, split_of, stored

END = b""
FLUSH = 400_000


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; ``bytes`` methods use exactly the ASCII rules wanted."""
    return text.lower().split() if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """Columns word (binary; empty: end of text) and c, over the column text."""

    def count(batches):
        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(tokens(text))
                seen[END] += 1
                if len(seen) > FLUSH:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    return mapped(docs.select("text"), count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Tree:
    """Words by id, the contexts of each depth, and, once fitted, their distributions."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n: int, v: int):
        self.words, self.counts, self.n, self.v = words, counts, n, v
        self.size = len(words) + 1  # the last id stands for every rarer word
        self.first = np.full(self.size, -1, np.int64)  # word -> context of depth 1
        self.contexts: list[np.ndarray] = []  # depth 2 and on: sorted (context of one less, word)
        self.suffix: list[np.ndarray] = []
        self.total: list[np.ndarray] = []
        self.entries: list[tuple[np.ndarray, np.ndarray]] = []  # sorted (context, word), count
        self.logs: list[np.ndarray] = []
        self.backoff: list[np.ndarray] = []
        self.kept: list[np.ndarray] = []

    def prepare(self) -> None:
        rest = self.size - 1
        self.ids = {w: i for i, w in enumerate(self.words)}
        self.end = self.ids.get(END, rest)
        self.rest = rest
        self.root = np.log10(np.append(self.counts + 0.5, 1.0))  # rarer words: joined later

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Ids of all texts' tokens after one end token, the index of each text's first, and the tokens."""
        words: list[bytes] = [END]
        starts = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            starts[i] = len(words)
            words.extend(tokens(text))
            words.append(END)
        get, rest = self.ids.get, self.rest
        return np.fromiter((get(w, rest) for w in words), np.int64, len(words)), starts, words

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Index in sorted keys, or -1."""
        if not len(keys):
            return np.full(len(wanted), -1, np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def ending(self, ids: np.ndarray, depth: int) -> list[np.ndarray]:
        """For each depth, the context that ends at each token, or -1."""
        out = [self.first[ids]]
        for k in range(2, depth + 1):
            before = np.concatenate([[-1], out[-1][:-1]])
            some = np.flatnonzero(before >= 0)
            at = np.full(len(ids), -1, np.int64)
            at[some] = self.find(self.contexts[k - 2], before[some] * self.size + ids[some])
            out.append(at)
        return out

    def probability(self, depth: int, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        if not depth:
            return (self.counts[word] + 0.5) / (self.n + 0.5 * (self.v + 1))
        found = self.find(self.entries[depth - 1][0], at * self.size + word)
        below = self.probability(depth - 1, self.suffix[depth - 1][at], word)
        return np.where(found >= 0, np.exp(self.logs[depth - 1][found]) if len(self.logs[depth - 1]) else 0, self.backoff[depth - 1][at] * below)

    def add_level(self, keys: np.ndarray, n: np.ndarray, total: np.ndarray, suffix: np.ndarray, divergence: float) -> None:
        """Next words of this depth's contexts, in the order of the keys."""
        depth = len(self.entries) + 1
        at, word = keys // self.size, keys % self.size
        kinds = np.maximum(np.bincount(at, minlength=len(total)), 1)
        kept = np.bincount(at, weights=n, minlength=len(total))
        self.entries.append((keys, n))
        self.suffix.append(suffix)
        self.total.append(total)
        self.backoff.append((total - kept + kinds) / (total + kinds))
        below = self.probability(depth - 1, suffix[at], word)
        p = n / (total + kinds)[at] + self.backoff[-1][at] * below
        self.logs.append(np.log(p))
        gain = np.bincount(at, weights=n * (np.log(p) - np.log(below)), minlength=len(total))
        self.kept.append(gain >= divergence * math.log(max(self.n, 2)))

    def close(self) -> None:
        """Suffixes of states are states; from now on all logarithms are decimal."""
        for k in range(len(self.kept) - 1, 0, -1):
            self.kept[k - 1][self.suffix[k][self.kept[k]]] = True
        self.logs = [x / math.log(10) for x in self.logs]
        self.backoff = [np.log10(x) for x in self.backoff]
        self.total = []

    def score(self, ids: np.ndarray) -> np.ndarray:
        """log10 probability of each token after the first, up to the root's denominator and the rarer words' counts."""
        depth = len(self.entries)
        ends, word = self.ending(ids, depth), ids[1:]
        out, root = np.zeros(len(word)), np.ones(len(word), bool)
        for k in range(depth, 0, -1):
            at = ends[k - 1][:-1]
            some = np.flatnonzero((at >= 0) & root)
            some = some[self.kept[k - 1][at[some]]]
            found = self.find(self.entries[k - 1][0], at[some] * self.size + word[some])
            hit = found >= 0
            out[some[hit]] += self.logs[k - 1][found[hit]]
            root[some[hit]] = False
            out[some[~hit]] += self.backoff[k - 1][at[some[~hit]]]
        return out + np.where(root, self.root[word] - math.log10(self.n + 0.5 * (self.v + 1)), 0.0)


def _load(sent) -> Tree:
    """The broadcast tree, made ready once in each task."""
    tree = sent.value
    if not hasattr(tree, "ids"):
        tree.prepare()
    return tree


def next_words(docs: DataFrame, sent, depth: int) -> DataFrame:
    """Columns key (context of this depth and word) and n."""

    def count(batches):
        def merged():
            keys, at = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([m for _, m in got]), minlength=len(keys)).astype(np.int64)
            got.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

        tree, got = _load(sent), []
        for batch in batches:
            for part in slices(batch):
                ids, _, _ = tree.encode(part.column(0).cast(pa.binary()).to_pylist())
                at, word = tree.ending(ids, depth)[-1][:-1], ids[1:]
                some = (at >= 0) & (word < tree.rest)
                got.append(np.unique(at[some] * tree.size + word[some], return_counts=True))
                if sum(len(k) for k, _ in got) > 1_500_000:
                    yield merged()
        if got:
            yield merged()

    return mapped(docs.select("text"), count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, depth: int = 3, min_word: float = 0.002, min_context: float = 0.15, min_pair: float = 0.002, divergence: float = 1.0) -> tuple[Tree, DataFrame]:
    """The tree and the table of all word counts, from the column text."""
    spark = docs.sparkSession
    counts = stored(word_counts(docs), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    root = math.sqrt(n)
    floor, least, pairs = max(1, math.ceil(min_word * root)), max(2, min_context * root), max(2, math.ceil(min_pair * root))
    head = counts.where(F.col("c") >= floor).toArrow()
    c = head["c"].to_numpy()
    order = np.argsort(-c, kind="stable")
    words = head["word"].to_pylist()
    tree = Tree([words[i] for i in order], c[order], n, v)
    tree.floor = floor
    total = tree.counts[tree.counts >= least]
    tree.first[: len(total)] = np.arange(len(total))
    suffix, end = np.zeros(len(total), np.int64), next((i for i, w in enumerate(tree.words) if w == END), -1)
    for k in range(1, depth + 1):
        if not len(total):
            break
        sent = spark.sparkContext.broadcast(tree)
        got = next_words(docs, sent, k).where(F.col("n") >= pairs).toArrow()
        keys, m = got["key"].to_numpy(), got["n"].to_numpy()
        order = np.argsort(keys)
        keys, m = keys[order], m[order]
        tree.add_level(keys, m, total, suffix, divergence)
        if k < depth:
            more = (m >= least) & (keys % tree.size != end)
            tree.contexts.append(keys[more])
            total, at, word = m[more], keys[more] // tree.size, keys[more] % tree.size
            suffix = tree.first[word] if k == 1 else tree.find(tree.contexts[k - 2], tree.suffix[k - 1][at] * tree.size + word)
    tree.close()
    return tree, counts


def score(docs: DataFrame, tree: Tree, counts: DataFrame) -> DataFrame:
    """Columns of docs other than text, then n_tokens, n_known, base_score and score."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tree)
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        tree = _load(sent)
        for batch in (part for whole in batches for part in slices(whole)):
            ids, starts, words = tree.encode(batch.column("text").cast(pa.binary()).to_pylist())
            if not len(starts):
                continue
            got, rare = tree.score(ids), ids[1:] == tree.rest
            at = starts - 1
            out = [batch.column(x) for x in names]
            out.append(pa.array(np.diff(np.append(starts, len(ids)))))
            out.append(pa.array(np.add.reduceat((~rare).astype(np.int64), at)))
            out += [pa.array(np.add.reduceat(x, at)) for x in (np.where(rare, 0.0, tree.root[ids[1:]]), got)]
            where = np.flatnonzero(rare)
            offsets = np.append(np.searchsorted(where, at), len(where)).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array([words[i + 1] for i in where], pa.binary())))
            yield pa.RecordBatch.from_arrays(out, [*names, "n_tokens", "n_head", "base_head", "score_head", "rare"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    part = mapped(docs, run, f"{kinds}, n_tokens long, n_head long, base_head double, score_head double, rare array<binary>")
    part = stored(part.withColumn("row_id", F.monotonically_increasing_id()), "scores")
    rare = part.select("row_id", F.explode("rare").alias("word")).join(counts.where(F.col("c") < tree.floor), "word", "left")
    rare = rare.groupBy("row_id").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"), F.count("c").alias("n_rare"))
    whole = math.log10(tree.n + 0.5 * (tree.v + 1))
    return part.drop("rare").join(rare, "row_id", "left").select(
        *names,
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(tree.n).cast("long").alias("train_tokens"),
        (F.col("base_head") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("score_head") + F.coalesce("rare_log", F.lit(0.0))).alias("score"),
    )


def op1_suffix_tree(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a tree learnt from those whose split (modulo 5) is not 1."""
    rows = docs.select("doc_id", (split_of(F.col("doc_id"), 5) == 1).alias("held_out"), "text")
    tree, counts = fit(rows.where(~F.col("held_out")))
    return score(rows, tree, counts)
