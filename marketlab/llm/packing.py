"""Best-fit packing of token pieces by repeated length patterns.

A document's ids and one id 0 are cut into pieces of at most ``CAPACITY`` tokens (the first takes the
remainder).  The histogram of piece lengths, at most ``CAPACITY`` numbers for any corpus, goes to the driver.  There
patterns of two to four lengths that nearly fill a sequence are enumerated, non-negative least squares fits their repeat
counts to the histogram, the counts are rounded as far as the pieces last, and what is left is packed
by best fit, longest first.  The plan gives each length's pieces their places by rank; ranks are counted
within (length, salt) groups, so one very frequent length is not one task.  Pieces that fill a sequence need no rank.

A null text is empty and an empty text is the end id alone.  Repeated rows are packed each.  Ties of
rank between equal rows change no result but which of them stands where.  Very long texts are cut, never shortened.  An empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlab.llm.common import mapped, slices, stored

CAPACITY = 2048
#: Rows of one length that are ranked together, and into how many groups all rows are dealt at most beside one for each length.
TOGETHER, GROUPS = 2_000, 100_000
#: Texts of at most ``SHORT`` characters are kept with their ids by a worker, ``KNOWN`` of them for as long as it lives; the others are encoded each time.
KNOWN, SHORT = 100_000, 32
#: The white space of the tokenizer's pattern: more than ``SPACES``, and not what Python's own \s takes.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN, CUT = re.compile(f"[{WHITE}]{{2}}"), re.compile(f"(?<=[{WHITE}])(?=[{WHITE}][^{WHITE}])")
#: Enumeration: partners tried for each first length, and the most tokens a pattern may leave empty.
PARTNERS, SLACK = 12, 24


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    The pattern that splits texts looks ahead in one place only: a run of white space leaves its last character to what
    follows.  Texts are cut there, which is an end of a token in any case, and the rest of the pattern, without looking
    ahead, costs much less.  Texts with a special string go through the first library.
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        self.path = public_tokenizers.path(f"{name}.json")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # the same vocabulary and merges, without the other library's cost for each call
        pattern = public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", "")
        self.fast = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        del self.library  # 26 MB; only texts with a special string need it, and read it again
        self.known: dict[str, bytes] = {}

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = CUT.split(text) if RUN.search(text) else (text,)
        return b"".join(np.array(self.fast.encode_ordinary(p), "<u4").tobytes() for p in parts)

    def encode(self, text: str) -> bytes:
        if len(text) > SHORT:
            return self.whole(text)
        if (ids := self.known.get(text)) is None:
            ids = self.whole(text)
            if len(self.known) < KNOWN:
                self.known[text] = ids
        return ids


_encoder: list[Encoder] = []


def encoder() -> Encoder:
    """One for each worker process."""
    if not _encoder:
        _encoder.append(Encoder())
    return _encoder[0]


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of one document's ids and the end id."""
    ids += b"\0\0\0\0"
    n = len(ids) // 4
    first = (n - 1) % capacity + 1
    cuts = [0, *range(first, n + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def pieces(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        made = encoder()
        for batch in (part for whole in batches for part in slices(whole)):
            rows = [(i, *p) for i, t in enumerate(batch.column("text").to_pylist()) for p in pieces_of(made.encode(t or ""))]
            at, *cols = zip(*rows, strict=True) if rows else ((),) * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def enumerate_patterns(hist: np.ndarray) -> np.ndarray:
    """Rows of up to four lengths (zeros after), longest first, whose sum is within SLACK of the capacity."""
    capacity = len(hist) - 1
    have = np.flatnonzero(hist[:capacity])
    have = have[have > 0]
    if not len(have):
        return np.zeros((0, 4), np.int64)
    # the largest length at hand that is no longer than each size
    fit = np.zeros(capacity + 1, np.int64)
    fit[have] = have
    fit = np.maximum.accumulate(fit)

    def spread(limit: np.ndarray) -> np.ndarray:
        """PARTNERS lengths at hand below each limit, evenly spaced."""
        wanted = limit[:, None] * (np.arange(PARTNERS) + 1) // PARTNERS
        return fit[np.maximum(wanted, 0)]

    rows = []
    room = capacity - have
    rows.append(np.stack([have, fit[np.minimum(room, have)], 0 * have, 0 * have], 1))
    for d in range(1, 4):  # other partners close to the room
        rows.append(np.stack([have, fit[np.minimum(np.maximum(room - d, 0), have)], 0 * have, 0 * have], 1))
    a, b = np.repeat(have, PARTNERS), spread(np.minimum(room, have)).ravel()
    left = capacity - a - b
    c = fit[np.maximum(np.minimum(left, b), 0)]
    rows.append(np.stack([a, b, c, 0 * a], 1))
    a3, b3 = np.repeat(a, PARTNERS), np.repeat(b, PARTNERS)
    c3 = spread(np.minimum(left, b)).ravel()
    d3 = fit[np.maximum(np.minimum(np.repeat(left, PARTNERS) - c3, c3), 0)]
    rows.append(np.stack([a3, b3, c3, d3], 1))
    got = np.unique(-np.sort(-np.concatenate(rows), axis=1), axis=0)
    return got[(got.sum(1) <= capacity) & (got.sum(1) >= capacity - SLACK) & (got[:, 1] > 0)]


def fit_repeats(patterns: np.ndarray, hist: np.ndarray, rounds: int = 150, least: float = 1e-5) -> np.ndarray:
    """Repeat counts x >= 0 that nearly minimise |A x - hist|, by multiplicative updates, until a round lowers the residual by a share of ``least`` or less.

    The residual need not be small: what no pattern takes is packed by best fit.
    """
    if not len(patterns):
        return np.zeros(0)
    target = hist.astype(float)
    target[0] = 0
    weight = (patterns > 0).astype(float)
    up = (target[patterns] * weight).sum(1)
    x = np.full(len(patterns), target.sum() / max(1, weight.sum()))
    last = np.inf
    for _ in range(rounds):
        now = np.bincount(patterns.ravel(), weights=(weight * x[:, None]).ravel(), minlength=len(hist))
        apart = float(np.linalg.norm((now - target)[1:]))
        if last - apart <= least * apart:
            break
        last = apart
        x *= up / np.maximum((now[patterns] * weight).sum(1), 1e-12)
    return x


def best_fit(hist: np.ndarray) -> dict[tuple[int, ...], int]:
    """Patterns and repeats for all pieces of a histogram, longest first, each into the fullest sequence with room."""
    capacity = len(hist) - 1
    room = np.zeros(capacity + 1, np.int64)
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]

    def put(pattern: tuple[int, ...], left: int, n: int) -> None:
        open_[left].append((pattern, n))
        room[left] += n

    for size in np.flatnonzero(hist)[::-1].tolist():
        n = int(hist[size])
        while n:
            found = np.flatnonzero(room[size:])
            if not len(found):
                each = capacity // size
                if whole := n // each:
                    put((size,) * each, capacity - each * size, whole)
                if n % each:
                    put((size,) * (n % each), capacity - n % each * size, 1)
                break
            left = size + int(found[0])
            pattern, k = open_[left].pop()
            take = min(n, k)
            room[left] -= k
            if take < k:
                put(pattern, left, k - take)
            put((*pattern, size), left - size, take)
            n -= take
    out: dict[tuple[int, ...], int] = {}
    for group in open_:
        for pattern, n in group:
            out[pattern] = out.get(pattern, 0) + n
    return out


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that together use up the histogram (index: length, the last: the capacity)."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    out: dict[tuple[int, ...], int] = {}
    patterns = enumerate_patterns(left)
    x = fit_repeats(patterns, left)
    for p in np.argsort(-x, kind="stable"):
        n = int(x[p] + 0.5)
        if not n:
            break
        lengths, uses = np.unique(patterns[p][patterns[p] > 0], return_counts=True)
        n = min(n, int((left[lengths] // uses).min()))
        if n:
            left[lengths] -= n * uses
            key = tuple(int(v) for v in patterns[p] if v)
            out[key] = out.get(key, 0) + n
    for pattern, n in best_fit(left).items():
        out[pattern] = out.get(pattern, 0) + n
    return sorted(out.items())


def places(made: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: the first rank, the sequence it goes to (the next ranks to the next ones) and the offset."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, n in made:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            rows.append((length, rank, base, offset))
            used[length] = rank + n
            offset += length
        base += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return {"key": (cols[0] << 44) + cols[1], "rank": cols[1], "sequence": cols[2], "offset": cols[3]}


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset; parts must be a table that reads alike each time (see ``stored``).

    Pieces as long as a sequence take one each, whose number needs no rank.  The others are ranked within (length, salt) groups,
    as many for a length as its pieces ask for.
    """
    spark, names = parts.sparkSession, parts.columns
    whole = parts.where(F.col("length") == capacity).withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = parts.where(F.col("length") < capacity)
    sizes = rest.groupBy("length").agg(F.count("*").alias("n")).toArrow()
    hist = np.zeros(capacity + 1, np.int64)
    hist[sizes["length"].to_numpy()] = sizes["n"].to_numpy()
    salts = np.maximum(1, -(-hist // max(TOGETHER, int(hist.sum()) // GROUPS)))
    dealt = spark.createDataFrame([(i, int(k)) for i, k in enumerate(salts)], "length long, __salts long")
    salted = rest.join(F.broadcast(dealt), "length").withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("__salts"))).select(*names, "__salt")
    first = np.cumsum(salts) - salts  # each (length, salt) group has a place in one row
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("n")).toArrow()
    n = np.zeros(int(salts.sum()), np.int64)
    n[first[counts["length"].to_numpy()] + counts["__salt"].to_numpy()] = counts["n"].to_numpy()
    before = np.cumsum(n) - n
    before -= np.repeat(before[first], salts)
    sent = spark.sparkContext.broadcast((places(plan(hist)), first, before))
    order = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("__rank", F.row_number().over(order) - 1)

    def run(batches):
        at, first, before = sent.value
        for batch in batches:
            length, salt, rank = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "__salt", "__rank"))
            rank = rank + before[first[length] + salt]
            row = np.searchsorted(at["key"], (length << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(at["sequence"][row] + rank - at["rank"][row]), pa.array(at["offset"][row])], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return mapped(ranked, run, f"{kinds}, sequence_id long, offset long").unionByName(whole)


def op9_packing(docs: DataFrame) -> DataFrame:
    """Every piece of every document and its place in sequences of at most 2,048 tokens."""
    return pack(stored(pieces(docs), "pieces"))
