"""SimHash near-dedup through a byte-position inverted index.

A text's fingerprint has bit b set where over half of its shingles' XXH64 hashes have it.  Two fingerprints
that differ in at most 3 of 64 bits share at least 5 of their 8 positional bytes.  The index posts
each distinct fingerprint under sets of r positional bytes chosen so that any 5 positions hold one
of the sets; in each posting list the shared positional bytes of a pair are tallied, pairs with
fewer than 5 go, and the rest are verified by their differing bits.  r grows with the number of
distinct fingerprints (3, 4 or 5 bytes: 8, 20 or 56 sets), which keeps chance lists short.

Fingerprints in a list longer than ``LONG`` are posted again under all 56 sets of 5 bytes; a list that is still
longer has 3 free bytes, and its members meet at the values within distance 1 of one and 2 of the
other, which are a bounded number for each.  No list is cut and no link is lost; a list's links are
given as a spanning forest.  Components come from alternating star contraction over written tables.

The wide form of the index (``wide_links``) is for texts that differ in more bits than an index of 8 bytes can promise: two sets at a
Jaccard similarity of 0.8 differ in a seventh of their bits.  A fingerprint has 32 groups of 4 bytes (160 from ``MANY`` texts) and is posted under
every 2 (3) bytes of a group, ``TURN`` groups at a time, so that only their postings are on disk; such a pair agrees nowhere with probability 2e-5 (4e-5).  Within a list two fingerprints are linked that differ in ``FAR`` or fewer of
128 bits; ``shared`` is the count filter on all their bytes.

Null and empty texts have fingerprint zero and link like any other; documents with equal fingerprints are
linked; repeated rows are kept; a component's name is its smallest ``doc_id`` (nulls aside; null where all are).  Very long
texts are fingerprinted whole.  An empty table gives no rows.  Other columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import brief_shuffles, mapped, mark, release, slices, stored, unused

BITS, BYTES = 3, 8
SHARED = BYTES - BITS
LONG = 256
SEED = 42
#: Rows that are broadcast at most (of 16 bytes or so each), and edges that one task joins at most.
SMALL, SINGLE = 1_000_000, 250_000
#: Parts of a vertex's edges, which are joined by vertex and part.
SALTS = 16
#: Wide fingerprints: differing bits of the 128 that a posting carries; bytes of 32 groups that a pair at 0.8 shares (34 expected); lists compared at once.
FAR, COUNT, SHORT = 40, 14, 512
#: From so many texts on three bytes are posted, which keeps chance lists short.
MANY = 1 << 24
#: Groups of a wide fingerprint that are posted at once (48 or 32 postings of a text).
TURN = 8


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, unsigned."""
    parts = text.lower().split() if text else []
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    line = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(parts) - words + 1].tolist()
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[part : part + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """Columns of docs other than text, and fp (the fingerprint's bits as a signed long)."""
    names = [c for c in docs.columns if c != "text"]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            got = np.array([fingerprint(t, words) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(got.view(np.int64))], [*names, "fp"])

    return mapped(docs, run, f"{kinds}fp long")


@cache
def position_sets(r: int) -> tuple[tuple[int, ...], ...]:
    """Sets of r byte positions such that any 5 of the 8 positions hold one of them."""
    if r == 3:  # of 5 positions, one half of the 8 holds 3
        return (*combinations(range(4), 3), *combinations(range(4, 8), 3))
    left, chosen = set(combinations(range(BYTES), SHARED)), []
    while left:
        best = max(combinations(range(BYTES), r), key=lambda s: sum(set(s) <= set(x) for x in left))
        chosen.append(best)
        left = {x for x in left if not set(best) <= set(x)}
    return tuple(chosen)


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def postings(fps: DataFrame, sets: tuple[tuple[int, ...], ...]) -> DataFrame:
    """slot (which set), bytes (the fingerprint's bytes at its positions) and fp."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(_mask(s)).cast("long")).alias("bytes")) for i, s in enumerate(sets))))
    return fps.select("fp", each.alias("p")).select("p.slot", "p.bytes", "fp")


def linked(members: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one list that share enough positional bytes and differ in few bits."""
    x = members.view(np.uint64)
    diff = x[:, None] ^ x[None, :]
    tally = (diff.reshape(-1, 1).view(np.uint8) == 0).sum(1).reshape(diff.shape)
    close = (tally >= BYTES - bits) & (np.bitwise_count(diff) <= bits)
    left, out = np.ones(len(x), bool), []
    for i in range(len(x)):
        if left[i]:
            left[i] = False
            front = [i]
            while front:
                j = front.pop()
                near = np.flatnonzero(close[j] & left)
                left[near] = False
                out += [(int(members[j]), int(members[k])) for k in near]
                front += near.tolist()
    return out


def _list_links(lists: DataFrame) -> DataFrame:
    """Links (u, v) within each row's list of at most LONG fingerprints."""

    def run(batches):
        for batch in batches:
            out = []
            for members in batch.column(0).to_pylist():
                if len(members) == 2:
                    d = (members[0] ^ members[1]) & 0xFFFFFFFFFFFFFFFF
                    if sum(not (d >> s) & 255 for s in range(0, 64, 8)) >= SHARED and d.bit_count() <= BITS:
                        out.append(tuple(members))
                else:
                    out += linked(np.array(members, np.int64))
            u, v = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return mapped(lists, run, "u long, v long")


def _split(posts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Posted rows in lists of 2 to LONG, gathered, and the rows of longer lists; only partial counts of a list meet in one task before it is known to be short."""
    posts = stored(posts, name)
    hot = stored(posts.groupBy("slot", "bytes").agg(F.count("*").alias("n")).where(F.col("n") > LONG).select("slot", "bytes"), f"{name}-hot")
    few = hot.count()
    if not few:
        rest, more = posts, posts.limit(0)
    else:
        # a list that is long stays where its rows are: its key goes to them, not they to its key
        hot = F.broadcast(hot) if few <= SMALL else hot
        rest, more = posts.join(hot, ["slot", "bytes"], "left_anti"), posts.join(hot, ["slot", "bytes"], "left_semi")
    lists = rest.groupBy("slot", "bytes").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return lists, more


def _ball(fp, free: list[int], flips: int):
    """Values within ``flips`` differing bits of fp among the free bit positions."""
    masks = [sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(free, k)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.transform(F.array(*(F.lit(m).cast("long") for m in signed)), lambda m: fp.bitwiseXOR(m))


def _meeting_links(rows: DataFrame, sets: tuple[tuple[int, ...], ...]) -> DataFrame:
    """Links within lists too long for tallies: x within 1 bit and y within 2 of one value differ by 3 at most."""
    out = None
    for slot, positions in enumerate(sets):
        free = [8 * p + b for p in range(BYTES) if p not in positions for b in range(8)]
        mine = rows.where(F.col("slot") == slot)
        near = mine.select("bytes", "fp", F.explode(_ball(F.col("fp"), free, 1)).alias("z"), F.lit(True).alias("one"))
        far = mine.select("bytes", "fp", F.explode(_ball(F.col("fp"), free, 2)).alias("z"), F.lit(False).alias("one"))
        met = near.unionByName(far).groupBy("z").agg(F.min(F.when(F.col("one"), F.col("fp"))).alias("u"), F.collect_set("fp").alias("vs"))
        links = met.where("u is not null and size(vs) > 1").select("u", F.explode("vs").alias("v")).where("u <> v")
        out = links if out is None else out.unionByName(links)
    return out


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) of distinct fingerprints (column fp) that connect just those 3 or fewer bits apart."""
    n = fps.count()
    r = 3 if n < 1 << 23 else 4 if n < 1 << 31 else 5
    lists, more = _split(postings(fps, position_sets(r)), "postings")
    found = stored(_list_links(lists), "links")
    long = stored(more.select("fp").distinct(), "long")
    if long.isEmpty():
        return found
    sets = tuple(combinations(range(BYTES), SHARED))
    lists, more = _split(postings(long, sets), "postings5")
    found = found.unionByName(_list_links(lists))
    more = stored(more, "long5")
    return found if more.isEmpty() else found.unionByName(_meeting_links(more, sets))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def width(n: int) -> int:
    """Words of 64 bits in the wide fingerprints of n texts: two groups of 4 bytes each."""
    return 16 if n < MANY else 80


def wide(hashes: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of several words: each hash is mixed anew for each word, and a bit is set where over half of the hashes have it."""
    step = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    count = np.zeros(64 * words, np.int64)
    for part in range(0, len(hashes), 255):  # so many fit a byte
        mixed = _mix(hashes[part : part + 255, None].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + step)
        count += np.add.reduce(np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")


def vertices(bits: np.ndarray) -> np.ndarray:
    """A name for each wide fingerprint, from the 128 bits that postings carry."""
    return _mix(bits[:, 0] ^ _mix(bits[:, 1] + np.uint64(SEED)))


def shared(x: np.ndarray, y: np.ndarray):
    """The count filter: whether fingerprints (bytes, one or many of them) share as many positional bytes as near copies do."""
    return (x == y).sum(-1) >= COUNT * x.shape[-1] // 128


def wide_keys(bits: np.ndarray, first: int = 0, many: int | None = None) -> np.ndarray:
    """Posting keys of each row's fingerprint, of ``many`` groups from ``first``: the slot (which bytes of which group) and the bytes."""
    r = 2 if bits.shape[1] == width(0) else 3
    groups = bits.astype("<u8").view(np.uint8).reshape(len(bits), -1, 4)[:, first : None if many is None else first + many].astype(np.int64)
    sets = list(combinations(range(4), r))
    keys = np.zeros((len(bits), groups.shape[1], len(sets)), np.int64)
    for i, positions in enumerate(sets):
        for p in positions:
            keys[:, :, i] = keys[:, :, i] << 8 | groups[:, :, p]
    keys += (np.arange(first, first + groups.shape[1])[:, None] * len(sets) + np.arange(len(sets))) << (8 * r)
    return keys.reshape(len(bits), -1)


def close_pairs(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows i and j of sorted keys that lie close in a list, their differing bits, and whether they are of a forest.

    Short lists give all such pairs; long ones, and those full of close pairs, the pairs of a forest with the same components.
    """
    if not len(key):
        return (np.zeros(0, np.int32),) * 3 + (np.zeros(0, bool),)
    a, b = a.view(np.uint64), b.view(np.uint64)  # the bits of a signed number are those of its absolute value
    apart = lambda i, j: np.bitwise_count(a[i] ^ a[j]) + np.bitwise_count(b[i] ^ b[j])
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    ends = np.append(starts[1:], len(key))
    sizes, out = ends - starts, []
    which = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
    end, long, full = ends[which].astype(np.int32), sizes > SHORT, np.zeros(len(starts), np.int64)
    d, i = 1, np.flatnonzero(~long[which]).astype(np.int32)
    while len(i := i[i + d < end[i]]):
        far = apart(i, i + d)
        near = far <= FAR
        out.append((i[near], i[near] + np.int32(d), far[near], np.zeros(near.sum(), bool)))
        if d <= 4:
            full += np.bincount(which[i[near]], minlength=len(full))
        if d == 4:
            long |= (sizes > 8) & (full > sizes)
            i = i[~long[which[i]]]
        d += 1
    out = [tuple(x[~long[which[o[0]]]] for x in o) for o in out]
    for start, stop in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        left = np.arange(start, stop, dtype=np.int32)
        while len(left):
            front, left = [left[0]], left[1:]
            while front and len(left):
                x = front.pop()
                far = apart(x, left)
                near = far <= FAR
                out.append((np.full(near.sum(), x, np.int32), left[near], far[near], np.ones(near.sum(), bool)))
                front += left[near & (far > 0)].tolist()
                left = left[~near]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int32),) * 3 + (np.zeros(0, bool),)


def wide_links(prints: DataFrame, n: int) -> DataFrame:
    """Links (u, v), their differing bits d and forest, that connect the wide fingerprints (column bits) which share a list of the index and differ in few bits.

    Without forest, a link stands for itself alone; with it, for all that its list connects, so it may not be dropped.
    Lists are read in order of their keys, a batch at a time, and a list is held whole only while it is read.  Groups take turns: the links of a turn are written before the next is posted.
    """
    words = width(n)

    def posted(first):
        def post(batches):
            for batch in batches:
                raw = batch.column(0)
                for part in range(0, len(raw), 256):
                    bits = np.frombuffer(b"".join(raw.slice(part, 256).to_pylist()), "<u8").reshape(-1, words)
                    keys = wide_keys(bits, first, TURN)
                    a, b = (np.repeat(bits[:, i], keys.shape[1]).view(np.int64) for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(a), pa.array(b)], ["key", "a", "b"])

        return mapped(prints.select("bits"), post, "key long, a long, b long")

    def made(key, a, b):
        i, j, d, forest = close_pairs(key, a, b)
        name = vertices(np.stack([a, b], 1).view(np.uint64)).view(np.int64)
        u, v = np.minimum(name[i], name[j]), np.maximum(name[i], name[j])
        new = u != v
        return pa.RecordBatch.from_arrays([pa.array(u[new]), pa.array(v[new]), pa.array(d[new].astype(np.int32)), pa.array(forest[new])], ["u", "v", "d", "forest"])

    def run(batches):
        held: list = []
        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(3)]
            if not len(new[0]):
                continue
            cut = int(np.searchsorted(new[0], new[0][-1]))
            if not cut and held and held[-1][0][-1] == new[0][0]:
                held.append(new)  # a long list goes on
                continue
            held.append([x[:cut] for x in new])
            yield made(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = [[x[cut:] for x in new]]
        if held:
            yield made(*(np.concatenate(x) for x in zip(*held, strict=True)))

    once = lambda links: links.groupBy("u", "v", "d").agg(F.max("forest").alias("forest"))

    def turn(first):
        lists = posted(first).repartition("key").sortWithinPartitions("key")
        return stored(once(mapped(lists, run, "u long, v long, d int, forest boolean")), "turn")

    return once(reduce(DataFrame.unionByName, [turn(first) for first in range(0, 2 * words, TURN)]))


def _forest(edges: DataFrame) -> DataFrame:
    """The same connections with fewer rows: each task joins its own edges and points vertices at the smallest."""

    def run(batches):
        up: dict[int, int] = {}

        def root(x):
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        def flush():
            pairs = [(x, root(x)) for x in up]
            pairs = [p for p in pairs if p[0] != p[1]]
            up.clear()
            u, v = zip(*pairs, strict=True) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                up.setdefault(u, u)
                up.setdefault(v, v)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > 500_000:
                yield flush()
        yield flush()

    return mapped(edges, run, "u long, v long")


def _with_least(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges (u, v) with what ``low`` has for u; a vertex's edges are dealt by salt, so that a hub is not one task."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(low.withColumn("salt", salts), ["u", "salt"]).drop("salt")


def components(edges: DataFrame, single: int = SINGLE) -> DataFrame:
    """node and root (its component's smallest node) for every node of the edges (u, v).

    Each task joins its own edges; then alternating stars over written tables, until ``single`` edges at most are left, which one
    task joins, or until all edges are stars.
    """
    keep = mark()
    edges = stored(_forest(edges.select("u", "v")), "stars")
    while True:
        if edges.count() <= single:
            edges = stored(_forest(edges.coalesce(1)), "stars")
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_least(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        # after the large star every v is below its u: the small star points u and its neighbours at the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, low).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before = mark()
        new = stored(_forest(small), "small")
        release(keep | (mark() - before))  # what earlier rounds wrote is read no more
        # done when every node has one edge and points at a node that has none
        many = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        inner = new.select("u").join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        edges = new
        if many.unionByName(inner).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """Columns of docs other than text, fp, root (a fingerprint that only this component has) and component_id."""
    rows = stored(fingerprints(docs, words), "fingerprints")
    first = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(first.select("fp")))
    named = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named, "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select(*[c for c in rows.columns if c != "fp"], "fp", "root", "component_id")


def op8_simhash(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id that links reach."""
    got = near_duplicates(docs.select("doc_id", "text"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 3, grouped=near_duplicates) -> DataFrame:
    """The rows of docs, all columns, that stand first in their group: smallest doc_id, then smallest text hash, then smallest hash of all columns.

    Of rows equal in all columns one stays.  ``grouped`` gives the rows' groups as root.
    """
    h, row = unused(docs, "h"), unused(docs, "row")
    whole = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    hashed = docs.withColumn(h, F.xxhash64("text")).withColumn(row, F.xxhash64(*whole))
    before = mark()
    with brief_shuffles(docs.sparkSession):
        groups = grouped(hashed.select("doc_id", F.col(h).alias("h"), F.col(row).alias("row"), "text"), words)
        # component_id is null or shared where doc_ids are; groups have few columns, and only the chosen keys, one for each group, go to the rows
        first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "row")).alias("first"))
        first = stored(first.select(F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h"), F.col("first.row").alias("first_row")), "first")
    release(before | {x for x in mark() if "marketlab-first-" in x})
    # doc_ids are compared beside the join's keys: so rows, with their texts, are dealt once for the join and the duplicates
    same = F.coalesce(hashed["doc_id"] == first["first_id"], hashed["doc_id"].isNull() & first["first_id"].isNull())
    kept = hashed.join(first, (hashed[h] == first["first_h"]) & (hashed[row] == first["first_row"]) & same, "left_semi")
    return kept.dropDuplicates(["doc_id", h, row]).drop(h, row)
