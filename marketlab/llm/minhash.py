"""Near copies by word shingles: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more are linked.

Candidates come from op8's operator, the byte-position inverted index over SimHash fingerprints, in its wide form (``simhash.wide_links``),
whose star components are clusters: lists, bits, the count filter on all bytes, components.  An exact check follows inside each cluster, on the whole sets.  A text is first held against the others of
its fingerprint, against its nearest neighbour in the index and against its cluster's hub.  Where these links leave a cluster in several
components, each text outside the cluster's largest one is held against every text of another component: as pairs in a short cluster, in blocks
in a long one, until it is linked.  So pairs within a component are not made, and no list or cluster is cut.

Of a pair at 0.8 the index finds all but 2 in 100,000 (more similar ones are missed less), and the count filter before the sets are compared drops
fewer than 1.  A text of fewer words than a shingle is one shingle; null and empty texts have the empty set and are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm import simhash
from marketlab.llm.common import mapped, slices, stored, unused
from marketlab.llm.simhash import SEED, components

WORDS, LEAST = 5, 0.8
#: Texts of a cluster whose pairs are made rows; longer ones are compared block by block.
LONG, BLOCK = 64, 512
#: Sets up to this size are compared without the count filter.
TINY = 8
#: Bits for each text that is to be fetched again, and bits at most (as a power of two: 32 MB).
SPARSE, MOST_BITS = 32, 28


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a text's word shingles; so few bits mistake a shingle in a few million comparisons."""
    parts = text.lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint32)
    line, one = b" ".join(parts), xxhash.xxh32_intdigest
    if len(parts) <= words:
        return np.array([one(line, SEED)], np.uint32)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(parts) - words + 1].tolist()
    return np.unique(np.array([one(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint32))


def marked(keys: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the leading bits of n hashes (column t): theirs are set, and of other hashes one in ``SPARSE`` at most is found in it, more only past its largest size."""
    width = min(MOST_BITS, max(6, (SPARSE * n).bit_length()))
    lead = keys.select(F.shiftrightunsigned("t", 64 - width).alias("lead"))
    got = lead.groupBy(F.shiftright("lead", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(lead & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (width - 6), np.uint64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def among(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which hashes' leading bits are set."""
    lead = hashes.view(np.uint64) >> np.uint64(65 - (64 * len(bitmap)).bit_length())
    return (bitmap[lead >> np.uint64(6)] >> (lead & np.uint64(63)) & np.uint64(1)).astype(bool)


def printed(docs: DataFrame, words: int = WORDS, width: int = 16, whole: bool = False, bitmap: np.ndarray | None = None) -> DataFrame:
    """Columns of docs other than text, node (a hash of the set), size, bits (the wide fingerprint), vertex (its name in the index) and also.

    ``also`` names the fingerprints that a set of five has without one of its shingles: so short a set differs in too many bits from one at 0.8.
    With ``whole`` the shingles too.  With a bitmap only texts whose hash (column t) is in it: they are told apart where they are read, and no text is dealt.
    """
    own = {"text"} if bitmap is None else {"text", "t"}
    names = [c for c in docs.columns if c not in own]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name not in own)

    def run(batches):
        for batch in (part for whole_batch in batches for part in slices(whole_batch)):
            if bitmap is not None:
                batch = batch.filter(pa.array(among(batch.column("t").to_numpy(), bitmap)))
            sets = [shingles(t, words) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            raw = [s.astype("<u4").tobytes() for s in sets]
            node = np.array([xxhash.xxh64_intdigest(r, SEED) for r in raw], np.uint64).view(np.int64)
            bits = np.array([simhash.wide(s, width) for s in sets], np.uint64).reshape(-1, width)
            also = [simhash.vertices(np.array([simhash.wide(np.delete(s, i), width) for i in range(5)])).view(np.int64).tolist() if len(s) == 5 else [] for s in sets]
            made = [pa.array(node), pa.array([len(s) for s in sets], pa.int32()), pa.array([b.astype("<u8").tobytes() for b in bits], pa.binary()), pa.array(simhash.vertices(bits).view(np.int64)), pa.array(also, pa.list_(pa.int64()))]
            more = [pa.array(raw, pa.binary())] if whole else []
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made, *more], [*names, "node", "size", "bits", "vertex", "also", *["shingles"][: len(more)]])

    return mapped(docs, run, f"{kinds}node long, size int, bits binary, vertex long, also array<long>{', shingles binary' if whole else ''}")


def similar(x: np.ndarray, y: np.ndarray, least: float = LEAST) -> bool:
    few, many = sorted((len(x), len(y)))
    if few < least * many:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (few + many - both)


def _held(pairs: DataFrame, sets: DataFrame, columns: list[str], test) -> DataFrame:
    """The pairs (u, v, further columns) of which ``test`` holds for the columns of both."""
    names = pairs.columns
    named = lambda x: sets.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                good = [test(x) for x in zip(*(part.column(i).to_pylist() for i in range(len(names), part.num_columns)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(n).filter(pa.array(good, pa.bool_())) for n in names], names)

    both = pairs.join(named("u"), "u").join(named("v"), "v").select(*names, *(f"{c}_{x}" for c in columns for x in "uv"))
    return mapped(both, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema))


def counted(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (u, v) that share enough bytes of their fingerprints; sizes come first, and only fingerprints are dealt, not sets.

    Members that stand for several (column several) keep all their pairs.
    """

    def test(x):
        few, many = sorted(x[2:4])
        return x[0] or x[1] or few >= LEAST * many and (few <= TINY or bool(simhash.shared(np.frombuffer(x[4], np.uint8), np.frombuffer(x[5], np.uint8))))

    return _held(pairs, members, ["several", "size", "bits"], test)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""
    return _held(pairs, sets, ["shingles"], lambda x: similar(np.frombuffer(x[0], "<u4"), np.frombuffer(x[1], "<u4")))


def _block_links(rows: DataFrame, outside: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) of texts outside a long cluster's largest component, ``BLOCK`` of them and of the cluster's texts at a time.

    A task compares two blocks without making their pairs rows: what it has linked already is not compared.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    at = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    mine = outside.select("cluster", "node", "root", at("o").alias("i"), every("k").alias("j"), F.lit(True).alias("out"))
    all_ = rows.select("cluster", "node", "root", every("o").alias("i"), at("k").alias("j"), F.lit(False).alias("out"))
    both = mine.unionByName(all_).join(sets.select("node", "shingles", "bits"), "node")

    def compare(table: pa.Table) -> pa.Table:
        node, root, out = (table.column(c).to_pylist() for c in ("node", "root", "out"))
        sets = [np.frombuffer(x, "<u4") for x in table.column("shingles").to_pylist()]
        bits = np.array([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        size = np.array([len(x) for x in sets])
        up = {r: r for r in root}

        def top(r):
            while up[r] != r:
                up[r] = up[up[r]]
                r = up[r]
            return r

        found, theirs = [], np.array([i for i, x in enumerate(out) if not x], int)
        for a in (i for i, x in enumerate(out) if x):
            near = simhash.shared(bits[theirs], bits[a]) | (np.minimum(size[theirs], size[a]) <= TINY)
            near &= np.minimum(size[theirs], size[a]) >= LEAST * np.maximum(size[theirs], size[a])
            for b in theirs[near].tolist():
                if top(root[a]) != top(root[b]) and similar(sets[a], sets[b]):
                    found.append((node[a], node[b]))
                    up[top(root[a])] = top(root[b])
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return both.groupBy("cluster", "i", "j").applyInArrow(compare, "u long, v long")


def _named(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with root, the component of their nodes."""
    return rows.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")) if not links.isEmpty() else rows.withColumn("root", F.col("node"))


def _tried(members: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs (u, v) that are compared first: with the first of the same fingerprint, the nearest neighbour and the hub."""
    first = members.groupBy("vertex").agg(F.min("node").alias("node"), F.first("cluster").alias("cluster"))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"))
    around = both.groupBy("u").agg(F.min(F.struct("d", "v")).alias("near"), F.count("*").alias("degree")).select(F.col("u").alias("vertex"), "near.v", "degree")
    first = stored(first.join(around, "vertex", "left"), "vertices")
    named = lambda x, y: first.select(F.col("vertex").alias(x), F.col("node").alias(y))
    same = members.select("vertex", "node").join(named("vertex", "other"), "vertex").select("node", "other")
    nearest = first.where("v is not null").select("node", "v").join(named("v", "other"), "v").select("node", "other")
    hub = first.groupBy("cluster").agg(F.max(F.struct("degree", "node")).alias("hub")).select("cluster", F.col("hub.node").alias("other"))
    pairs = same.unionByName(nearest).unionByName(members.select("cluster", "node").join(hub, "cluster").select("node", "other"))
    return pairs.where("node <> other").select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()


def near_copies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Columns of docs other than text, and root, which names the component."""
    t, n = unused(docs, "t"), docs.count()
    width = simhash.width(n)
    texts = docs.withColumn(t, F.xxhash64("text"))
    rows = stored(printed(texts, words, width), "prints")
    # copies have one set: of each only the first goes on
    nodes = stored(rows.groupBy("node").agg(F.min(t).alias("t"), *(F.first(c).alias(c) for c in ("size", "bits", "vertex", "also"))), "nodes")
    found = stored(simhash.wide_links(nodes.where("size > 0"), n), "found")
    each = nodes.groupBy(F.col("vertex").alias("node")).agg((F.count("*") > 1).alias("several"), F.first("size").alias("size"), F.first("bits").alias("bits"))
    edges = counted(found.where("not forest").drop("forest"), each).unionByName(found.where("forest").drop("forest"))
    edges = edges.unionByName(nodes.select(F.col("vertex").alias("u"), F.explode("also").alias("v"), F.lit(simhash.FAR + 1).alias("d")))
    edges = stored(edges, "edges")
    slim = rows.drop("size", "bits", "vertex", "also", t)
    if edges.isEmpty():
        named = nodes.drop("also").withColumn("cluster", F.col("vertex"))
    else:
        clusters = components(edges.select("u", "v")).select(F.col("node").alias("vertex"), F.col("root").alias("cluster"))
        named = nodes.drop("also").join(clusters, "vertex", "left").withColumn("cluster", F.coalesce("cluster", "vertex"))
    named = stored(named, "clusters")
    several = named.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    members = stored(named.join(several, "cluster", "left_semi").withColumn("several", F.lit(False)), "members")
    again = texts.select("text", F.col(t).alias("t"))
    sets = printed(again, words, width, True, marked(members, members.count())).groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("bits").alias("bits"))
    sets = stored(sets.join(members.select("node"), "node", "left_semi"), "sets")
    pair = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    tried = stored(_tried(members, edges), "tried")
    links = stored(verified(stored(counted(tried, members), "counted"), sets), "near")
    named = stored(_named(members.select("cluster", "node", "size"), links), "named")
    # the largest component of each cluster that has several
    each = named.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    most = each.groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("k"), F.count("*").alias("roots")).where("roots > 1")
    most = stored(most.select("cluster", F.col("most.root").alias("main"), "k", (F.col("k") - F.col("most.n")).alias("o")), "several")
    inside = stored(named.join(most, "cluster"), "inside")
    outside = inside.where("root <> main")
    # in a short cluster a text has LONG partners at most
    short, other = (x.where(F.col("k") <= LONG).select("cluster", "node", "root", "size") for x in (inside, outside))
    rest = short.join(other.withColumnsRenamed({"node": "node2", "root": "root2", "size": "size2"}), "cluster").where((F.col("root") != F.col("root2")) & (F.least("size", "size2") >= F.greatest("size", "size2") * LEAST))
    rest = rest.select(*pair("node", "node2")).distinct().join(tried, ["u", "v"], "left_anti")
    rest = stored(counted(rest, members), "rest")
    links = links.unionByName(verified(rest, sets)).unionByName(_block_links(inside.where(F.col("k") > LONG), outside.where(F.col("k") > LONG), sets))
    return _named(slim, stored(links, "all-near"))
