"""The operators against brute force, round trips and edge cases."""

import hashlib
import os
import random
import struct
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from marketlab.llm import chat, decontaminate, line_dedup, media, packing, quality, simhash, suffix_tree, token_counts, toxicity
from marketlab.llm.common import mapped
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, key string"
EDGE = [
    (1, "A line\nshared line here\nthe cat sat on the mat"),
    (2, "a LINE \nother words follow here on this line"),
    (2, "a LINE \nother words follow here on this line"),
    (3, None),
    (4, ""),
    (None, "no identifier at all"),
    (None, None),
    (5, " \t\n\n \x0b"),
    (6, "long " * 30_000),
    (7, "日本語 テキスト 💩 é ▁ <|endoftext|> <s>"),
    *((10 + i, f"A line\nbody {i} of the document with words") for i in range(12)),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", "s", None, 0.5, 1, "k") for i, t in EDGE], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i % 5 == 0)) for i in range(40)] + [(1, 1, 0), (None, 1, 1), (99, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def operators(labels, spark):
    bench = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None), (3, ""), (4, "..."), (5, "body 99 of the document with words")], "item_id long, text string")
    return {
        "op1": suffix_tree.op1_suffix_tree, "op3": media.op3_png, "op4": token_counts.op4_token_counts, "op5": lambda d: decontaminate.op5_decontaminate(d, bench),
        "op6": lambda d: toxicity.op6_toxicity(d, labels), "op7": line_dedup.op7_line_dedup, "op8": simhash.op8_simhash, "op9": packing.op9_packing, "op10": lambda d: quality.op10_quality(d, labels),
    }


@pytest.mark.parametrize("name", ["op1", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_edges_and_empty_tables(spark, edge, none, labels, name):
    made = operators(labels, spark)[name]
    rows = made(edge).collect()
    if name not in ("op5", "op9"):
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in EDGE)
    if name == "op9":
        assert {r.doc_id for r in rows} == {i for i, _ in EDGE}
    assert made(none).collect() == []


def test_empty_labels_and_benchmark(spark, edge, labels):
    few = labels.limit(0)
    assert {r.score for r in quality.op10_quality(edge, few).collect()} == {0.5}
    assert {r.score for r in toxicity.op6_toxicity(edge, few).collect()} == {0.5}
    assert decontaminate.op5_decontaminate(edge, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_lines(spark, edge):
    got = {r.doc_id: r for r in line_dedup.op7_line_dedup(edge.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert (got[10].n_lines, got[10].n_dropped) == (2, 1)
    assert (got[1].n_lines, got[1].n_dropped) == (3, 1)
    assert (got[4].n_lines, got[4].n_dropped) == (1, 0)
    rows = edge.select("doc_id", "text", "source")
    keys = line_dedup.condemned_keys(rows)
    a, b = (sorted(map(str, line_dedup.drop_lines(rows, keys, broadcast_keys=n).collect())) for n in (0, 100))
    assert a == b


def test_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, 3)
    frame = lambda *x: spark.createDataFrame([(bytearray([k]), n) for k, n in x], "key binary, n long")
    for batch in (frame((1, 2), (2, 1)), frame((1, 1), (3, 2)), frame((1, 5), (2, 1)), frame((2, 1), (4, 3))):
        runs.add(batch)
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert {bytes(r.key)[0]: r.n for r in runs.totals().collect()} == {1: 3, 2: 3, 3: 2, 4: 3}
    assert {bytes(r.key)[0] for r in runs.condemned().collect()} == {1, 2, 4}
    runs.close()
    assert spark.catalog.listTables() == []


def test_runs_merge_without_shuffle_or_sort(spark):
    runs = line_dedup.LineRuns(spark, 3, fanout=9)
    for k in range(3):
        runs.add(spark.createDataFrame([(bytearray([i]), 1) for i in range(k, 20 + k)], "key binary, n long"))
    with runs._in_order():
        a, b = (runs._read(x).select("key", "n") for x in runs.levels[0][:2])
        plan = a.join(b.withColumnRenamed("n", "m").hint("merge"), "key", "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert runs.condemned().count() == 18
    runs.close()


def brute_fingerprint(text):
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", "one", "one two", "One two THREE four two three four", "a b c " * 50):
        assert simhash.fingerprint(text.encode() if text else None) == brute_fingerprint(text)


def test_position_sets_cover():
    for r in (3, 4, 5):
        assert all(any(set(s) <= set(five) for s in simhash.position_sets(r)) for five in combinations(range(8), 5))


@pytest.mark.parametrize("long", [256, 6])
def test_components_match_brute_force(spark, monkeypatch, long):
    monkeypatch.setattr(simhash, "LONG", long)
    rule = random.Random(5)
    fps = {rule.getrandbits(64) for _ in range(120)}
    for center in list(fps)[:12]:
        for _ in range(25):
            x = center
            for _ in range(rule.randint(1, 4)):
                x ^= 1 << rule.randrange(64)
            fps.add(x)
    center = rule.getrandbits(64)
    fps |= {center ^ 1 << a ^ 1 << b for a in range(24) for b in range(24)}
    fps = sorted(fps)
    x = np.array(fps, np.uint64)
    group = list(range(len(x)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3):
            a, b = root(i), root(int(j))
            group[max(a, b)] = min(a, b)
    want = Counter(frozenset(k for k in range(len(x)) if root(k) == r) for r in {root(i) for i in range(len(x))})
    signed = x.view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    by = {}
    for k, v in enumerate(signed):
        by.setdefault(roots.get(v, v), set()).add(k)
    assert Counter(map(frozenset, by.values())) == want


@pytest.mark.parametrize("single", [0, 250_000])
def test_chain_components(spark, single):
    """A chain, a hub and a pair, by rounds of stars and by one task."""
    rule = random.Random(1)
    nodes = list(range(60))
    rule.shuffle(nodes)
    pairs = [*zip(nodes, nodes[1:], strict=False), *((100, 101 + i) for i in range(80)), (300, 299)]
    frame = spark.createDataFrame(pairs, "u long, v long").repartition(8)
    got = {r.node: r.root for r in simhash.components(frame, single).collect()}
    assert got == dict.fromkeys(range(60), 0) | dict.fromkeys(range(100, 181), 100) | {299: 299, 300: 299}


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(3, text, "x"), (1, text, "y"), (1, text, "y"), (2, "other " * 20, "z"), (None, text, "n")], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [1, 2]


def test_one_of_each_keeps_unrelated_texts_without_a_doc_id_of_their_own(spark):
    texts = [" ".join(f"{k}{i}" for i in range(200)) for k in "abcde"]
    docs = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4])], "doc_id long, text string")
    assert sorted(r.text for r in simhash.one_of_each(docs).collect()) == texts


@pytest.mark.parametrize(("long", "block"), [(64, 512), (3, 8)])
def test_near_duplicate_stage_finds_edited_copies(spark, monkeypatch, long, block):
    """One of each group that similarities of 0.8 chain together, whether buckets are compared as pairs or in blocks."""
    import corpus_pipeline
    from marketlab.llm import minhash

    monkeypatch.setattr(minhash, "LONG", long)
    monkeypatch.setattr(minhash, "BLOCK", block)

    rule = random.Random(6)
    texts = [[f"w{rule.randrange(10**6)}" for _ in range(200)] for _ in range(40)]

    def edited(words, n):
        out = list(words)
        for at in rule.sample(range(0, 200, 10), n):
            out[at] = f"x{rule.randrange(10**6)}"
        return out

    rows = [*texts, *(edited(t, 1 + i % 4) for i, t in enumerate(texts[:20])), *(edited(t, 10) for t in texts[20:])]
    rows += [edited(texts[0], 3) for _ in range(30)]
    rows += [edited(texts[1], 6) for _ in range(25)]  # near the first, mostly not near each other
    sets = [set(minhash.shingles(" ".join(t).encode()).tolist()) for t in rows]
    group = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    assert got == sorted(set(group))


@pytest.mark.parametrize("short", [512, 3])
def test_near_duplicate_stage_takes_its_candidates_from_the_byte_position_index(spark, monkeypatch, short):
    """Every pair at 0.8 is linked by op8's index in its wide form, and without the index's links no text finds another."""
    import corpus_pipeline
    from marketlab.llm import minhash

    monkeypatch.setattr(simhash, "SHORT", short)
    rule = random.Random(7)
    texts = [[f"w{rule.randrange(10**6)}" for _ in range(n)] for n in (8, 9, 12, 40, 200, 900) for _ in range(6)]
    rows = [*texts, *([*t, "more"] for t in texts), *([*t[: len(t) // 2], "other", *t[len(t) // 2 + 1 :]] for t in texts), *([*texts[30], *(f"y{rule.randrange(10**6)}" for _ in range(k))] for k in range(40))]
    sets = [minhash.shingles(" ".join(t).encode()) for t in rows]
    bits = np.array([simhash.wide(s, simhash.width(len(rows))) for s in sets])
    assert (simhash.wide(sets[0], 16)[0] >> np.uint64(5) & np.uint64(1)) == (2 * sum(int(simhash._mix(np.array([int(h) * 0xD6E8FEB86659FD93 + 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64))[0]) >> 5 & 1 for h in sets[0]) > len(sets[0]))
    names = simhash.vertices(bits).view(np.int64).tolist()
    links = simhash.wide_links(spark.createDataFrame([(bytearray(b.tobytes()),) for b in bits], "bits binary"), len(rows))
    group = {r.node: r.root for r in simhash.components(links).collect()}
    near = [(a, b) for a, b in combinations(range(len(rows)), 2) if minhash.similar(sets[a], sets[b]) and min(len(sets[a]), len(sets[b])) > 4]
    assert len(near) > 500 and all(names[a] == names[b] or group.get(names[a], a) == group.get(names[b], b) for a, b in near)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert kept.isdisjoint(range(36, 72)) and set(range(36)) <= kept  # eight words and nine too
    real = simhash.wide_links
    monkeypatch.setattr(simhash, "wide_links", lambda prints, n: real(prints, n).limit(0))
    long = [i for i, t in enumerate(rows) if len(" ".join(t)) > 200]
    # only those of one fingerprint still meet
    assert corpus_pipeline.near_duplicate_stage(spark, docs.where("length(text) > 200"), "").count() == len({names[i] for i in long})


def test_near_duplicate_stage_deals_texts_once_and_keeps_no_shuffle_files(spark):
    """Of what finding the groups shuffles nothing stays on disk, texts are dealt for the choice of rows alone, and candidates' texts are found by a bitmap."""
    import corpus_pipeline

    rule = random.Random(8)
    texts = [" ".join(f"w{rule.randrange(10**6)}" for _ in range(60)) for _ in range(1000)]
    rows = [(i, t) for i, t in enumerate([*texts, *(t + " more" for t in texts[:300]), *texts[300:310]])]
    docs = spark.createDataFrame([*rows, (None, texts[0]), (None, "none"), (5, texts[5])], "doc_id long, text string")
    files = lambda: {f.getPath(): f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
    before = files()
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    left = sum(n for f, n in files().items() if f not in before and "shuffle" in f)
    assert left < 50_000  # the postings alone are some MB
    joined = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the chosen keys are many
    try:
        plan = out.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joined)
    assert sum("Exchange hashpartitioning" in line for line in plan.split("\n")) == 2  # the rows once, the chosen keys once
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [*((False, i) for i in range(1000)), (True, 0)]


def test_bitmap_of_hashes(spark):
    """Every marked hash is found, of others one in SPARSE or so, and the turns of the index post each text as often as all groups at once."""
    from marketlab.llm import minhash

    rule = np.random.default_rng(9)
    mine, others = (rule.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64) for _ in range(2))
    mine[:2] = -1, 0
    for n in (1, 70, 5000):
        bitmap = minhash.marked(spark.createDataFrame([(int(x),) for x in mine[:n]], "t long"), n)
        assert minhash.among(mine[:n], bitmap).all() and minhash.among(others, bitmap).mean() < 2 / minhash.SPARSE
    assert not minhash.among(others, minhash.marked(spark.createDataFrame([], "t long"), 0)).any()
    for words in (16, 80):
        bits = rule.integers(0, 1 << 63, (3, words), dtype=np.uint64)
        turns = [simhash.wide_keys(bits, first, simhash.TURN) for first in range(0, 2 * words, simhash.TURN)]
        assert (np.concatenate(turns, 1) == simhash.wide_keys(bits)).all()


def filtered_png(samples, kind):
    height, width = samples.shape
    body, prior = b"", [0] * width
    for row in samples.tolist():
        out = []
        for x, v in enumerate(row):
            a, b, c = row[x - 1] if x else 0, prior[x], prior[x - 1] if x else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        body += bytes([kind, *out])
        prior = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def filtered_rows(samples, kind):
    """Filtered rows without their filter bytes, from the PNG that ``filtered_png`` makes."""
    stream = b"".join(body for name, body in media.chunks(filtered_png(samples, kind)) if name == b"IDAT")
    return np.frombuffer(zlib.decompress(stream), np.uint8).reshape(len(samples), -1)[:, 1:]


def test_png_round_trip_and_damage():
    rule = np.random.default_rng(0)
    for shape in ((12, 48), (1, 1), (5, 7, 3), (40, 33, 4)):
        samples = rule.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode(samples)) == samples).all()
    samples = rule.integers(0, 256, (9, 13), dtype=np.uint8)
    for kind in range(5):
        assert (media.decode(filtered_png(samples, kind)) == samples).all()
    kinds = np.array([4, 3, 3, 2, 4, 1, 0, 4, 2])
    mixed = np.stack([media.decode(filtered_png(samples, 0))[i] for i in range(9)])
    body = np.stack([filtered_rows(samples, int(k))[i] for i, k in enumerate(kinds)])
    assert (media.unfilter(body, kinds, 1) == mixed).all()
    data = media.encode(samples)
    for at in (3, 20, 50, len(data) - 2):
        with pytest.raises(media.MediaError):
            media.decode(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(media.MediaError):
        media.decode(data[:-5])
    assert len(media.payload(b"")) == 576 and len(media.payload(b"x" * 576)) == 576 and len(media.payload(b"x" * 577)) == 1152


def test_png_columns_by_definition(spark):
    """Every column of the query from the text alone; the binary column holds a PNG that gives the payload back."""
    texts = [None, "", "x", "é" * 287 + "ab", "y" * 576, "z" * 577, "long " * 20_000, "x"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, png int")
    rows = {r.doc_id: bytes(r.png) for r in media.with_png(docs.drop("png")).collect()}
    for r in media.op3_png(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        whole = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        stored = rows[r.doc_id]
        samples = media.decode(stored)
        assert samples.tobytes() == whole and samples.shape == (len(whole) // 48, 48)
        assert tuple(r) == (r.doc_id, len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), media.dct_hash(samples))


def test_hash_by_definition():
    """Cells averaged and the cosine transform summed by loops."""
    samples = np.random.default_rng(4).integers(0, 256, (64, 96), dtype=np.uint8)
    small = samples.reshape(32, 2, 32, 3).mean((1, 3))
    term = lambda u, v: sum(small[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32))
    low = np.array([term(u, v) for u in range(8) for v in range(8)]).round(6)
    assert media.dct_hash(samples) == f"{int(''.join('1' if x > np.median(low[1:]) else '0' for x in low), 2):016x}"


def test_dct_hash_keeps_its_low_frequencies():
    rule = np.random.default_rng(0)
    image = np.kron(rule.integers(0, 256, (8, 8)), np.ones((12, 12))).astype(np.uint8)
    noisy = np.clip(image + rule.integers(-2, 3, image.shape), 0, 255).astype(np.uint8)
    other = rule.integers(0, 256, image.shape, dtype=np.uint8)
    bits = lambda a, b: (int(media.dct_hash(a), 16) ^ int(media.dct_hash(b), 16)).bit_count()
    assert bits(image, image) == 0 and bits(image, noisy) < bits(image, other)


PARTS = ["a", "b", " ", " ", "  ", "\n", "▁", "\t", "é", "<s>", "<|endoftext|>", "the", "ing", "　", "\xa0", "中", "12", ".", "'s", "\r\n", "!?", "\x1c", "💩", ");\r"]


def test_token_counts_equal_the_library():
    made, rule = token_counts.Pieces(token_counts.vocabulary()), random.Random(3)
    for _ in range(5000):
        text = "".join(rule.choice(PARTS) for _ in range(rule.randint(0, 14)))
        assert sum(made.counts(made.pre_tokens(text))) == len(made.model.encode(text)), text


@pytest.mark.parametrize("head", [0, 5, 10**6])
def test_token_count_rows_equal_the_library(spark, head):
    """Every column of the query for whole texts, whether pre-tokens are found in the broadcast head, in the joined table or in both."""
    rule = random.Random(5)
    texts = ["".join(rule.choice(PARTS) for _ in range(rule.randint(0, 40))) for _ in range(60)] + [None, "", "a" * 30_000, "the " * 5000, "the " * 5000]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    path = token_counts.vocabulary()
    model = token_counts.Pieces(path).model
    got = {r.doc_id: tuple(r)[1:] for r in token_counts.token_counts(docs, path, 4096, head).collect()}
    assert got == {i if i else None: ((len((t or "").encode())), (n := len(model.encode(t or ""))), n > 4096) for i, t in enumerate(texts)}


def test_ids_equal_the_library():
    made, rule = packing.Encoder(), random.Random(4)
    for _ in range(5000):
        text = "".join(rule.choice(PARTS) for _ in range(rule.randint(0, 14)))
        assert np.frombuffer(made.encode(text), "<u4").tolist() == made.library.encode(text, add_special_tokens=False).ids, text


def test_encoder_keeps_little():
    made = packing.Encoder()
    assert "library" not in vars(made) and packing.KNOWN <= 100_000
    text = "of <|endoftext|> and of"
    assert np.frombuffer(made.encode(text), "<u4").tolist() == made.library.encode(text, add_special_tokens=False).ids


def test_words_beyond_those_at_hand_are_encoded_alike(monkeypatch):
    texts = ["one two three four", "four three two one", "five one  two", "six four\n five six"]
    whole = [packing.Encoder().encode(t) for t in texts]
    monkeypatch.setattr(packing, "KNOWN", 1)
    made = packing.Encoder()
    assert [made.encode(t) for t in texts] == whole and len(made.known) == 1


def test_a_text_of_new_words_takes_one_call():
    """Words cost no call each, and texts are cut only where a run of white space ends."""
    made, calls = packing.Encoder(), []
    fast = made.fast.encode_ordinary
    made.fast.encode_ordinary = lambda text: calls.append(text) or fast(text)
    for text, parts in ((" ".join(f"new{i}word" for i in range(500)), 1), ("one two three four, and so on\n\n  five six \t seven, eight \n", 3)):
        calls.clear()
        assert np.frombuffer(made.encode(text), "<u4").tolist() == made.library.encode(text, add_special_tokens=False).ids
        assert len(calls) == parts and "".join(calls) == text


def test_ids_equal_the_library_at_all_white_space():
    """Runs of every kind of white space, and of characters that only look like it, between, before and after words."""
    made, rule = packing.Encoder(), random.Random(11)
    white = [c for c in map(chr, range(0x3001)) if c.isspace()]
    others = ["a", "é", "12", ".", "'s", "The", "\u180e", "\u200b", "\u2060", "\ufeff", "\0"]
    for _ in range(4000):
        text = "".join(rule.choice(white) * rule.randint(0, 3) + rule.choice([*others, " ", "\n"]) for _ in range(rule.randint(0, 24)))
        assert np.frombuffer(made.encode(text), "<u4").tolist() == made.library.encode(text, add_special_tokens=False).ids, text


def test_batches_to_python_are_bounded_in_bytes(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    docs = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    got = [r.n for r in mapped(docs, run, "n long").collect()]
    assert sum(got) == 24 and max(got) <= 5
    assert [r.n for r in mapped(docs.where("false"), run, "n long").collect()] == []


def test_plan_uses_every_piece_and_few_sequences():
    rule = np.random.default_rng(1)
    for sizes in (rule.integers(1, 2049, 5000), np.minimum(2048, rule.lognormal(6, 1, 8000).astype(int) + 1), np.full(7, 3), np.array([2048, 2048]), np.array([], int)):
        hist = np.bincount(sizes, minlength=2049)
        made = packing.plan(hist)
        used = np.zeros(2049, np.int64)
        for lengths, n in made:
            assert sum(lengths) <= 2048
            for v in lengths:
                used[v] += n
        assert (used == hist).all()
        bound = max(-(-int(sizes.sum()) // 2048), int((sizes > 1024).sum()))
        assert sum(n for _, n in made) <= bound * 1.01 + 1


def test_pieces():
    ids = np.arange(1, 4097, dtype="<u4").tobytes()
    got = packing.pieces_of(ids)
    assert [(p, s, n) for p, s, n, _ in got] == [(0, 0, 1), (1, 1, 2048), (2, 2049, 2048)]
    assert packing.pieces_of(b"")[0][:3] == (0, 0, 1)


def test_packing_of_frequent_lengths(spark):
    """A length with many pieces is ranked in several groups, full pieces in none, and every place is taken once."""
    rows = [(i, 0, 0, 700 if i % 3 else 900, i) for i in range(9000)] + [(i, 1, 700, 2048, i) for i in range(500)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(5)
    got = packing.pack(packing.stored(parts, "parts")).collect()
    assert len(got) == len(rows) == len({(r.doc_id, r.piece) for r in got})
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        assert sorted(places)[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(sorted(places), sorted(places)[1:], strict=False)) and sum(n for _, n in places) <= 2048
    assert sum(1 for p in by.values() if p == [(0, 2048)]) == 500 and len(by) <= 500 + 4500


def test_packing_is_gapless(spark, edge):
    rows = packing.op9_packing(edge).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_tree_scores(spark):
    rule = random.Random(2)
    texts = [" ".join(rule.choice(["the cat", "the dog", "sat on", "a mat"]) for _ in range(20)) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "THE cat unseen-word"])], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_tree.op1_suffix_tree(docs).collect()}
    train = [t for i, t in enumerate([*texts, None, "THE cat unseen-word"]) if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in [*suffix_tree.tokens((t or "").encode()), b""])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        words = [*suffix_tree.tokens(t.encode()), b""]
        assert got[i].base_score == pytest.approx(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words), sum(w in counts for w in words), n)
    held = [r for r in got.values() if r.held_out and r.n_tokens > 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def naive_tree_scores(train, texts, depth=3, min_context=0.15, min_pair=0.002, divergence=1.0):
    """log10 probability of each text by the definition: dictionaries of contexts, and recursion to the longest proper suffix."""
    rows = [["", *(t or "").lower().split(), ""] for t in train]
    c = Counter(w for r in rows for w in r[1:])
    n, v = sum(c.values()), len(c)
    least, pairs = max(2, min_context * n**0.5), max(2, int(np.ceil(min_pair * n**0.5)))
    seen = Counter(tuple(r[i - k : i + 1]) for r in rows for i in range(1, len(r)) for k in range(1, min(depth, i) + 1) if "" not in r[i - k + 1 : i])
    following, total = {}, {(w,): x for w, x in c.items() if x >= least}
    for k in range(1, depth + 1):
        for key in [x for x in total if len(x) == k]:
            following[key] = {x[-1]: m for x, m in seen.items() if x[:-1] == key and m >= pairs}
            total.update({(*key, w): m for w, m in following[key].items() if m >= least and w and k < depth})

    def p(context, w):
        if not context:
            return (c[w] + 0.5) / (n + 0.5 * (v + 1))
        got, kinds = following[context], max(1, len(following[context]))
        back = (total[context] - sum(got.values()) + kinds) / (total[context] + kinds)
        return got.get(w, 0) / (total[context] + kinds) + back * p(context[1:], w)

    gain = {x: sum(m * np.log(p(x, w) / p(x[1:], w)) for w, m in got.items()) for x, got in following.items()}
    states = {x[i:] for x, g in gain.items() if g >= divergence * np.log(n) for i in range(len(x))}
    out = []
    for t in texts:
        row = ["", *(t or "").lower().split(), ""]
        state = lambda i: max((tuple(row[i - k : i]) for k in range(1, depth + 1) if k <= i and tuple(row[i - k : i]) in states), key=len, default=())  # noqa: E731, B023
        out.append(sum(np.log10(p(state(i), row[i])) for i in range(1, len(row))))
    return out, states


def test_tree_scores_by_definition(spark):
    rule = random.Random(7)
    texts = [" ".join(rule.choice(["the cat sat", "the dog ran", "a cat ran off", "on the mat", "dog"]) for _ in range(rule.randint(0, 25))) for _ in range(120)]
    texts += [None, "THE cat unseen word", "dog " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, states = naive_tree_scores([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1], texts)
    assert {len(x) for x in states} == {1, 2, 3}
    got = {r.doc_id: r.score for r in suffix_tree.op1_suffix_tree(docs).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want)


def test_tree_grows_with_the_corpus(spark):
    """More text with more different contexts gives more states and next words."""
    rule = random.Random(3)
    made = []
    for words in (50, 400):
        rows = [(" ".join(f"w{min(rule.randrange(words), rule.randrange(words))}" for _ in range(100)),) for _ in range(words)]
        tree, _ = suffix_tree.fit(spark.createDataFrame(rows, "text string"))
        made.append(sum(len(k) for k, _ in tree.entries))
    assert made[1] > 3 * made[0]


def test_tree_distributions_sum_to_one(spark):
    rule = random.Random(2)
    docs = spark.createDataFrame([(" ".join(rule.choice(["a b c", "a b d", "c c a"]) for _ in range(30)),) for _ in range(40)], "text string")
    tree, _ = suffix_tree.fit(docs)
    tree.prepare()
    assert any(k.any() for k in tree.kept)
    for context in ([b"a"], [b"a", b"b"], [b"c", b"c", b"a"], [b"x"], [b""]):
        total = 0.0
        for w in [*tree.words, b"never"]:
            ids = np.array([tree.ids.get(x, tree.rest) for x in [b"", *context, w]])
            log = tree.score(ids)[-1]
            total += 10 ** (log + (np.log10(0.5) if w == b"never" else 0))
        assert total == pytest.approx(1, abs=1e-9)


def test_reparameterised_questions(spark):
    bench = spark.createDataFrame([(1, "Yesterday in town Alice bought 3 apples and 5 pears for 20 dollars and then Alice gave 3 apples to Bob before lunch")], "item_id long, text string")
    text = "noise here. yesterday in town {} bought {} apples and 9 pears for 30 euros and then {} gave {} apples to Dave before lunch ok"
    docs = spark.createDataFrame([(1, text.format("Carol", 7, "Carol", 7)), (2, text.format("Carol", 7, "Dora", 8)), (3, "clean words only in this document and nothing else at all"), (4, "x " + bench.first().text)], "doc_id long, text string")
    got = {r.doc_id: r.kind for r in decontaminate.op5_decontaminate(docs, bench).collect()}
    assert got == {1: "reparameterised", 4: "exact"}
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()) == [2, 3]


def naive_leaks(docs, bench):
    """(doc_id, item_id, n_windows, matched, n_slots, n_changed) by loops over all windows of all documents and items."""
    import regex

    d = decontaminate

    def read(text):
        words = regex.findall(d.TOKEN, text or "")
        number = lambda t: "0" <= t < ":"
        codes = [d.NAME if t[0] == " " else d.NUMBER if number(t) else d.UNIT if t.lower() in d.UNITS and i and number(words[i - 1]) else t.lower() for i, t in enumerate(words)]
        names = [d.NAME if t != t.lower() and len(t) > 1 and t[1:] == t.lower()[1:] else c for t, c in zip(words, codes, strict=True)]
        return words, codes, names

    def windows(codes, names, size):
        """(window, place, whether it holds a word that may be a name and is read as one)"""
        out = [(tuple(codes[i : i + size]), i, False) for i in range(len(codes) - size + 1)]
        return out + [(tuple(names[i : i + size]), i, True) for i in range(len(codes) - size + 1) if names[i : i + size] != codes[i : i + size]]

    out = set()
    for item_id, item in bench:
        ours, codes, names = read(item)
        if not ours:
            continue
        size = min(len(codes), d.WINDOW)
        known = [w for w in windows(codes, names, size) if 2 * sum(isinstance(c, str) for c in w[0]) >= size]
        n = len(codes) - size + 1
        least = min(d.RUN, -(-n // 2))
        for doc_id, text in docs:
            theirs, doc_codes, doc_names = read(text)
            ways = {}
            for w, pos, mine in windows(doc_codes, doc_names, size):
                for v, cpos, other in known:
                    if w == v:
                        for reading in (1,) if mine or other else (0, 1):
                            ways.setdefault(reading, {}).setdefault(pos - cpos, set()).add(cpos)
            found = []
            for reading, shifts in ways.items():
                runs, last = [], None
                for shift in sorted(shifts):
                    if last is None or shift - last > d.NEAR:
                        runs.append([])
                    runs[-1].append(shift)
                    last = shift
                for run in runs:
                    matched = len(set().union(*(shifts[x] for x in run)))
                    if matched < least:
                        continue
                    enough = min(least, max(len(shifts[x]) for x in run))
                    for x in run:
                        if len(shifts[x]) >= enough:
                            code = names if reading else codes
                            places = [i for i in range(min(shifts[x]), max(shifts[x]) + size) if not isinstance(code[i], str)]
                            slots = {(ours[i].strip().lower(), theirs[i + x].strip().lower()) for i in places}
                            if len({a for a, _ in slots}) == len(slots):
                                found.append((matched, len(shifts[x]), -reading, -x, len(slots), sum(a != b for a, b in slots)))
            if found:
                best = max(found)
                out.add((doc_id, item_id, n, best[0], best[4], best[5]))
    return out


#: Questions with places for names, numbers and units, at starts of sentences too.
QUESTIONS = [
    "{n} has {a} apples and buys {b} more at the market. {n} then gives {c} apples to {m}. How many apples does {n} have left in the basket?",
    "A train leaves the station at a speed of {a} {u} an hour and {m} follows it {b} minutes later. How far has the train gone when {m} reaches it?",
    "In the garden of {n} there are {a} red flowers for every {b} white ones. If {n} counts {c} white flowers, how many red flowers grow there?",
    "{n} and {m} share {a} coins so that {n} gets {b} coins more than {m}. How many coins does each of the two friends take home?",
    "The tank holds {a} {u} of water and loses {b} of them each day. After how many days will {n} have to fill the tank again?",
]


def test_reparameterised_recall(spark):
    """Questions with other numbers, names and units are found, and other questions of like words are not; every row as loops give it."""
    rule = random.Random(12)
    people, units = "Alice Bob Carol Dan Emma Fay George Hanna Ivan Julia".split(), ["kilometres", "miles", "km", "liters", "gallons", "cups"]

    def ask(text):
        n, m = rule.sample(people, 2)
        return text.format(n=n, m=m, u=rule.choice(decontaminate.UNITS), a=rule.randint(2, 99), b=rule.randint(2, 99), c=rule.randint(2, 99))

    filler = lambda: " ".join(rule.choice("the river ran past old stones while people walked home in rain and talked of bread".split()) for _ in range(rule.randint(5, 40)))
    bench = [(i, ask(q)) for i, q in enumerate(QUESTIONS)]
    docs, want = [], set()
    for i in range(50):
        docs.append((i, f"{filler()}. {ask(QUESTIONS[i % 5])} {filler()}"))
        want.add((i, i % 5))
    docs += [(50 + i, filler() + ". " + text) for i, text in enumerate(["How many apples does Ivan have left in the market?", "A train leaves the station at noon and Emma follows it later.", "Bob has 3 apples.", ""])]
    docs.append((60, f"{bench[0][1]} {filler()} {ask(QUESTIONS[0])}"))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_windows, r.matched, r.n_slots, r.n_changed) for r in decontaminate.op5_decontaminate(*frames).collect()}
    found = {x[:2] for x in got}
    assert len(found & want) >= 0.9 * len(want) and found - want <= {(60, 0)}
    assert got == naive_leaks(docs, bench)


def test_templates_that_share_an_item_id_or_have_none(spark):
    texts = [" ".join(f"{k}{c}" for c in "qwertyuiopasdf") for k in "abcde"]
    bench = spark.createDataFrame(list(zip([1, 1, None, None, 2], texts, strict=True)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate([*texts, "only clean words here and nothing of the benchmark"])], "doc_id long, text string")
    got = decontaminate.op5_decontaminate(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got if r.item_id) == [(0, 1), (1, 1), (4, 2)]
    assert sorted(r.doc_id for r in got if r.item_id is None) == [2, 3]
    assert [r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()] == [5]


def test_windows_count_once_and_every_alignment_is_tried(spark):
    filler = lambda k, n: " ".join(f"{k}{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(n))
    phrase = "which of the following is the correct answer"
    item = "we saw {} apples and {} pears there while {} apples fell from the old tree"
    bench = spark.createDataFrame([(1, f"{filler('x', 30)} {phrase} {filler('y', 30)}"), (2, item.format(3, 5, 3))], "item_id long, text string")
    texts = [" ".join(f"{filler(k, 40)} {phrase}" for k in "abcdef"), f"{item.format(7, 9, 8)} {filler('g', 30)} {item.format(3, 5, 3)}", item.format(7, 9, 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.kind) for r in decontaminate.op5_decontaminate(docs, bench).collect())
    assert got == [(1, 2, "exact")]
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()) == [0, 2]


def test_names_at_the_start_of_sentences(spark):
    text = "{0} has {2} apples and 5 pears. {1} gives her 2 more apples. {0} then eats {3} pears. How many pieces of fruit does {0} have?"
    quoted = '"{0} has {1} red boats and {2} blue boats," he said.\n{0} sold {2} boats (Later {3} paid {1} coins).\n{3} was very glad of that.'
    bench = spark.createDataFrame([(1, text.format("Alice", "Bob", 3, 4)), (2, quoted.format("Peter", 6, 8, "Simon"))], "item_id long, text string")
    rows = [text.format("Carol", "Dan", 7, 9), text.format("Alice", "Bob", 3, 4), quoted.format("Maria", 9, 2, "Julia"), "Carol has nothing. Dan gives her a book about the town. How many pages does it have?"]
    mixed = "Carol has 7 apples and 5 pears. Dan gives her 2 more apples. Emma then eats 9 pears. How many pieces of fruit does Fay have?"
    docs = spark.createDataFrame(list(enumerate([*rows, mixed])), "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.kind) for r in decontaminate.op5_decontaminate(docs, bench).collect())
    assert got == [(0, 1, "reparameterised"), (1, 1, "exact"), (2, 2, "reparameterised")]
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()) == [3, 4]


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 1, "assistant", "hello"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, None, None), (None, 0, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.op2_chat(turns).collect()}
    assert set(got) == {1, 4, 5, None}
    assert (got[1].n_turns, got[1].n_copies) == (2, 2)
    assert got[1].chat == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
    assert chat.op2_chat(turns.limit(0)).collect() == []


def test_chat_ties_and_long_turns(spark):
    """Turns that share a number and role stand in the order of their texts; the prefixes follow that order."""
    long = "x" * 300_000
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "b"), (1, 1, "assistant", "c"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "user", "b"),
        (5, 0, "user", long), (6, 0, "user", long), (6, 1, "assistant", long + "y"), *((7, i, "user", f"turn {i}") for i in range(500)), *((8, i, "user", f"turn {i}") for i in range(499)),
    ]
    turns = spark.createDataFrame([(*r, 1, "k", True) for r in rows], "conv_id long, turn long, role string, text string, pos long, h1 string, last boolean")
    got = {r.conv_id: r for r in chat.op2_chat(turns).collect()}
    assert set(got) == {1, 4, 6, 7} and got[7].n_turns == 500
    assert got[1].chat == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in (("user", "a"), ("user", "b"), ("assistant", "c")))
    assert len(got[6].chat) == 600_001 + len("<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")


def test_insults_with_gaps():
    rule, words = random.Random(3), "the of and this that house river stone green paper window table summer winter market garden letter number people school".split()
    sentence = lambda extra=(): " ".join(rule.sample(words * 3, 12) + list(extra))
    texts = [sentence() for _ in range(300)] + [sentence([rule.choice(["idiot", "moron", "disgusting", "worthless"])]) for _ in range(120)]
    made = toxicity.train(texts, np.array([0] * 300 + [1] * 120), 0.3)
    scores = made.scores(["you idiot", "you i d i o t x", "you i.d.i.o.t.", "you 1d1ot", "such disgxusting things", *texts[:50], "", None])
    assert (scores[:5] >= toxicity.THRESHOLD).all()
    assert (scores[5:] < toxicity.THRESHOLD).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_op6_held_out_where_clean_texts_hold_the_same_stems():
    """Witnesses chosen by decision alone drift here to stems of clean words, and nothing is found."""
    docs, labels = (pd.read_parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = docs[["doc_id", "text"]].merge(labels[labels.toxic.notna()], on="doc_id")
    held, y = rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2).to_numpy(), rows.toxic.to_numpy(int)
    fitted = np.sort(np.concatenate([np.flatnonzero(~held & (y == v))[:most] for v, most in ((1, toxicity.MAX_TOXIC), (0, toxicity.MAX_CLEAN))]))
    made = toxicity.train(rows.text.iloc[fitted].tolist(), y[fitted], y[~held].mean())
    found = made.scores(rows.text[held].tolist()) >= toxicity.THRESHOLD
    assert found[y[held] == 1].mean() >= 0.85 and found[y[held] == 0].mean() <= 0.04


def test_kernel_by_definition():
    """Triples, norms, the kernel and the folded decision against loops over all letters."""
    units = [toxicity.unit(w) for w in ("idiot", "Stupid!", "be", "слово", "日本語文", "aab", "i.d-i0t")] + toxicity.parts(toxicity.unit("q" * 50 + "idiot"))
    number = lambda ch: 0 if ch == toxicity.START else 31 if ch == toxicity.STOP else ord(ch) - 96 if "a" <= ch <= "z" else 32 + ord(ch) % 32

    def naive(u):
        out = Counter()
        for i, j, k in combinations(range(len(u)), 3):
            if k - i < toxicity.SPAN:
                out[tuple(number(u[x]) for x in (i, j, k))] += toxicity.DECAY ** (k - i + 1)
        size = sum(toxicity.DECAY ** (2 * (k - i + 1)) for i, j, k in combinations(range(len(u)), 3) if k - i < toxicity.SPAN) ** 0.5
        return {t: v / (size or 1) for t, v in out.items()}

    want = [naive(u) for u in units]
    gram = [[sum(v * b.get(t, 0) for t, v in a.items()) for b in want] for a in want]
    assert toxicity.kernel(units) == pytest.approx(np.array(gram))
    used, columns = toxicity.columns_of(units[:3])
    assert toxicity.features(units, used, columns) == pytest.approx(np.array(gram)[:, :3])
    folded, w = np.zeros(toxicity.KINDS**3), np.array([0.5, -1.0, 2.0])
    folded[used] = columns @ w
    assert toxicity.decisions(units, folded, 0.25) == pytest.approx(np.array(gram)[:, :3] @ w + 0.25)
    assert len({number(c) for c in "абвгдежзийклмнопрстуфхцчшщъыьэюя"}) == 32


def test_units_are_scored_to_their_end():
    """No letter of a unit without white space is left out: windows cover it, and the end decides as any place does."""
    long = toxicity.unit("".join(random.Random(1).choices("bcdfghklm", k=20_000)) + "idiot")
    got = toxicity.parts(long)
    assert got[0].startswith(toxicity.START) and got[-1].endswith("idiot" + toxicity.STOP) and max(map(len, got)) == toxicity.WIDTH
    assert all(long[i : i + 9] in got[min(i // toxicity.STRIDE, len(got) - 1)] for i in range(len(long) - 9))
    folded = np.zeros(toxicity.KINDS**3)
    folded[(9 * toxicity.KINDS + 15) * toxicity.KINDS + 20] = 5.0  # i, o, t
    made = toxicity.Kernel(0.1, folded, -1.0, 3.0, 0.0)
    clean, toxic = made.scores(["b" * 20 + "c" * 20 + "xyz" * 7000, "b" * 20 + "c" * 20 + "xyz" * 7000 + "idiot"])
    assert toxic > clean


def test_training_is_bounded_in_rows_and_bytes(spark):
    rows = [(i, f"word{i} common text " + ("stupid" if i % 2 else "nice")) for i in range(40)] + [(1, f"another text {i} of one identifier stupid") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    old, toxicity.train = toxicity.train, lambda t, y, share: seen.append((t, y)) or toxicity.Kernel(share)
    try:
        toxicity.fit(docs, labels, max_toxic=8, max_clean=6)
        toxicity.fit(docs, labels, max_bytes=200)
        toxicity.fit(docs, labels)
    finally:
        toxicity.train = old
    assert [(int((y == 1).sum()), int((y == 0).sum())) for _, y in seen][0] == (8, 6)
    assert 1 <= len(seen[1][1]) <= 8 and len(seen[2][1]) == 70


def test_discriminant_is_the_gaussian_density():
    rule = np.random.default_rng(0)
    d = len(quality.NAMES)
    x = [rule.normal(size=(200, d)) @ rule.normal(size=(d, d)) + k for k in (0, 1)]
    made = quality.Discriminant(np.array([200, 200]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]))
    point = rule.normal(size=(1, d))
    logs = []
    for k in (0, 1):
        cov = made.factor[k] @ made.factor[k].T
        diff = point[0] - made.mean[k]
        logs.append(-0.5 * diff @ np.linalg.solve(cov, diff) - 0.5 * np.linalg.slogdet(cov)[1])
    assert made.score(point)[0] == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rule = random.Random(9)
    word = lambda: "".join(rule.choice("abcdefghij") for _ in range(5))
    good = lambda: " ".join(word() for _ in range(120))
    junk = lambda: " ".join([word().upper() + "!!"] * 60)
    texts = [good() for _ in range(60)] + [junk() for _ in range(30)]
    item = " ".join(word() for _ in range(20))
    texts += [texts[0], good() + " " + item, *("footer to drop\n" + good() for _ in range(12))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {*range(60), *range(92, 104)}
    made = packing.Encoder()
    for r in got:
        text = texts[r.doc_id].removeprefix("footer to drop\n")
        ids = made.encode(text) + b"\0\0\0\0"
        assert zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and further columns go through every stage; nothing is lost but copies; empty tables give no rows."""
    import corpus_pipeline

    columns = f"{DOCS}, root long, node string, bands int, batch string, words long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1, "k", 2, "n", 3, "b", 4) for i, t in EDGE], columns)
    for name, rows in (("some", docs), ("none", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    # of doc 2 and its copy one stays; null, empty and blank texts have no words and are one group
    assert {r.doc_id for r in got} == {1, 2, 3, 6, 7, None, *range(10, 22)}
    assert sum(1 for r in got if r.doc_id == 2) == 1 and sum(r.length for r in got if r.doc_id == 6) > 20_000
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{tmp_path}/some")
        assert out.columns == docs.columns and out.count() > 10, name


def test_quality_by_definition(spark):
    """Statistics, moments and scores of the query against plain sums over the labelled rows."""
    rule = random.Random(8)
    texts = [" ".join(rule.choice(["good words", "Some more.", "x|y", "1 2", "é"]) for _ in range(rule.randint(0, 30))) for _ in range(60)] + [None, "", " \n", "word " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = [(i, int(i % 3 == 0)) for i in range(50)] + [(7, 1), (7, 1), (9, None)]
    labels = spark.createDataFrame(known, "doc_id long, quality int")

    def stats(text):
        raw = (text or "").encode()
        words = raw.split()
        if not words:
            return [0.0] * 14 + [1.0]
        n, size = len(words), len(raw)
        share = lambda keep: sum(map(keep, raw)) / size
        upper, lower = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
        lengths = [len(w) for w in words]
        mean = sum(lengths) / n
        marks = set(range(33, 127)) - set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,'|")
        control = set(range(33)) - set(b" \t\n\r\x0b\x0c") | {127}
        root = np.sqrt
        return [
            np.log(n + 1), np.log(mean), np.log(1 + root(sum((x - mean) ** 2 for x in lengths) / n)), root(upper / max(1, upper + lower)), root(share(lambda c: 48 <= c <= 57)), root(share(lambda c: c in marks or c in control)),
            root(share(lambda c: c in b".,'")), root(share(lambda c: c == 124)), np.log(len(set(words)) / n) / np.log(n + 1), root(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n), root((max(Counter(words).values()) - 1) / n),
            root(share(lambda c: c == 10)), root(sum(w[-1] in marks | {124} for w in words) / n), root(share(lambda c: c >= 128)), 0.0,
        ]

    x = np.array([stats(t) for t in texts])
    assert np.array([quality.statistics((t or "").encode()) for t in texts]) == pytest.approx(x)
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in range(len(texts))])
    y = {i: v for i, v in known if v is not None and i != 7} | {7: 1}  # two labels of three
    rows = [[i for i in y if y[i] == k and not held[i]] for k in (0, 1)]
    mean = [x[r].mean(0) for r in rows]
    cov = [np.cov(x[r].T, bias=True) for r in rows]
    n = np.array([len(r) for r in rows])
    pooled = (cov[0] * n[0] + cov[1] * n[1]) / n.sum()
    used = [0.88 * c + 0.1 * pooled + 0.02 * np.diag(np.diag(pooled) + 1e-6) for c in cov]
    log = [-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) - 0.5 * np.linalg.slogdet(c)[1] for m, c in zip(mean, used, strict=True)]
    want = 1 / (1 + np.exp(-np.clip(log[1] - log[0] + np.log(n[1] / n[0]), -500, 500)))
    got = {r.doc_id: r for r in quality.op10_quality(docs, labels).collect()}
    assert [got[i].score for i in range(len(texts))] == pytest.approx(want.tolist(), abs=1e-6)
    assert [got[i].held_out for i in range(len(texts))] == held.tolist() and all(r.predicted == (r.score >= 0.5) for r in got.values())
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.score >= 0.5}


def test_quality_on_held_out_rows():
    """Fitted to the labelled rows outside the third split, the discriminant is right on nearly all of the others."""
    base = "/root/testdata/sf0.01"
    if not os.path.isdir(base):
        pytest.skip("no test tables")
    rows = pd.read_parquet(f"{base}/labels.parquet").dropna(subset=["quality"]).merge(pd.read_parquet(f"{base}/documents.parquet"), on="doc_id")
    x = np.array([quality.statistics((t or "").encode()) for t in rows.text])
    y, held = rows.quality.to_numpy().astype(int), np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id])
    parts = [x[(y == k) & ~held] for k in (0, 1)]
    made = quality.Discriminant(np.array([len(p) for p in parts]), np.array([p.sum(0) for p in parts]), np.array([p.T @ p for p in parts]))
    assert ((made.score(x[held]) >= 0.5) == y[held]).mean() >= 0.97


def test_repeated_rows_and_ties(spark):
    docs = spark.createDataFrame([(1, "same words here in a row")] * 3 + [(2, "same words here in a row")], "doc_id long, text string")
    got = simhash.op8_simhash(docs).collect()
    assert [(r.doc_id, r.component_id) for r in sorted(got)] == [(1, 1)] * 3 + [(2, 1)]
    assert docs.select(F.count("*")).first()[0] == 4
