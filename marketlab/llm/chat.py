"""Chat formatting: logged snapshots of growing conversations collapse to the longest, which are rendered.

A conversation is the rows of one ``conv_id`` (null is an identifier like any other) in the order of
turn, role, text; exactly repeated rows count once.  Every prefix gets a rolling 128-bit hash: the
running exclusive or of two salted hashes of (position, role, text).  A conversation whose last hash
is the hash of a shorter prefix of another one goes (anti-join); of equal ones the smallest ``conv_id``
stays and ``n_copies`` counts them.  Null role or text differs from an empty one but renders as empty.
An empty table gives no rows; further columns are not read.  Very long conversations and texts are rendered whole.

Texts are shuffled once, and only those of the conversations that stay.  Before that 128 bits stand for each text; only
where different texts share a conversation, turn and role do the texts themselves tell the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlab.llm.common import stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Conversations that are broadcast at most; beyond, texts are joined to them by a shuffle.
SMALL = 1_000_000


def _chained(rows: DataFrame, order: list[str]) -> DataFrame:
    """conv_id, pos (from 1), h1, h2 and last, one row for each distinct turn; ``order`` sorts the turns, role and t1, t2 (its text's hashes) make them."""
    w = Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    same = F.lit(True)
    for c in ("turn", "role", "t1", "t2"):
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    rows = rows.withColumn("again", same & (F.row_number().over(w) > 1)).where(~F.col("again")).withColumn("pos", F.row_number().over(w))
    for i in (1, 2):
        rows = rows.withColumn(f"k{i}", F.xxhash64(F.lit(i), "pos", F.col("role").isNull(), "role", "t1", "t2"))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("conv_id", "pos", *(F.bit_xor(f"k{i}").over(running).alias(f"h{i}") for i in (1, 2)), F.lead(F.lit(1)).over(w).isNull().alias("last"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), h1, h2 and last, one row for each distinct turn."""
    rows = turns.select("conv_id", "turn", "role", "text")
    for i in (1, 2):
        rows = rows.withColumn(f"t{i}", F.xxhash64(F.lit(i), F.col("text").isNull(), "text"))
    short = rows.drop("text")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "t1", "t2")
    tied = F.lag(F.lit(True)).over(w) & F.col("turn").eqNullSafe(F.lag("turn").over(w)) & F.col("role").eqNullSafe(F.lag("role").over(w)) & ((F.col("t1") != F.lag("t1").over(w)) | (F.col("t2") != F.lag("t2").over(w)))
    ties = stored(short.withColumn("tied", tied).where("tied").select("conv_id").distinct(), "ties")
    if ties.isEmpty():
        return _chained(short, ["turn", "role", "t1", "t2"])
    ties = ties.withColumnRenamed("conv_id", "tied_id")
    on = F.col("conv_id").eqNullSafe(F.col("tied_id"))
    few = F.broadcast(ties) if ties.count() <= SMALL else ties
    plain = _chained(short.join(few, on, "left_anti"), ["turn", "role", "t1", "t2"])
    return plain.unionByName(_chained(rows.join(few, on, "left_semi"), ["turn", "role", "text"]))


def maximal(hashes: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that are no proper prefix of another."""
    whole = hashes.where("last").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = hashes.where(~F.col("last")).select("pos", "h1", "h2").distinct()
    return whole.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """One text for each kept conversation, each turn between its role line and the closing mark; texts are shuffled here alone."""
    kept = kept.withColumnRenamed("conv_id", "kept_id")
    small = F.broadcast(kept) if kept.count() <= SMALL else kept
    rows = turns.select("conv_id", "turn", "role", "text").join(small, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    parts = F.sort_array(F.collect_set(F.struct("turn", "role", "text")))
    line = lambda x: F.concat(F.lit(OPEN), F.coalesce(x["role"], F.lit("")), F.lit("\n"), F.coalesce(x["text"], F.lit("")), F.lit(CLOSE + "\n"))
    return rows.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_join(F.transform(parts, line), "").alias("chat"))


def op2_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and the rendered chat of every maximal conversation."""
    hashes = stored(prefix_hashes(conversations), "prefixes")
    return render(conversations, stored(maximal(hashes), "maximal"))


ORACLE = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, "text" FROM conversations),
convs AS (SELECT conv_id, list({'role': role, 'text': "text"} ORDER BY turn NULLS FIRST, role NULLS FIRST, "text" NULLS FIRST) AS l FROM turns GROUP BY conv_id),
whole AS (SELECT md5(to_json(l)::VARCHAR) AS h, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(l) AS l FROM convs GROUP BY 1),
prefixes AS (SELECT DISTINCT md5(to_json(l[1:k])::VARCHAR) AS h FROM (SELECT l, unnest(range(1, len(l))) AS k FROM convs))
SELECT conv_id, len(l)::BIGINT AS n_turns, n_copies,
  array_to_string(list_transform(l, lambda x: '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10)), '') AS chat
FROM whole WHERE h NOT IN (SELECT h FROM prefixes)
"""
