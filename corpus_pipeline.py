"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All but the last
return the columns of ``documents``; ``run`` writes each result and reads it again.  Null and empty texts pass
every filter that does not reject them by its own rule; repeated rows, further columns and empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.llm import decontaminate, line_dedup, minhash, packing, quality, simhash
from marketlab.llm.common import mark, release, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant, fitted to the labelled ones, scores at 0.5 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least 10 of them share; n_chars follows the text."""
    out = line_dedup.drop_lines(docs, line_dedup.condemned_keys(docs.select("doc_id", "text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word Jaccard similarities of 0.8 or more link: the first row of the smallest doc_id."""
    return simhash.one_of_each(docs, minhash.WORDS, minhash.near_copies)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the remaining documents and its place in a sequence."""
    return packing.pack(stored(packing.pieces(docs), "pieces"))


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the classifier, the components nor the packing; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's scratch tables go once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = mark()
        out = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        release(before | {x for x in mark() if "marketlab-stage-" in x})
        docs = out
    return docs
