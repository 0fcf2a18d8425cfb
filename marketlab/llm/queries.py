"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlab.llm import chat, decontaminate, line_dedup, media, packing, quality, simhash, suffix_tree, token_counts, toxicity
from marketlab.llm.common import table


def _over(operator, *names: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(*(table(spark, sf_dir, n) for n in names))

    query.__doc__ = operator.__doc__
    return query


QUERIES = {
    "op1_suffix_tree": _over(suffix_tree.op1_suffix_tree, "documents"),
    "op2_chat": _over(chat.op2_chat, "conversations"),
    "op3_png": _over(media.op3_png, "documents"),
    "op4_token_counts": _over(token_counts.op4_token_counts, "documents"),
    "op5_decontaminate": _over(decontaminate.op5_decontaminate, "documents", "benchmark"),
    "op6_toxicity": _over(toxicity.op6_toxicity, "documents", "labels"),
    "op7_line_dedup": _over(line_dedup.op7_line_dedup, "documents"),
    "op8_simhash": _over(simhash.op8_simhash, "documents"),
    "op9_packing": _over(packing.op9_packing, "documents"),
    "op10_quality": _over(quality.op10_quality, "documents", "labels"),
}

ORACLE_SQL = {"op2_chat": chat.ORACLE, "op7_line_dedup": line_dedup.ORACLE}
