"""From documents to packed sequences: quality rules, near-duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import decontamination, neardup, paragraphs, quality
from tarn.llm.common import Leftovers, saved, table
from tarn.llm.packing import pack_documents
from tarn.llm.queries import tokenizer_path


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: one row per piece of a document, with its place in a sequence."""
    return pack_documents(docs, tokenizer_path())


#: A stage's scratch tables go when the next stage begins. The last one's stay: they belong to the result.
LEFTOVERS = Leftovers()

STAGES = [
    ("quality_rules", LEFTOVERS.collected(quality.filter_stage)),
    ("near_dedup", LEFTOVERS.collected(neardup.dedup_stage)),
    ("substring_dedup", LEFTOVERS.collected(paragraphs.cut_stage)),
    ("decontamination", LEFTOVERS.collected(decontamination.decontaminate_stage)),
    ("packing", LEFTOVERS.collected(packing_stage, remember=False)),
]

#: SQL can't express the near-duplicate and packing stages; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
