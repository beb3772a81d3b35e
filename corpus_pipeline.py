"""A corpus pipeline: documents in, packed training sequences out.

Each stage reads what the one before has written, works on all of it, and decides what goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tachyline.llm import decontamination, jaccard_join, language_id, line_dedup, packing
from tachyline.llm.common import stored, table

#: Op6 has a rule of its own, four words and 85 percent; this stage takes what is usual for near copies.
NEAR_COPIES = jaccard_join.Rule(width=5, percent=80)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go."""
    return language_id.documents_in_a_language(docs)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines one stays; documents that only repeat lines of others go."""
    return line_dedup.clean_documents(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by similar sets of five words the one with the smallest id stays."""
    return jaccard_join.one_of_each_group(docs, NEAR_COPIES)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a share of benchmark windows go."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, tokenized and packed into sequences: a row per piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_lines),
    ("ngram_jaccard_join", join_near_copies),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: No stage but decontamination can be said in SQL; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
