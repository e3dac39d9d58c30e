"""Cleaning and packing of a corpus, in stages that each read what the one before has written.

Quality rules drop documents and cut failing lines; of near copies one document stays; repeated passages are cut out of
texts; what is left is packed into windows. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import stored, table
from tessera.llm.packing import pack_documents
from tessera.llm.quality import cleaned
from tessera.llm.simhash import without_copies
from tessera.llm.suffixes import cut_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", suffix_dedup), ("packing", packing)]
#: SQL can't express fingerprints, suffix order or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
