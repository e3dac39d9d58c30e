"""Input shaping and word rules of the operators in this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.storage import dropped, partitions, released, shared_dir, stored, stored_by

__all__ = ["dropped", "partitions", "released", "shared_dir", "stored", "stored_by"]

#: What separates words: blank, tab, line feed, VT, FF, CR.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """Only A-Z become small; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
