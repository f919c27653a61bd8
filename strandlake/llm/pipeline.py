"""The corpus pipeline: quality rules, line de-duplication, near de-duplication, benchmark decontamination, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of
``documents``; further columns of the input are left out. Null and empty texts fail the quality rules; repeated rows are exact
copies, of which the near-duplicate stage keeps those with the smallest doc_id; an empty table stays empty in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, line_dedup, near_dup, packing, quality
from strandlake.llm.tables import drop_stored, stored, stored_now, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the bands are fitted on labelled rows."""
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.fitted_rules(docs, table(spark, sf_dir, "labels")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; documents of which nothing stays go with them."""
    left = line_dedup.drop_repeated_lines(docs.select(*COLUMNS))
    left = left.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return left.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; the stage links from a similarity of 0.8 on, the query op5 by its contract from 0.85."""
    return near_dup.keep_one(docs.select(*COLUMNS), percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences."""
    return packing.pack_documents(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Tokenisers, sketches and edit distances have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage has stored on its way goes once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = stored_now()
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_stored(spark, keep=[*[p for p in before if f"/stage-{name}" not in p], stored_now()[-1]])
    return STAGES[-1][1](spark, docs, sf_dir)
