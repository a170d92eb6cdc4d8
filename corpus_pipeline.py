"""The corpus pipeline: quality rules, line de-duplication, near-duplicates,
benchmark decontamination and packing, each over all that its predecessor kept.

Every stage takes null columns, empty and very long texts, repeated rows, an empty
table and columns of any further name; all but the last pass all columns on as they
are (line de-duplication changes ``text`` and ``n_chars``). What each case gives is
said at the stage, and at the operator's module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mvmap.llm import common, decontaminate, line_dedup, near_dup, packing, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that a rule rejects go; null and empty texts have too few
    words and go. Repeated rows are judged alike."""
    return quality_rules.cascade(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: later matches of an earlier line, and later repeats of a passage inside
    a long line, go from the texts. Documents stay, if need be with an empty text; null
    texts stay null. Repeated rows lose the same lines."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, five words and 0.8: the least doc_id of each group stays. Documents
    without words or without a doc_id are in no group and stay; rows that repeat a
    doc_id stay or go together."""
    found = near_dup.near_duplicates(docs, width=5, percent=80)
    gone = common.materialise(found.filter("not kept").select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark item go; null and empty texts and items
    match nothing, so a table without items lets all documents pass."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: pieces of training sequences with their ids. An empty text is its end
    id alone; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Packing's ids, hashed joins and approximate matching are outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
