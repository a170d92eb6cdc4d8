"""Bounded samples of labelled documents for fitting the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(divisor: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, held: int, max_rows: int) -> DataFrame:
    """doc_id, text, y of at most ``max_rows`` labelled rows outside the held-out
    fold, those with the smallest hash of their id. Contradicting labels of one
    document count as 1, null labels not at all. The ids are a table of at most
    ``max_rows`` rows, so they are broadcast and only their texts are shuffled; of rows
    that share an id one is kept, so ``max_rows`` bounds the result."""
    ids = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(divisor) != held))
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
