"""The driver's tables as change logs, ordered maps and file metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mvmap.operators import files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as puts and, for errors, deletes of a user's value."""
    error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("user_key"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(error, 2).otherwise(1).alias("op"),
        F.when(~error, F.col("value")).alias("value"),
    )


def line_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem, whose (order, line) keys repeat."""
    return table(spark, sf_dir, "lineitem")


def order_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))


def half(log: DataFrame) -> int:
    """The snapshot in the middle of a log."""
    return (log.agg(F.max("seq").alias("s")).first()["s"] or 0) // 2


def entry_size(op: str = "op"):
    return F.when(F.col(op) == 1, 24).otherwise(16)


def log_files(log: DataFrame) -> DataFrame:
    """Level-0 files: a thousand entries each, in sequence order."""
    cut = log.withColumn("file_no", F.floor((F.col("seq") - 1) / 1000).cast("bigint"))
    return files.statistics(cut, ["file_no"], "user_key", entry_size()).withColumn("level", F.lit(0))


def map_files(state: DataFrame) -> DataFrame:
    """Level-1 files: disjoint ranges of a thousand keys."""
    cut = state.withColumn("file_no", F.floor(F.col("k") / 1000).cast("bigint"))
    return files.statistics(cut, ["file_no"], "k", F.lit(24)).withColumn("level", F.lit(1))
