"""Snapshot-aware garbage collection of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mvmap.operators import ranges

DELETE = 2


def with_newer(log: DataFrame, keys: list[str]) -> DataFrame:
    """``newer``: the sequence number of the next newer entry of the key."""
    w = Window.partitionBy(*keys).orderBy(F.col("seq").desc(), F.col("op").desc())
    return log.withColumn("newer", F.lag("seq").over(w))


def collect(log: DataFrame, keys: list[str], snapshot, base_level: Column | bool = True) -> DataFrame:
    """Entries that stay when ``snapshot`` is the oldest one held: an entry goes
    if a newer one is visible there, a tombstone visible there goes where no
    deeper level may hold its key."""
    base = F.lit(base_level) if isinstance(base_level, bool) else base_level
    hidden = F.coalesce(F.col("newer") <= snapshot, F.lit(False))
    spent = (F.col("op") == DELETE) & (F.col("seq") <= snapshot) & base
    return with_newer(log, keys).filter(~hidden & ~spent).drop("newer")


def collect_for(log: DataFrame, keys: list[str], snapshots: list) -> DataFrame:
    """Tighter rule for several snapshots: the newest entry of each interval
    between them stays."""
    interval = sum((F.when(F.col("seq") > s, 1).otherwise(0) for s in snapshots), F.lit(0))
    w = Window.partitionBy(*keys, "interval").orderBy(F.col("seq").desc(), F.col("op").desc())
    return log.withColumn("interval", interval).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def covered(log: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """log with ``base_level``: no deeper file's range holds the key. The keys are
    looked up in order among the files' ranges, not each against each."""
    hit = ranges.covered(log, files, key, "smallest_key", "largest_key").withColumn("_deep", F.lit(True))
    return log.join(hit, key, "left").withColumn("base_level", F.col("_deep").isNull()).drop("_deep")
