"""What a reader sees of a change log: newest wins, by key and snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUT, DELETE = 1, 2


def at_snapshot(log: DataFrame, snapshot=None) -> DataFrame:
    """Entries a snapshot may see; None or 0 is the latest."""
    return log if snapshot is None or (isinstance(snapshot, int) and snapshot == 0) else log.filter(F.col("seq") <= snapshot)


def newest(log: DataFrame, keys: list[str], snapshot=None) -> DataFrame:
    """The newest visible entry of each key, tombstones included. A rank of one
    lets the planner keep one row per key and task before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col("seq").desc(), F.col("op").desc())
    return at_snapshot(log, snapshot).withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def newest_fixed(log: DataFrame, keys: list[str], values: list[str], snapshot=None) -> DataFrame:
    """newest() for fixed-width values: hash aggregation instead of a sort. A log
    has one entry per key and sequence number here."""
    picks = [F.max_by(c, "seq").alias(c) for c in ["op", *values]]
    return at_snapshot(log, snapshot).groupBy(*keys).agg(F.max("seq").alias("seq"), *picks)


def live(log: DataFrame, keys: list[str], snapshot=None, fixed: list[str] | None = None) -> DataFrame:
    """Keys that hold a value."""
    found = newest_fixed(log, keys, fixed, snapshot) if fixed is not None else newest(log, keys, snapshot)
    return found.filter(F.col("op") == PUT).drop("op")


def history(log: DataFrame, keys: list[str]) -> DataFrame:
    """All versions with their rank, newest first."""
    order = Window.partitionBy(*keys).orderBy(F.col("seq").desc(), F.col("op").desc())
    return log.withColumn("rank", F.row_number().over(order))


def difference(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, change (added, removed, changed), old, new between two states."""
    a = before.select(F.col(key), F.col(value).alias("old"), F.lit(True).alias("_a"))
    b = after.select(F.col(key), F.col(value).alias("new"), F.lit(True).alias("_b"))
    change: Column = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return a.join(b, key, "full").withColumn("change", change).filter("change is not null").select(key, "change", "old", "new")


def last_in_batch(log: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """Within a batch the last operation on a key wins."""
    order = Window.partitionBy(batch, *keys).orderBy(F.col("seq").desc())
    return log.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def as_of(probes: DataFrame, log: DataFrame, key: str, at: str) -> DataFrame:
    """Each probe (key, at) with the entry visible then: the probes are merged
    into the log as rows of their own, so one shuffle by key serves all of them."""
    marks = probes.select("probe_id", F.col(key), F.col(at).alias("seq"), F.lit(1).alias("_probe"), F.lit(None).cast("struct<seq:bigint,op:int,value:double>").alias("e"))
    rows = log.select(F.lit(None).cast("bigint").alias("probe_id"), F.col(key), "seq", F.lit(0).alias("_probe"), F.struct("seq", "op", "value").alias("e"))
    order = Window.partitionBy(key).orderBy("seq", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.union(rows).withColumn("e", F.last("e", ignorenulls=True).over(order)).filter("_probe = 1")
    value = F.when(F.col("e.op") == PUT, F.col("e.value"))
    return seen.select("probe_id", key, F.col("seq").alias(at), F.when(F.col("e.op") == PUT, F.col("e.seq")).alias("found_seq"), value.alias("value"))


def first_hit(levels: list[DataFrame], keys: list[str]) -> DataFrame:
    """The newest entry of each key in the first level that holds one, tombstones
    included, with that ``level``: deeper levels hold older entries only."""
    rows = None
    for n, level in enumerate(levels):
        part = level.withColumn("level", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    order = Window.partitionBy(*keys).orderBy("level", F.col("seq").desc(), F.col("op").desc())
    return rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")
