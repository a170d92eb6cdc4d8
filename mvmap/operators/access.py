"""Ordered access: ranges, seeks, neighbours and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mvmap.functions import keys
from mvmap.operators import ranges


def scan(state: DataFrame, key: str, start=None, limit=None) -> DataFrame:
    """Half-open range [start, limit); None is unbounded."""
    out = state if start is None else state.filter(F.col(key) >= start)
    return out if limit is None else out.filter(F.col(key) < limit)


def last_n(state: DataFrame, key: str, n: int) -> DataFrame:
    return state.orderBy(F.col(key).desc()).limit(n)


def ends(state: DataFrame, key: str, value: str) -> DataFrame:
    """First and last entry of the ordered map in one aggregation."""
    return state.agg(F.min(key).alias("first_key"), F.min_by(value, key).alias("first_value"), F.max(key).alias("last_key"), F.max_by(value, key).alias("last_value"))


def multi_get(asked: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Each asked key with its value and whether it was found."""
    return asked.join(state.withColumn("_hit", F.lit(True)), key, "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def seek(probes: DataFrame, keys: DataFrame, probe: str, key: str, points: list | None = None) -> DataFrame:
    """For each distinct probe p: ``ge``, the least key >= p, and ``lt``, the greatest
    key < p. Keys and probes are dealt into the same ordered cells, so no task sees
    all keys."""
    return ranges.nearest(probes, keys, probe, key, points).select(probe, "ge", "lt")


def neighbours(state: DataFrame, key: str, points: list | None = None) -> DataFrame:
    """Each key with its predecessor and successor."""
    return ranges.around(state, key, points)


def next_n(probes: DataFrame, state: DataFrame, probe: str, key: str, n: int) -> DataFrame:
    """The n entries from each distinct probe on, ranked. Entries are numbered in
    order; a probe seeks its first one and asks for the n numbers from there on."""
    points = ranges.cuts(state, key)
    numbered = ranges.running(state, [key], F.lit(1), F.sum, "_no", points).withColumn("_no", F.coalesce("_no", F.lit(0)))
    first = seek(probes, state, probe, key, points).filter("ge is not null")
    first = first.join(numbered.select(F.col(key).alias("ge"), "_no"), "ge").select(probe, F.posexplode(F.sequence(F.col("_no"), F.col("_no") + (n - 1))).alias("rank", "_no"))
    return first.join(numbered, "_no").withColumn("rank", F.col("rank") + 1).drop("_no")


def merge(children: list[DataFrame]) -> DataFrame:
    """Bag union of ordered children: duplicates stay, ``child`` is the source."""
    out = children[0].withColumn("child", F.lit(0))
    for i, c in enumerate(children[1:], 1):
        out = out.unionByName(c.withColumn("child", F.lit(i)))
    return out


def merge_sorted(children: list[DataFrame], key: str = "user_key") -> DataFrame:
    """merge() in internal order: keys ascending, the newest entry of a key first."""
    return merge(children).orderBy(*keys.internal_order(key), "child")


def merge_ranked(children: list[DataFrame], by: list[str]) -> DataFrame:
    """merge() with each entry's place among its key's: newest first, then child."""
    w = Window.partitionBy(*by).orderBy(F.col("seq").desc(), F.col("op").desc(), "child")
    return merge(children).withColumn("rank", F.row_number().over(w))


def contains(asked: DataFrame, state: DataFrame, key: str) -> DataFrame:
    return asked.join(state, key, "left_semi")


def may_contain(asked: DataFrame, state: DataFrame, key: str, bits_per_key: int = 10, max_bits: int = 1 << 26) -> DataFrame:
    """Asked keys that a one-hash Bloom filter over the state admits (of others about one
    in ``bits_per_key``); the caller checks them exactly. The filter is one row per 64-bit
    word, at most ``max_bits`` / 64 rows, so what is broadcast is bounded; beyond
    max_bits / bits_per_key keys it admits more."""
    bits = 1 << 10
    while bits < min(max_bits, bits_per_key * state.count()):
        bits *= 2
    slot = lambda: F.pmod(F.xxhash64(key), F.lit(bits))
    words = state.select(slot().alias("s")).groupBy(F.shiftright("s", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("_bits"))
    asked = asked.withColumn("_s", slot()).withColumn("_word", F.shiftright("_s", 6))
    hit = F.expr("(shiftright(_bits, cast(_s & 63 as int)) & 1) = 1")
    return asked.join(F.broadcast(words), "_word").filter(hit).drop("_s", "_word", "_bits")
