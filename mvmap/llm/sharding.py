"""Operator 2: sharding through fixed virtual slots.

Records are hashed by text into ``n_slots`` virtual slots, so equal texts share one.
Bytes are summed per slot, and a versioned map names each slot's shard. Version 1 deals
the slots round; ``rebalance`` makes the next version by moving slots from the fullest
to the emptiest shard until the byte counts agree, so a move touches only the slots
named in the edit. A map that is stored is loaded, edited and stored as the next
version; no version is ever written over.

A slot heavier than 1 / ``HEAVY`` of a shard is split into ``SALTS`` units by a second
hash of the text, one of these that is still too heavy by a hash of doc_id, and rows
equal in both, which cannot be told apart, by their place in the scan. So a doc_id or a
text that holds a third of all rows does not stop the balance, and where a record lies
follows from the record and the map alone, equal records aside.

The law of the query is ``bytes``: shard sizes come out near equal. Null text has no
bytes and is a text of its own. Null doc_ids, repeated and equal rows are rows like
others. Texts are hashed whole, whatever their length. Rows of a unit are placed by
(doc_id, size, crc), ties in no defined order. An empty table gives an empty result;
other columns are not read, whatever their names. The driver sees one row per unit:
n_slots and SALTS for each heavy one, of which each of three rounds has at most
HEAVY * n_shards.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mvmap.llm import common

SALTS, HEAVY = 64, 16


@dataclass
class SlotMap:
    """Versioned map from units to shards. A unit is a slot, "5", or a part of one, "5/12"."""

    n_slots: int
    n_shards: int
    version: int = 1
    shard_of: dict[str, int] = field(default_factory=dict)

    @classmethod
    def first(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls(n_slots, n_shards, 1, {str(s): s % n_shards for s in range(n_slots)})

    def locate(self, unit: str) -> int:
        """The shard of a unit; one that the map does not name lies where its slot lies."""
        while unit not in self.shard_of:
            unit = unit.rpartition("/")[0]
        return self.shard_of[unit]

    def rebalance(self, load: dict[str, int], tolerance: float = 1e-4) -> SlotMap:
        """The next version: units move from the fullest shard to the emptiest,
        each time the one nearest to half their difference, or two units are
        exchanged, until the difference is within ``tolerance`` of the mean or
        no such step narrows it."""
        import bisect

        shard_of = self.shard_of | {u: self.locate(u) for u in load}
        held: list[list[tuple[int, str]]] = [[] for _ in range(self.n_shards)]
        for u, b in load.items():
            if b:
                held[shard_of[u]].append((b, u))
        for h in held:
            h.sort()
        size = [sum(b for b, _ in h) for h in held]
        mean = sum(size) / max(1, self.n_shards)
        while True:
            hi, lo = max(range(self.n_shards), key=size.__getitem__), min(range(self.n_shards), key=size.__getitem__)
            gap = size[hi] - size[lo]
            if gap <= max(1, tolerance * mean):
                break
            best = None
            for a, u in held[hi]:
                i = bisect.bisect_left(held[lo], (a - gap // 2,))
                for b, v in [(0, None), *held[lo][max(0, i - 1):i + 1]]:
                    if 0 < a - b < gap and (best is None or abs(2 * (a - b) - gap) < best[0]):
                        best = (abs(2 * (a - b) - gap), a, u, b, v)
            if best is None:
                break
            _, a, u, b, v = best
            for n, unit, src, dst in ((a, u, hi, lo), (b, v, lo, hi)):
                if unit is not None:
                    held[src].remove((n, unit))
                    bisect.insort(held[dst], (n, unit))
                    shard_of[unit] = dst
                    size[src], size[dst] = size[src] - n, size[dst] + n
        return SlotMap(self.n_slots, self.n_shards, self.version + 1, shard_of)

    def save(self, spark: SparkSession, path: str) -> None:
        """Store this version; one that is there already is not written over."""
        rows = [(self.version, self.n_slots, self.n_shards, unit, shard) for unit, shard in self.shard_of.items()]
        frame = spark.createDataFrame(rows, "version int, n_slots int, n_shards int, unit string, shard int")
        frame.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version:06d}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{path}/version={version:06d}").collect()
        return cls(rows[0].n_slots, rows[0].n_shards, version, {r.unit: r.shard for r in rows})


def versions(spark: SparkSession, path: str) -> list[int]:
    """The stored versions, those written whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [(int(m[1]), s.getPath()) for s in fs.listStatus(at) if (m := re.match(r"version=(\d+)$", s.getPath().getName()))]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(v for v, p in found if fs.exists(done(p, "_SUCCESS")))


def slotted(docs: DataFrame, n_slots: int) -> DataFrame:
    """doc_id, size, text_crc32, the slot and the hashes that split it, level by level."""
    text = F.col("text").cast("string")
    raw = text.cast("binary")
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS)).cast("string")
    return docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(n_slots)).cast("int").alias("vslot"),
        salt(F.lit(1), text).alias("salt1"),
        salt(F.lit(2), "doc_id").alias("salt2"),
        salt(F.lit(3), F.monotonically_increasing_id()).alias("salt3"),
    )


def _units(rows: DataFrame, n_shards: int) -> tuple[Column, dict[str, tuple[int, int]]]:
    """The unit of each row, and (bytes, rows) of each unit."""
    unit = F.col("vslot").cast("string")
    sums = lambda at, of: {r.unit: (r.bytes, r.n) for r in of.groupBy(at.alias("unit")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    load = sums(unit, rows)
    total = sum(b for b, _ in load.values())
    fresh = load
    for salt in ("salt1", "salt2", "salt3"):
        heavy = [u for u, (b, n) in fresh.items() if b * HEAVY * n_shards > total and n > 1]
        if not heavy:
            break
        fresh = sums(F.concat_ws("/", unit, salt), rows.filter(unit.isin(heavy)))
        unit = F.when(unit.isin(heavy), F.concat_ws("/", unit, salt)).otherwise(unit)
        load = {u: x for u, x in load.items() if u not in set(heavy)} | fresh
    return unit, load


def shard(docs: DataFrame, n_shards: int = 24, n_slots: int = 8192, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, map_version and slot, the row's place in
    its shard. The latest map under ``map_path`` is the one edited, a first one is stored
    there if there is none; the edited one is stored as the next version."""
    spark = docs.sparkSession
    path = map_path or common.new_path(spark, "slot-map")
    known = versions(spark, path)
    if known:
        before = SlotMap.load(spark, path, known[-1])
        if (before.n_slots, before.n_shards) != (n_slots, n_shards):
            raise ValueError("the stored map has other numbers of slots or shards")
    else:
        before = SlotMap.first(n_slots, n_shards)
        before.save(spark, path)
    rows = common.materialise(slotted(docs, n_slots), "slotted")
    unit, load = _units(rows, n_shards)
    now = before.rebalance({u: b for u, (b, _) in load.items()})
    now.save(spark, path)
    place, next_at = [], [0] * n_shards
    for u in sorted(load):
        s = now.shard_of[u]
        place.append((u, s, next_at[s]))
        next_at[s] += load[u][1]
    # A row for each unit, a bounded number whatever the input.
    at = F.broadcast(spark.createDataFrame(place, "unit string, shard int, base bigint"))
    order = Window.partitionBy("unit").orderBy("doc_id", "size", "text_crc32")
    out = rows.withColumn("unit", unit).join(at, "unit").withColumn("slot", F.col("base") + F.row_number().over(order) - 1)
    return out.select("doc_id", "size", "text_crc32", "vslot", "unit", "shard", F.lit(now.version).alias("map_version"), "slot")


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(common.documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "unit", "map_version")
