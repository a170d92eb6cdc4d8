"""Streams of operations into a store."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from mvmap.operators import ranges
from mvmap.plans.store import Store


def ingest(stream: DataFrame, store: Store, order: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch (user_key, op, value, ``order``) as one commit that also
    holds the batch's number: one that is replayed after its commit is known by it and
    skipped, and no stop falls between rows and number. ``order`` gives the places
    within a micro-batch, equal values in no defined order; it is ranked in ordered
    cells, not in one task."""

    def apply(rows: DataFrame, epoch: int) -> None:
        if store.state.get("epoch", -1) >= epoch:
            return
        # A row without an order comes first.
        given = rows.withColumn("_order", F.coalesce(F.col(order).cast("bigint"), F.lit(-(1 << 63)))).withColumn("_tie", F.monotonically_increasing_id())
        given = given.persist(StorageLevel.DISK_ONLY)
        try:
            ranked = ranges.running(given, ["_order", "_tie"], F.lit(1), F.sum, "_at").withColumn("_at", F.coalesce("_at", F.lit(0)))
            store.write_frame(ranked, "_at", {"epoch": epoch})
        finally:
            given.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
