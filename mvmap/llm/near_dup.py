"""Operator 7: near-duplicates from bottom-k sketches of one hash function.

A document is the set of its distinct ``width``-word shingles, hashed to 64 bits.
Its sketch is the ``k`` least values. Copies (equal sets) collapse to the least
doc_id first. Each three neighbouring values among the ``listed`` least are one
entry of an inverted list: of the least values of two documents' union, a share J
lies in both, so two documents above the threshold miss a common run of three only
with a probability of about 0.63^listed at J = 0.85 (below 1e-6 for 32). Sets of 6 to
``listed`` shingles never miss one, as a fifth of the union cannot cut the rest into
runs of two; sets of up to ``SMALL`` shingles are listed under each value too. The whole sketch of k values serves
the estimate. Its values are drawn from the union without replacement, so it errs
by 0.03 at k = 128 for large unions, less for smaller ones, and not at all where the
sketches hold both sets; pairs up to ``SIGMAS`` standard errors below the threshold
are still verified. Sketches keep the upper 32 bits.

First round: in each list the least document is the hub; pairs (hub, member) with
many common entries are verified exactly and joined into components. Second
round: lists that still hold several components compare the members of different
components: size ratio, overlap of retained values, union-sketch estimate. Lists
are cut into blocks, so a long one is many tasks. A pair is looked at in its first
common list only, and leaves the block only if it passes the estimate. These are verified exactly too. Verification reads the
whole texts again: each pair sends one set to its partner's (salted) group, in
which one set at a time is held.

No words: no shingles, linked with nothing. Fewer words than ``width``: the whole
sequence is the one shingle. Texts are cut whole, whatever their length; other columns
are not read, whatever their names. Rows of one doc_id are one document. Rows without a
doc_id are linked with nothing and kept. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import partial
from math import sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mvmap.llm import common, graph
from mvmap.llm import text as tx

RUN, SMALL = 3, 5
SIGMAS = 5.0
BLOCK = 1024
SALTS = 16


def shingles(text: str | None, width: int):
    """Sorted distinct shingle hashes (uint64)."""
    import numpy as np

    words = tx.spaced_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = tx.hasher().array(words)
    return np.unique(tx.grams(h, tuple(range(min(width, len(words))))))


def _sketches(batches, width: int, k: int):
    import numpy as np
    import pyarrow as pa
    import xxhash

    names = ["doc_id", "n", "s1", "s2", "sketch"]
    for batch in batches:
        n, s1, s2, sketch = [], [], [], []
        for t in batch.column(1):
            s = shingles(t.as_py(), width)
            d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8")
            n.append(len(s))
            s1.append(int(d[0]))
            s2.append(int(d[1]))
            sketch.append((s[:k] >> np.uint64(32)).astype(np.uint32).view(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sketch, pa.list_(pa.int32()))], names)


def _sets(batches, width: int, bits: bytes, n_bits: int):
    """doc_id, set of the documents that the filter may hold."""
    import numpy as np
    import pyarrow as pa

    words = np.frombuffer(bits, dtype="<u8")
    for batch in batches:
        slot = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        hit = np.flatnonzero(words[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1))
        part = batch.take(pa.array(hit))
        sets = [shingles(t.as_py(), width).tobytes() for t in part.column(1)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["doc_id", "set"])


def _judge(batches, percent: int):
    """Rows sorted by (a, salt, b nulls first): the set of a, then those of its partners."""
    import numpy as np
    import pyarrow as pa

    group, held = None, []
    for batch in batches:
        out = []
        for a, salt, b, raw in zip(*(c.to_pylist() for c in batch.columns)):
            s = np.frombuffer(raw, dtype="<u8")
            if (a, salt) != group:
                group, held = (a, salt), []
            if b is None:
                held.append(s)
                continue
            for h in held:
                both = np.concatenate([h, s])
                both.sort()
                common_n = int((both[1:] == both[:-1]).sum())
                if 100 * common_n >= percent * (len(both) - common_n):
                    out.append((a, b))
                    break
        cols = list(zip(*out)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])


def _block_pairs(batches, percent: int, k: int, listed: int):
    """Rows sorted by (key, bi, bj): pairs of a block that may reach the threshold.
    ``side`` tells a member of block bi (0) from one of bj (1); in bi = bj all meet."""
    import pyarrow as pa

    t = percent / 100

    def meet(x, y, out):
        (ra, ca, na, sa, before, _), (rb, cb, nb, sb, _, runs) = x, y
        if ca == cb or 100 * min(na, nb) < percent * max(na, nb):
            return
        if any(run in runs for run in before):
            return  # an earlier list of the two has them
        both = len(sa[0] & sb[0])
        # The union's sketch: all values up to the lesser of the two sketches' ends.
        end = min(sa[1][-1] if na > k else 1 << 32, sb[1][-1] if nb > k else 1 << 32)
        union = bisect_right(sa[1], end) + bisect_right(sb[1], end) - both
        if na <= k and nb <= k:
            if 100 * (both + 1) < percent * (union - 1):
                return
        else:
            # A pair at or above the threshold has a union of at most `most` shingles.
            most = (na + nb) / (1 + t)
            slack = SIGMAS * sqrt(t * (1 - t) / union * max(0.0, 1 - union / most))
            if both + 1 < (t - slack) * union:
                return
        out.add((min(ra, rb), max(ra, rb)))

    def flush(members, same, out):
        if same:
            for i, x in enumerate(members[0]):
                for y in members[0][:i]:
                    meet(x, y, out)
        else:
            for x in members[0]:
                for y in members[1]:
                    meet(x, y, out)

    group, members, out = None, ([], []), set()
    for batch in batches:
        for key, at, bi, bj, side, rep, comp, n, sketch in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, bi, bj) != group:
                if group:
                    flush(members, group[1] == group[2], out)
                group, members = (key, bi, bj), ([], [])
            values = [v & 0xFFFFFFFF for v in sketch]
            head = values[:listed]
            runs = list(zip(*(head[j:] for j in range(RUN))))
            members[side].append((rep, comp, n, (frozenset(values), values), runs[:at], frozenset(runs)))
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
            out = set()
    if group:
        flush(members, group[1] == group[2], out)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])


def verify(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold, written."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    bits, n_bits = common.bit_filter(ids, "id")
    slot = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(n_bits))
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).withColumn("slot", slot)
    sets = common.materialise(common.map_arrow(rows, partial(_sets, width=width, bits=bits, n_bits=n_bits), "doc_id bigint, set binary"), "sets")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    hubs = salted.select("a", "salt").distinct().join(sets, F.col("a") == F.col("doc_id")).select("a", "salt", F.lit(None).cast("bigint").alias("b"), "set")
    mates = salted.join(sets, F.col("b") == F.col("doc_id")).select("a", "salt", "b", "set")
    dealt = hubs.union(mates).repartition("a", "salt").sortWithinPartitions(F.col("a"), F.col("salt"), F.col("b").asc_nulls_first())
    return common.materialise(common.map_arrow(dealt, partial(_judge, percent=percent), "a bigint, b bigint"), "links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 128, listed: int = 48) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows = common.materialise(common.map_arrow(source, partial(_sketches, width=width, k=k), "doc_id bigint, n bigint, s1 bigint, s2 bigint, sketch array<int>"), "sketches")
    live = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = live.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = common.materialise(reps, "reps")

    runs = F.transform(F.sequence(F.lit(1), F.least(F.size("sketch"), F.lit(listed)) - (RUN - 1)), lambda i: F.xxhash64(*[F.element_at("sketch", i + j) for j in range(RUN)]))
    keys = reps.filter(F.size("sketch") >= RUN).select("rep", "n", F.posexplode(runs).alias("at", "key"))
    # At place 0 no earlier list is taken to have a pair; what is looked at twice counts once.
    values = F.transform("sketch", lambda v: F.xxhash64(F.lit("value"), v))
    keys = keys.union(reps.filter(F.col("n") <= SMALL).select("rep", "n", F.lit(0).alias("at"), F.explode(values).alias("key")))
    lists = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).filter("m > 1")
    multi = common.materialise(keys.join(lists, "key").select("key", "at", "rep", "n", "hub"), "lists")

    # First round: hubs.
    shared = multi.filter("rep <> hub").groupBy(F.col("hub").alias("a"), F.col("rep").alias("b"), "n").count()
    pairs = common.materialise(shared.filter(F.col("count") * 4 >= F.least(F.lit(listed), F.col("n")) - (RUN - 1)).select("a", "b"), "pairs")
    links = verify(source, pairs, width, percent)
    comp = graph.components(links)

    # Second round: what still meets in a list across components.
    placed = multi.join(comp, multi.rep == comp.node, "left").select("key", "at", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
    placed = common.materialise(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).filter("lo <> hi")
    g = F.ceil(F.col("m") / BLOCK).cast("int")
    held = placed.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("rep"), g).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), g - 1)))
    held = held.join(reps.select(F.col("rep"), "sketch"), "rep")
    blocks = held.select("key", "at", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "comp", "n", "sketch")
    blocks = blocks.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    more = common.map_arrow(blocks, partial(_block_pairs, percent=percent, k=k, listed=listed), "a bigint, b bigint").distinct()
    more = common.materialise(more, "pairs")
    links = common.materialise(links.union(verify(source, more, width, percent)), "links")
    comp = graph.components(links)

    named = reps.join(comp, reps.rep == comp.node, "left").select("s1", "s2", F.coalesce("comp", "rep").alias("comp"))
    out = rows.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("comp")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), width=3, percent=85, k=128, listed=32)
