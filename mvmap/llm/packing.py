"""Operator 1: cost-balanced packing of documents into training sequences.

A document's ids are cut into full pieces of ``seq_len`` ids, each a sequence of
its own, and one rest. The rests of a block are taken in descending length; each
goes to the sequence of lowest estimated attention cost (``linear * length +
quadratic * length^2`` summed over its pieces) among those whose remaining
capacity holds it. If none does, it is cut to fill the lowest-cost open sequence
and the remainder is placed the same way. A block opens exactly as many
sequences as its ids need, and what is left over ``seq_len`` is laid into
sequences whose lengths are powers of two, so no id of padding is needed.

Packing is map-only: a block is a run of documents of one task holding about
``block_tokens`` ids, so memory is bounded, no row is shuffled, and a lost task
is simply run again. Null text counts as empty; every document has at least its
end id, so each row yields at least one piece. A very long text is cut into full pieces
and one rest, held whole by its task. Repeated rows are packed each; of rests of equal
length the earlier row goes first, of sequences of equal cost the earlier one is taken.
An empty table gives no pieces; other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mvmap.llm import common, tokens

SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def place(lengths: list[int], seq_len: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int, int]]]:
    """For each length (below seq_len) its pieces (start, length, sequence, offset)."""
    import numpy as np

    total = sum(lengths)
    caps = [seq_len] * (total // seq_len)
    caps += [1 << b for b in range(seq_len.bit_length() - 1, -1, -1) if (total % seq_len) >> b & 1]
    open_by_free: list[list[tuple[float, int]]] = [[] for _ in range(seq_len + 1)]
    best = np.full(seq_len + 1, np.inf)
    for s, c in enumerate(caps):
        open_by_free[c].append((0.0, s))
    for c in set(caps):
        best[c] = 0.0
    fill = [0] * len(caps)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, left = 0, lengths[i]
        while left:
            free = left + int(best[left:].argmin())
            if best[free] == np.inf:
                free = 1 + int(best[1:].argmin())
            cost, s = heapq.heappop(open_by_free[free])
            best[free] = open_by_free[free][0][0] if open_by_free[free] else np.inf
            n = min(left, free)
            out[i].append((start, n, s, fill[s]))
            fill[s] += n
            if free > n:
                cost += linear * n + quadratic * n * n
                heapq.heappush(open_by_free[free - n], (cost, s))
                best[free - n] = open_by_free[free - n][0][0]
            start, left = start + n, left - n
    return out


def _pack(batches, path: str, seq_len: int, end_id: int, linear: float, quadratic: float, block_tokens: int):
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    enc = tokens.encoder(path)
    end = np.array([end_id], dtype="<u4").tobytes()
    next_seq = TaskContext.get().partitionId() << 33
    block: list[tuple[int | None, bytes]] = []
    held = 0

    def flush():
        nonlocal next_seq
        rows: list[tuple] = []
        rests = []
        for doc, ids in block:
            n = len(ids) // 4
            for start in range(0, n - n % seq_len, seq_len):
                rows.append((doc, start, seq_len, ids[4 * start:4 * (start + seq_len)], n, next_seq, 0))
                next_seq += 1
            if n % seq_len:
                rests.append((doc, ids, n, n - n % seq_len))
        top = next_seq - 1
        for (doc, ids, n, base), pieces in zip(rests, place([r[2] - r[3] for r in rests], seq_len, linear, quadratic)):
            for start, length, s, offset in pieces:
                at = base + start
                rows.append((doc, at, length, ids[4 * at:4 * (at + length)], n, next_seq + s, offset))
                top = max(top, next_seq + s)
        next_seq = top + 1
        cols = list(zip(*rows))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = enc.encode(text.as_py()) + end
            block.append((doc, ids))
            held += len(ids) // 4
            if held >= block_tokens:
                yield flush()
                block, held = [], 0
    if block:
        yield flush()


def pack(docs: DataFrame, tokenizer: str | None = None, seq_len: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 1024, block_tokens: int = 4_000_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (uint32 bytes), doc_tokens,
    sequence_id, offset. ``seq_len`` is a power of two; ``tokenizer`` a path."""
    if seq_len < 1 or seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    fn = partial(_pack, path=tokenizer or tokens.tokenizer_path(), seq_len=seq_len, end_id=end_id, linear=linear, quadratic=quadratic, block_tokens=block_tokens)
    return common.map_arrow(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), fn, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(common.documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
