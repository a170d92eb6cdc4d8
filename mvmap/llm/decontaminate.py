"""Operator 9: benchmark decontamination by pigeonhole edit matching.

Texts are normalised (lower case, runs of ASCII non-alphanumerics as one space)
and compared as UTF-8 bytes. An item of n bytes may be matched with up to
``int(error_share * n)`` edits anywhere in a document. It is split into that
budget plus one pieces; a match leaves at least one piece whole, so every
document is searched once for all pieces (Aho-Corasick), and each hit's
neighbourhood is verified with Myers' bit-parallel distance. Items shorter than
``min_bytes`` are matched without edits and between word borders only. The benchmark is a stated query
set; it is searched in blocks of about ``block_bytes`` / 2 bytes (some 130,000 pieces
at the default budget, about 100 MB of automaton in a worker), each a pass over all
documents, so what travels to executors is bounded. The search is map-only: no
document is shuffled.

Null or empty texts and items match nothing. Texts are searched whole, whatever their
length. Repeated documents and repeated items are reported each; of equally good
places of an item in a document the first is reported. An empty table on either side
gives no matches. Other columns pass through clean() as they are, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache, partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mvmap.llm import common
from mvmap.llm import text as tx

MATCHES = "doc_id bigint, item_id bigint, distance int, start bigint, stop bigint"


def normalise(text: str | None) -> bytes:
    return b" ".join(tx.plain_words(text))


def pieces(item: bytes, budget: int) -> list[tuple[int, bytes]]:
    """The item cut into budget + 1 pieces of near equal length, with their starts."""
    n, k = len(item), budget + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Myers:
    """Bit-parallel approximate search of one pattern."""

    def __init__(self, pattern: bytes):
        self.m = len(pattern)
        self.peq: dict[int, int] = {}
        for i, c in enumerate(pattern):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def best(self, text: bytes) -> tuple[int, int]:
        """(least distance of the pattern to any part of text, that part's end)."""
        m, peq = self.m, self.peq
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score = full, 0, m
        found = (m, 0)
        for i, c in enumerate(text, 1):
            eq = peq.get(c, 0)
            xv = eq | mv
            xh = ((((eq & pv) + pv) ^ pv) | eq) & full
            ph = mv | (~(xh | pv) & full)
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 & full
            mh = mh << 1 & full
            pv = mh | (~(xv | ph) & full)
            mv = ph & xv
            if score < found[0]:
                found = (score, i)
        return found


class Matcher:
    """All items of a block against one normalised document at a time."""

    def __init__(self, items: list[tuple[int, bytes, int | None]]):
        """Items with no budget (None) match without edits, between word borders."""
        import ahocorasick

        self.items = items
        self.myers = lru_cache(1024)(Myers)
        where: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, item, budget) in enumerate(items):
            for at, piece in pieces(item, budget or 0):
                where.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), at))
        if where:
            self.automaton.make_automaton()

    def search(self, doc: bytes) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, stop) of each item's best match; start and
        stop are byte places in the normalised document, start by the item's length."""
        if not self.items or not doc:
            return []
        spans: dict[int, list[int]] = {}
        for end, (length, at) in self.automaton.iter(doc.decode("latin-1")):
            for k, offset in at:
                spans.setdefault(k, []).append(end + 1 - length - offset)
        out = []
        for k, starts in spans.items():
            item_id, item, budget = self.items[k]
            n, best = len(item), None
            for s in set(starts):
                if s >= 0 and doc[s:s + n] == item and (budget is not None or b" " + item + b" " == b" " * (s == 0) + doc[max(0, s - 1):s + n + 1] + b" " * (s + n == len(doc))):
                    best = (0, s + n)
                    break
            if best is None and budget:
                # One window for hits whose neighbourhoods overlap.
                runs: list[list[int]] = []
                for s in sorted(set(starts)):
                    lo, hi = max(0, s - budget), min(len(doc), s + n + budget)
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
                for lo, hi in runs:
                    if hi - lo >= n - budget:
                        distance, end = self.myers(item).best(doc[lo:hi])
                        if distance <= budget and (best is None or distance < best[0]):
                            best = (distance, lo + end)
            if best:
                out.append((item_id, best[0], max(0, best[1] - n), best[1]))
        return out


def _search(batches, items):
    import pyarrow as pa

    matcher = Matcher(items)
    names, types = ["doc_id", "item_id", "distance", "start", "stop"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows += [(doc, *hit) for hit in matcher.search(normalise(text.as_py()))]
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def item_blocks(benchmark: DataFrame, error_share: float, min_bytes: int, block_bytes: int):
    """Blocks of (item_id, normalised item, budget or None), each read from its own query."""
    rows = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes))
    for b in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        block = []
        for r in part.toLocalIterator():
            item = normalise(r["text"])
            if item:
                block.append((r["item_id"], item, int(error_share * len(item)) if len(item) >= min_bytes else None))
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, error_share: float = 0.06, min_bytes: int = 32, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document row and item it holds within the item's edit budget."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    found = [common.map_arrow(rows, partial(_search, items=block), MATCHES) for block in item_blocks(benchmark, error_share, min_bytes, block_bytes)]
    return reduce(DataFrame.union, found)


def _flag(batches, items):
    import pyarrow as pa

    matcher = Matcher(items)
    for batch in batches:
        keep = pa.array([not matcher.search(normalise(t.as_py())) for t in batch.column("text")], pa.bool_())
        yield batch.filter(keep)


def clean(docs: DataFrame, benchmark: DataFrame, error_share: float = 0.06, min_bytes: int = 32, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows that hold no benchmark item, with all their columns."""
    for block in item_blocks(benchmark, error_share, min_bytes, block_bytes):
        docs = common.map_arrow(docs, partial(_flag, items=block), docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))
