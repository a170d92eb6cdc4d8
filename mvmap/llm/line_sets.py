"""Word sets of lines, and passages of long texts, in packed blocks of documents.

A line's set holds its distinct words (text.plain_words) as 64-bit hashes. Texts of
``LONG`` words or more are also cut into units, at words whose hash is the least of
``REACH`` words on either side and at the ends of lines of ``LONG`` words or more, so
that a passage is cut alike wherever it stands; runs without such a word are cut
every ``UNIT`` words. A block holds the documents of about ``BLOCK_CHARS`` characters, so a
task's memory is bounded by it and by its longest text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from mvmap.llm import text as tx

#: Least words of a line that is also compared in units; a unit starts at the least hash of REACH words on either side; most words between starts without such a word.
LONG, REACH, UNIT = 50, 6, 32
#: Numbers of units are below zero, odd for units inside long lines.
FIRST_UNIT = -(1 << 31)
#: Characters of a block and of a part of it that is hashed at once; places of a word that have a factor of their own in its hash (as many as a byte counts).
BLOCK_CHARS, HASH_CHARS, PLACES = 6 << 20, 1 << 17, 256
#: Keeps the keys of units apart from those of lines.
UNIT_SALT = 0x9E3779B97F4A7C15

DOC = [("oid", "<i8"), ("tie", "<u4"), ("dkey", "<i8"), ("lines", "<u4"), ("units", "<u4")]
LINE = [("no", "<i4"), ("n", "<i4"), ("s1", "<u8"), ("s2", "<u4")]
BLOCKS = "docs binary, lines binary, ids binary, vocabulary binary, units binary, inside binary, places bigint"


@dataclass
class Block:
    """docs, lines and units in order; ``ids`` are the lines' words as places in
    ``vocabulary``, frequent words first; ``inside`` tells units of long lines."""

    docs: object
    lines: object
    ids: object
    vocabulary: object
    units: object
    inside: object

    def doc_of_lines(self):
        import numpy as np

        return np.repeat(np.arange(len(self.docs)), self.docs["lines"])

    def doc_of_units(self):
        import numpy as np

        return np.repeat(np.arange(len(self.docs)), self.docs["units"])

    def unit_numbers(self):
        import numpy as np

        n = self.docs["units"].astype(np.int64)
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return (FIRST_UNIT + 2 * rank + self.inside).astype(np.int32)


def planes(v) -> bytes:
    """The bytes of a contiguous array of integers, in planes."""
    import numpy as np

    raw = v.view(np.uint8).reshape(len(v), v.itemsize)
    out = np.empty(raw.shape[::-1], dtype=np.uint8)
    # A plane at a time, as a transposed copy is several times slower.
    for i, plane in enumerate(out):
        plane[:] = raw[:, i]
    return out.tobytes()


def of_planes(raw, of):
    """The array that ``planes`` took, of an array of its bytes."""
    import numpy as np

    size = np.dtype(of).itemsize
    kind = np.dtype(f"<u{size}")
    first, *others = raw.reshape(size, -1)
    out = first.astype(kind)
    for i, plane in enumerate(others, 1):
        # Upper planes are mostly zero.
        if plane.any():
            out |= plane.astype(kind) << kind.type(8 * i)
    return out.view(of)


def pack(blocks):
    """Record batches of one row per block, with the number of its lines and units. The bytes of ids lie in planes, as the upper ones are mostly zero."""
    import pyarrow as pa

    for b in blocks:
        parts = (b.docs.tobytes(), b.lines.tobytes(), planes(b.ids.astype("<u4")), b.vocabulary.tobytes(), b.units.tobytes(), b.inside.tobytes())
        places = pa.array([len(b.lines) + len(b.units)], pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in parts), places], [c.split()[0] for c in BLOCKS.split(", ")])


def unpack(batches):
    """The blocks of record batches; columns that were not read stay empty."""
    import numpy as np

    kinds = {"docs": DOC, "lines": LINE, "ids": "u1", "vocabulary": "<u8", "units": "<u8", "inside": "u1"}
    for batch in batches:
        for row in range(batch.num_rows):
            b = Block(**{c: np.frombuffer(batch.column(c)[row].as_buffer() if c in batch.schema.names else b"", dtype=kinds[c]) for c in kinds})
            b.ids = of_planes(b.ids, "<u4")
            yield b


def build(docs, min_words: int = 1):
    """Blocks of (oid, dkey, text), with the lines of min_words distinct words or more."""
    held, size = [], 0
    for oid, dkey, text in docs:
        held.append((oid, dkey, text or ""))
        size += len(text or "")
        if size >= BLOCK_CHARS:
            yield block(held, min_words)
            held, size = [], 0
    if held:
        yield block(held, min_words)


def word_hashes(texts: list[str]):
    """Hashes of all words, the number of words of each line, the number of lines of each text."""
    import numpy as np

    parts, at, size = [], 0, 0
    for i, t in enumerate(texts, 1):
        size += len(t)
        if size >= HASH_CHARS or i == len(texts):
            parts.append(_hash_part(texts[at:i]))
            at, size = i, 0
    return tuple(np.concatenate(x) for x in zip(*parts))


@cache
def _products():
    """Of each place and byte, at place * 256 + byte, the byte times the place's factor."""
    import numpy as np

    rates = np.random.default_rng(20).integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.outer(rates, np.arange(256, dtype=np.uint64)).ravel()


def _hash_part(texts: list[str]):
    import numpy as np

    # Text by text, as only those with other characters than ASCII are slow to lower.
    raw = np.frombuffer("\n".join([t.lower() for t in texts]).encode().translate(tx.PLAIN_LINES), dtype=np.uint8)
    per_doc = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
    in_word = np.zeros(len(raw) + 2, dtype=bool)
    np.greater(raw, 32, out=in_word[1:-1])
    turns = np.flatnonzero(in_word[1:] != in_word[:-1])
    starts, sizes = turns[::2], turns[1::2] - turns[::2]
    line_starts = np.append(0, np.flatnonzero(raw == 10) + 1)
    counts = np.diff(np.append(np.searchsorted(starts, line_starts), len(starts)))
    if not len(starts):
        return np.empty(0, dtype=np.uint64), counts, per_doc
    into = np.cumsum(sizes) - sizes
    # A sum of byte times a random factor of its place; long words wrap around with a term of the place.
    # A byte and its place (as a byte) are the index of that product.
    at = np.empty((sizes.sum(), 2), dtype=np.uint8)
    at[:, 0] = raw[in_word[1:-1]]
    at[:, 1] = np.arange(len(at), dtype=np.int32).astype(np.uint8) - np.repeat(into.astype(np.uint8), sizes)
    terms = _products().take(at.view("<u2").ravel(), mode="clip")
    if sizes.max() > PLACES:
        place = np.arange(len(at)) - np.repeat(into, sizes)
        terms = tx.mix(terms + (place // PLACES).astype(np.uint64))
    return tx.mix(np.add.reduceat(terms, into) + sizes.astype(np.uint64)), counts, per_doc


def distinct(h):
    """The distinct values of a uint64 array and each value's place among them, without a sort."""
    import numpy as np
    import pyarrow as pa

    found = pa.array(h).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False), found.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def block(held, min_words: int = 1) -> Block:
    """The block of a list of (oid, dkey, text)."""
    import numpy as np

    h, counts, per_doc = word_hashes([x[2] for x in held])
    vocabulary, ids = distinct(h)
    order = np.argsort(-np.bincount(ids, minlength=len(vocabulary)), kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    vocabulary, ids = vocabulary[order], rank[ids]
    doc_of_line = np.repeat(np.arange(len(held)), per_doc)
    number = np.arange(len(counts)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    units, inside, unit_doc = _units(h, counts, doc_of_line, len(held))
    # Distinct words of each line, in one sort.
    key = np.repeat(np.arange(len(counts)), counts) << 32 | ids
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    line, ids = key >> 32, (key & 0xFFFFFFFF).astype(np.uint32)
    sizes = np.bincount(line, minlength=len(counts))
    ids = ids[sizes[line] >= min_words]
    some = np.flatnonzero(sizes >= max(1, min_words))
    lines = np.zeros(len(some), dtype=LINE)
    lines["no"], lines["n"] = number[some], sizes[some]
    if len(some):
        starts = np.cumsum(sizes[some]) - sizes[some]
        for name, w, shift in (("s1", vocabulary, 0), ("s2", vocabulary ^ np.uint64(0xA5A5A5A55A5A5A5A), 32)):
            lines[name] = tx.mix(np.add.reduceat(tx.mix(w)[ids], starts)) >> np.uint64(shift)
    docs = np.zeros(len(held), dtype=DOC)
    docs["oid"], docs["dkey"] = [x[0] for x in held], [x[1] for x in held]
    docs["tie"] = docs["dkey"].astype(np.int64).view(np.uint64) >> np.uint64(32)
    docs["lines"] = np.bincount(doc_of_line[some], minlength=len(held))
    docs["units"] = np.bincount(unit_doc, minlength=len(held))
    return Block(docs, lines, ids, vocabulary, units, inside)


def _units(h, counts, doc_of_line, n_docs: int):
    """Keys of the units of all texts of LONG words or more, whether they lie inside a long line, their documents."""
    import numpy as np

    starts, stops, inside, doc = cuts(h, counts, doc_of_line, n_docs)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), inside.astype(np.uint8), doc
    size = stops - starts
    into = np.cumsum(size) - size
    # Texts without units may stand between two units.
    at = np.arange(size.sum()) - np.repeat(into, size)
    w = h[np.repeat(starts, size) + at] * np.uint64(UNIT_SALT) + at.astype(np.uint64)
    return tx.mix(np.add.reduceat(tx.mix(w), into) ^ np.uint64(UNIT_SALT)), inside.astype(np.uint8), doc


def cuts(h, counts, doc_of_line, n_docs: int):
    """(first words, ends, whether inside a long line, documents) of the units of texts
    whose lines have the given counts of words; h are the hashes of all words."""
    import numpy as np

    none = np.empty(0, dtype=np.int64)
    per_doc = np.bincount(doc_of_line, weights=counts, minlength=n_docs).astype(np.int64)
    if not (per_doc >= LONG).any():
        return none, none, none, none
    doc = np.repeat(np.arange(n_docs), per_doc)
    ends = np.cumsum(counts)
    long_line = counts >= LONG
    doc_ends = np.cumsum(per_doc)
    edge = np.zeros(len(h) + 1, dtype=bool)
    for x in (doc_ends - per_doc, doc_ends, ends[long_line], (ends - counts)[long_line]):
        edge[x] = True
    edges = np.flatnonzero(edge)
    # Least hash of the REACH words before and after, documents apart.
    place = np.arange(len(h)) + REACH * (doc + 1)
    g = np.full(len(h) + REACH * (n_docs + 1), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    g[place] = tx.mix(h)
    n = len(g) - 2 * REACH
    # Least of REACH words from each on, by doubling.
    least, width = g, 1
    while width < REACH:
        step = min(width, REACH - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    before, mid, after = least[:n], g[REACH:REACH + n], least[REACH + 1:REACH + 1 + n]
    at = np.flatnonzero(((mid < before) & (mid <= after))[place - REACH])
    right = np.searchsorted(edges, at, side="right")
    edge[at[(at - edges[right - 1] >= REACH) & (edges[np.minimum(right, len(edges) - 1)] - at >= REACH)]] = True
    starts = np.flatnonzero(edge[:-1])
    pieces = np.maximum(1, np.diff(np.append(starts, len(h))) // UNIT)
    again = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(starts, pieces) + again * UNIT
    stops = np.append(starts[1:], len(h))
    ok = per_doc[doc[starts]] >= LONG
    starts, stops = starts[ok], stops[ok]
    return starts, stops, long_line[np.searchsorted(ends, starts, side="right")].astype(np.int64), doc[starts]
