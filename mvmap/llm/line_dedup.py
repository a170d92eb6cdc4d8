"""Operator 3: line de-duplication by an exact set-similarity join.

A line is the set of its words (lower case, runs of ASCII letters, digits and
non-ASCII characters). A line is removed if an earlier line has a Jaccard similarity
of ``percent`` or more with it, whether or not that one stays; equal sets are the
case of 100. Lines stand in the order of (doc_id nulls first, place in the document);
lines of one doc_id and place, from rows with different texts, in that of a hash. Lines without a word are neither compared nor removed;
``min_words`` (1) is the least number of distinct words of a line that is.

Passages repeated inside long lines: the units of line_sets are compared by their
sequence of words. From a line of ``LONG`` words or more that stays, runs of
neighbouring units that have an earlier equal go if they hold ``run_words`` words or
more. The words of a repeated passage before its first whole unit and after its
last one stay.

How: texts are cut into words once and written in packed blocks. The lines that hold
a word are counted over all documents in a table of ``2 ** RARITY_BITS`` hashed
counters (a fixed size, so it is broadcast); a line's words stand in ascending order
of (counter, hash), one order for all lines. Two different sets above the threshold
share a word of their prefixes (the n - ceil(t n) + 1 rarest words), and two or
three words of prefixes longer by one or two. The index therefore has one entry for
each prefix word of at most ``RARE`` lines, and for a more frequent one an entry for
each pair (triple) that it makes with later words of the longer prefix. Entries
travel as packed arrays, one for each block and bucket, so copies within a block are
one entry; buckets of more than ``BUCKET`` entries are split, each part meeting each
other. Their number follows that of the entries, and a task looks at ``BUCKET`` entries
(or one key's) and about ``PAIRS`` pairs at a time, so its memory does not grow with the
input. A bucket sorts its entries by (key, length), so that the length filter is a
range; positions and a signature of ``SIGNS`` times 64 bits, whose missing bits bound the
overlap, filter its pairs. Of a line's partners in a bucket the first ``CLEAR`` likely
ones leave it, or the first ``KEPT`` where none is likely. The Jaccard index of the whole
sets verifies these pairs. Lines that may have had more partners and have no true one so
far meet all of them in a second pass.

Null and empty texts have no lines to remove. Rows that repeat a doc_id and text
get the same decisions and do not remove each other's lines; rows of one doc_id with
different texts are different documents. An empty table gives an empty result. A very
long text is held whole by one task. Other columns stay, whatever their names, except
that ``n_chars`` follows the text.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mvmap.llm import common
from mvmap.llm import line_sets as ls
from mvmap.llm import text as tx

RARITY_BITS = 22
#: Most lines of a word that is a key alone, and of one that makes pairs; entries of a bucket; parts of the key space whose entries are counted.
RARE, COMMON, BUCKET, CELLS = 4096, 1 << 18, 1 << 18, 1 << 16
#: Pairs that a bucket looks at in one step; lines of a key that later ones meet first; pairs held before the partners over a line's first ones go.
STEP, FIRST, PAIRS = 1 << 19, 2048, 1 << 20
#: Partners of a line that leave a bucket: of those whose signatures leave half of the words to spare, and of others where there is none.
CLEAR, KEPT = 3, 128
#: Words of a signature: one for frequent words, the others for words of at most RARE lines.
SIGNS = 3
#: The words of text.plain_words, in the text as it is.
WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
FIRSTS = [("s1", "<u8"), ("s2", "<u4"), ("oid", "<i8"), ("tie", "<u4"), ("no", "<i4"), ("many", "u1")]
ENTRY = [("key", "<u4"), ("n", "<u4"), ("pos", "<u2"), ("s1", "<u8"), *((f"sig{i}", "<u8") for i in range(SIGNS)), ("oid", "<i8"), ("no", "<i4")]
NUMBERS = {"n", "pos", "oid", "no", "slot"}
PACKED = "bucket int, part int, other int, rows binary"


# Arrays between map and reduce tasks


def _dump(rows) -> bytes:
    """Contiguous columns, one by one; numbers in planes of bytes, many of which are all zero."""
    return b"".join([ls.planes(v) if c in NUMBERS else v.tobytes() for c, v in rows.items()])


def _load(raw, dtype):
    import numpy as np

    kind = np.dtype(dtype)
    rows, at = np.empty(len(raw) // kind.itemsize, dtype=kind), 0
    for c in kind.names:
        if c in NUMBERS:
            rows[c] = ls.of_planes(np.frombuffer(raw, dtype=np.uint8, count=kind[c].itemsize * len(rows), offset=at), kind[c])
        else:
            rows[c] = np.frombuffer(raw, dtype=kind[c], count=len(rows), offset=at)
        at += kind[c].itemsize * len(rows)
    return rows


def _send(rows, bucket, part, other):
    """One row for each (bucket, part, other), with the packed rows of it. ``rows``: a
    structured array, or of each column its values and the row's place among them."""
    import numpy as np
    import pyarrow as pa

    order = np.lexsort((other, part, bucket)) if part.any() or other.any() else np.argsort(bucket)
    where = np.stack([bucket, part, other])[:, order]
    n = len(order)
    columns = {c: v[at[order]] for c, (v, at) in rows.items()} if isinstance(rows, dict) else {c: rows[c][order] for c in rows.dtype.names}
    cuts = np.flatnonzero(np.append(True, (where[:, 1:] != where[:, :-1]).any(axis=0))) if n else np.empty(0, dtype=np.int64)
    blobs = [_dump({c: v[a:b] for c, v in columns.items()}) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), n])]
    columns = [pa.array(w[cuts].astype(np.int32)) for w in where]
    return pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.binary())], [c.split()[0] for c in PACKED.split(", ")])


def _received(batches):
    """((bucket, part, other), packed rows) of each group, in sorted order; the packed rows one at a time."""
    for batch in batches:
        yield from zip(zip(*(c.to_pylist() for c in batch.columns[:3])), (x.as_py() for x in batch.column(3)))


def _dealt(packed: DataFrame) -> DataFrame:
    return packed.repartition("bucket", "part", "other").sortWithinPartitions("bucket", "part", "other")


# First places of equal lines and units


def _read(batches, min_words: int):
    def docs():
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())

    yield from ls.pack(ls.build(docs(), min_words))


def _places(block, which):
    """FIRSTS rows of a block's lines or units."""
    import numpy as np

    lines = which == "lines"
    doc = block.docs[block.doc_of_lines() if lines else block.doc_of_units()]
    rows = np.zeros(len(doc), dtype=FIRSTS)
    rows["oid"], rows["tie"] = doc["oid"], doc["tie"]
    if lines:
        rows["s1"], rows["s2"], rows["no"] = block.lines["s1"], block.lines["s2"], block.lines["no"]
    else:
        rows["s1"], rows["no"] = block.units, block.unit_numbers()
    return rows


def _first(rows):
    """One row per key: its first place, and whether it has several."""
    import numpy as np

    s1 = np.ascontiguousarray(rows["s1"])
    order = np.argsort(s1)
    again = np.append(False, s1[order][1:] == s1[order][:-1])
    if again.any():
        # Only keys that come again have an order of their own.
        at = np.flatnonzero(again | np.append(again[1:], False))
        twin = rows[order[at]]
        order[at] = order[at][np.lexsort((twin["tie"], twin["no"], twin["oid"], twin["s2"], twin["s1"]))]
    rows = rows[order]
    same = np.zeros(len(rows) + 1, dtype=bool)
    same[1:-1] = (rows["s1"][1:] == rows["s1"][:-1]) & (rows["s2"][1:] == rows["s2"][:-1])
    other = np.zeros(len(rows), dtype=bool)
    other[1:] = same[1:-1] & ((rows["oid"][1:] != rows["oid"][:-1]) | (rows["tie"][1:] != rows["tie"][:-1]) | (rows["no"][1:] != rows["no"][:-1]))
    at = np.flatnonzero(~same[:-1])
    out = rows[at]
    if len(out):
        out["many"] = np.maximum.reduceat(other | rows["many"].astype(bool), at)
    return out


def _send_firsts(batches, buckets: int):
    import numpy as np

    for block in ls.unpack(batches):
        rows = np.concatenate([_first(_places(block, "lines")), _first(_places(block, "units"))])
        bucket = (rows["s1"] % np.uint64(buckets)).astype(np.int64)
        yield _send(rows, bucket, np.zeros_like(bucket), np.zeros_like(bucket))


def _repeated(batches):
    """Keys with several places, and the first of these."""
    import numpy as np
    import pyarrow as pa

    def reduced(held):
        return _first(np.concatenate(held)) if held else np.empty(0, dtype=FIRSTS)

    def told(rows):
        rows = rows[rows["many"] > 0]
        columns = [rows["s1"].view(np.int64), rows["s2"].view(np.int32), rows["oid"], rows["tie"].view(np.int32), rows["no"]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["s1", "s2", "oid", "tie", "no"])

    group, held, n = None, [], 0
    for key, raw in _received(batches):
        if key != group and held:
            yield told(reduced(held))
            held, n = [], 0
        group = key
        held.append(_load(raw, FIRSTS))
        n += len(held[-1])
        if n > 4 * BUCKET:  # a set that a large share of all blocks hold is one row again
            held = [reduced(held)]
            n = 2 * len(held[0])
    if held:
        yield told(reduced(held))


# Rarity


def _slots(h):
    import numpy as np

    return (h >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _fresh(block):
    """Lines of a block that are the first of their set in it, as a mask."""
    import numpy as np

    doc = block.docs[block.doc_of_lines()]
    order = np.lexsort((doc["tie"], block.lines["no"], doc["oid"], block.lines["s2"], block.lines["s1"]))
    s1, s2 = block.lines["s1"][order], block.lines["s2"][order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
    out = np.zeros(len(order), dtype=bool)
    out[order[first]] = True
    return out


def _count_words(batches):
    """Sums of one task, in PARTS parts of the slots: pairs of slot and count."""
    import numpy as np

    total = np.zeros(1 << RARITY_BITS, dtype=np.int64)
    for block in ls.unpack(batches):
        words = block.ids[np.repeat(_fresh(block), block.lines["n"])]
        np.add.at(total, _slots(block.vocabulary), np.bincount(words, minlength=len(block.vocabulary)))
    yield from _sparse(total)


def _sparse(total):
    import numpy as np

    width = max(1, len(total) // 64)
    for part in range(-(-len(total) // width)):
        piece = total[part * width:(part + 1) * width]
        at = np.flatnonzero(piece)
        rows = np.zeros(len(at), dtype=[("slot", "<u4"), ("n", "<u4")])
        rows["slot"], rows["n"] = part * width + at, np.minimum(piece[at], 0xFFFFFFFF)
        none = np.zeros(len(at), dtype=np.int64)
        yield _send(rows, none + part, none, none)


def _summed(batches, size: int):
    import numpy as np
    import pyarrow as pa

    width, group, total = max(1, size // 64), None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())], ["part", "counts"])
    for (part, _, _), raw in _received(batches):
        if part != group:
            if group is not None:
                yield out()
            group, total = part, np.zeros(width, dtype=np.int64)
        rows = _load(raw, [("slot", "<u4"), ("n", "<u4")])
        total[rows["slot"] - part * width] += rows["n"]
    if group is not None:
        yield out()


def _counters(sparse: DataFrame, size: int):
    """The sums as one uint32 array of a fixed size on the driver."""
    import numpy as np

    out = np.zeros(size, dtype="<u4")
    width = max(1, size // 64)
    for r in common.map_arrow(_dealt(sparse), partial(_summed, size=size), "part int, counts binary").collect():
        out[r.part * width:(r.part + 1) * width] = np.frombuffer(r.counts, dtype="<u4")
    return out


# The index


def _prefix_keys(vocabulary, words, sizes, rarity, percent: int):
    """(line, position, 64-bit key) of the index entries of lines with the given sets
    (``words`` are places in the vocabulary); lines too short for a different partner
    have none."""
    import numpy as np

    df = rarity[_slots(vocabulary)]
    order = np.lexsort((vocabulary, df))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    vocabulary, df = vocabulary[order], df[order]
    line = np.repeat(np.arange(len(sizes)), sizes)
    word = line << 32 | rank[words]
    word.sort()
    word &= 0xFFFFFFFF
    place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = sizes - (percent * sizes + 99) // 100 + 1
    prefix[sizes * (100 - percent) < percent] = 0
    # A word counted in one line of all documents stands in no other.
    at = np.flatnonzero(place < prefix[line])
    at = at[df[word[at]] > 1]
    level = 1 + (df[word[at]] > RARE) + (df[word[at]] > COMMON)
    h = lambda x: vocabulary[word[x]]
    found = [(at[level == 1], h(at[level == 1]))]
    left = lambda x, extra: prefix[line[x]] + extra - 1 - place[x]
    pairs = at[level == 2]
    for d in range(1, int(left(pairs, 1).max(initial=0)) + 1):
        x = pairs[left(pairs, 1) >= d]
        found.append((x, _joint(h(x), h(x + d))))
    triples = at[level == 3]
    for e in range(2, int(left(triples, 2).max(initial=0)) + 1):
        x = triples[left(triples, 2) >= e]
        for d in range(1, e):
            found.append((x, _joint(_joint(h(x), h(x + d)), h(x + e))))
    at = np.concatenate([x for x, _ in found])
    return line[at], place[at], tx.mix(np.concatenate([k for _, k in found]))


def _joint(a, b):
    import numpy as np

    return tx.mix(a * np.uint64(ls.UNIT_SALT) + b)


def _keys(block, rarity, percent: int, wanted=None):
    """The block's fresh lines (those wanted), their words as places in the vocabulary, and their index keys."""
    import numpy as np

    fresh = _fresh(block)
    if wanted is not None:
        fresh &= wanted
    sizes = block.lines["n"].astype(np.int64)
    words = block.ids[np.repeat(fresh, sizes)]
    at = np.flatnonzero(fresh)
    line, place, key = _prefix_keys(block.vocabulary, words, sizes[at], rarity, percent)
    return at, words, line, place, key


def _cells(key):
    import numpy as np

    return (key >> np.uint64(48)).astype(np.int64) % CELLS


def _count_cells(batches, rarity, percent: int, every: int):
    """Entries of each cell, from one of ``every`` blocks: they only tell how to deal the
    work, no result depends on them."""
    import numpy as np

    total = np.zeros(CELLS, dtype=np.int64)
    for block in ls.unpack(batches):
        total += every * np.bincount(_cells(_keys(block, rarity.value, percent)[4]), minlength=CELLS)
    yield from _sparse(total)


def _within(block, vocabulary, percent: int):
    """Lines that have ``percent`` or more of their words in a bit map, as a mask: others
    are similar to no set of such words."""
    import numpy as np

    n = block.lines["n"].astype(np.int64)
    known = _has(vocabulary, block.vocabulary)[block.ids]
    return 100 * np.add.reduceat(known, np.cumsum(n) - n, dtype=np.int64) >= percent * n if len(n) else np.empty(0, dtype=bool)


def _send_entries(batches, rarity, percent: int, parts, buckets: int, keys=None, vocabulary=None):
    """The packed entries of each bucket; with ``keys``, a bit map over keys, of those in it
    only, and of lines whose words may be in ``vocabulary``, a bit map over words."""
    import numpy as np

    for block in ls.unpack(batches):
        at, words, line, place, key = _keys(block, rarity.value, percent, None if vocabulary is None else _within(block, vocabulary.value, percent))
        if keys is not None:
            ok = _has(keys.value, key)
            line, place, key = line[ok], place[ok], key[ok]
        if not len(line):
            continue
        sizes = block.lines["n"][at].astype(np.int64)
        if keys is not None:
            # Only the lines that are left need a signature.
            used = np.zeros(len(at), dtype=bool)
            used[line] = True
            words, line = words[np.repeat(used, sizes)], (np.cumsum(used) - 1)[line]
            at, sizes = at[used], sizes[used]
        doc = block.docs[block.doc_of_lines()[at]]
        s1 = block.lines["s1"][at]
        by_line = dict([("n", sizes), ("s1", s1), *_signs(block.vocabulary, words, sizes, rarity.value), ("oid", doc["oid"]), ("no", block.lines["no"][at])])
        by_entry = {"key": key & np.uint64(0xFFFFFFFF), "pos": np.minimum(place, 0xFFFF)}
        cell = _cells(key)
        k = parts.value[cell]
        bucket = np.where(k == 1, cell % buckets, buckets + cell)
        copy = np.arange(len(k))
        own = again = np.zeros_like(copy)
        if (k > 1).any():
            # Of a split cell, an entry goes to each pair of its part with another.
            again = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            own, copy = np.repeat(_part(s1[line], k), k), np.repeat(copy, k)
        of_line = line[copy]
        rows = {c: (by_line[c].astype(kind), of_line) if c in by_line else (by_entry[c].astype(kind), copy) for c, kind in ENTRY}
        yield _send(rows, bucket[copy], np.minimum(own, again), np.maximum(own, again))


def _signs(vocabulary, words, sizes, rarity):
    """Names and values of the signature's words."""
    import numpy as np

    which = (vocabulary >> np.uint64(6)) % np.uint64(SIGNS)
    bit = np.uint64(1) << (vocabulary & np.uint64(63))
    starts = np.cumsum(sizes) - sizes
    return [(f"sig{i}", np.bitwise_or.reduceat(np.where(which == i, bit, np.uint64(0))[words], starts)) for i in range(SIGNS)]


def _part(s1, k):
    import numpy as np

    return (tx.mix(s1) % k.astype(np.uint64)).astype(np.int64)


def _has(bits, key):
    import numpy as np

    at = key % np.uint64(64 * len(bits))
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


# Pairs of a bucket


def _meet(batches, percent: int, parts, xs=None):
    """x, y, more: each line x of a bucket with its first KEPT partners y there, and
    whether it may have more; with ``xs``, a bit map over sets, these with all their partners."""
    import numpy as np
    import pyarrow as pa

    def flush(group, held):
        for rows in _slices(held):
            part = None
            if group[1] != group[2]:
                # Cells of a split bucket have one number of parts.
                k = np.full(len(rows), parts.value[group[0] - buckets(parts)])
                part = _part(rows["s1"], k)
            for x, y, more in partners(rows, percent, part, xs and xs.value):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(more)], ["x", "y", "more"])

    group, held = None, []
    for key, raw in _received(batches):
        if key != group and held:
            yield from flush(group, held)
            held = []
        group = key
        held.append(_load(raw, ENTRY))
    if held:
        yield from flush(group, held)


def _slices(held):
    """The entries of a bucket in arrays of about BUCKET entries; those of a key stay together."""
    import numpy as np

    n = -(-sum(map(len, held)) // BUCKET)
    for i in range(n):
        yield np.concatenate(held if n == 1 else [h[(h["key"].astype(np.uint64) * np.uint64(n) >> np.uint64(32)) == i] for h in held])


def buckets(parts) -> int:
    return int(parts.value[CELLS])


def partners(rows, percent: int, part=None, xs=None):
    """(x, y, more) as _meet, of the entries of one bucket, in pieces. ``part``: only pairs across parts."""
    from itertools import chain

    import numpy as np

    rows, part = _distinct(rows, part)
    n = rows["n"].astype(np.int64)
    key = rows["key"].astype(np.uint64) << np.uint64(32)
    place = key | rows["n"]
    bound = lambda of, side: np.searchsorted(place, key | of.astype(np.uint64), side=side)
    lo = bound((percent * n + 99) // 100, "left")
    # Words from the entry's place on bound the length of a shorter partner.
    rest = n - rows["pos"]
    own = np.arange(len(rows))
    hi = np.minimum(own, bound(np.maximum(rest * (100 + percent) // percent - n, 0), "right"))
    wanted = None if xs is None else _has(xs, rows["s1"])
    if wanted is not None:
        # Pairs without a wanted line are not looked at.
        lo = np.where(wanted, lo, hi)
        up = bound(100 * n // percent, "right")
        for a, b, _, _ in chain(_windows(rows, own[wanted], own[wanted] + 1, up[wanted], percent, part), _windows(rows, own, lo, hi, percent, part)):
            x, y = _directed(rows, a, b)
            x, y = x[wanted[x]], y[wanted[x]]
            yield rows["s1"][x], rows["s1"][y], np.zeros(len(x), dtype=bool)
        return
    large = hi - lo > FIRST
    found, size, most = [], 0, PAIRS
    for a, b, clear, more in chain(_leaders(rows, large, percent, part), _windows(rows, own, np.where(large, hi, lo), hi, percent, part)):
        # The later one is x.
        found.append((*_directed(rows, a, b), clear, more))
        size += len(a)
        if size > most:
            found = [_nearest(rows, found)]
            size = len(found[0][0])
            most = max(PAIRS, 2 * size)
    if found:
        x, y, _, more = _nearest(rows, found)
        yield rows["s1"][x], rows["s1"][y], more


def _nearest(rows, found):
    """Of the pairs in a list of (x, y, clear, more), those of each line x with its first
    partners; ``more`` tells whether it has others. What this leaves can be joined with
    further pairs and go through it again: the result is that of all at once."""
    import numpy as np

    x, y, clear, more = (np.concatenate([f[i] for f in found]) for i in range(4))
    clear, more = clear.astype(bool), more.astype(bool)
    order = np.lexsort((rows["s1"][y], rows["no"][y], rows["oid"][y], ~clear, rows["s1"][x]))
    x, y, clear, more = x[order], y[order], clear[order], more[order]
    if not len(x):
        return x, y, clear, more
    s1, other = rows["s1"][x], rows["s1"][y]
    first = np.append(True, s1[1:] != s1[:-1])
    fresh = first | np.append(True, other[1:] != other[:-1])
    at = np.flatnonzero(first)
    line = np.cumsum(first) - 1
    # The place of each partner among the different ones of its line, likely ones first.
    nth = np.cumsum(fresh) - 1
    nth -= nth[at][line]
    kept = np.where(clear[at], CLEAR, KEPT)[line]
    ok = fresh & (nth < kept) & (clear | ~clear[at][line])
    more = np.logical_or.reduceat(more | (fresh & ~ok), at)[line]
    return x[ok], y[ok], clear[ok], more[ok]


def _distinct(rows, part):
    """The rows in order of (key, length); of equal sets from several blocks the first by place."""
    import numpy as np

    place = rows["key"].astype(np.uint64) << np.uint64(32) | rows["n"]
    order = np.argsort(place)
    rows, part = rows[order], None if part is None else part[order]
    same = tx.mix(rows["s1"] ^ tx.mix(place[order]))
    by = np.argsort(same)
    again = np.append(False, same[by][1:] == same[by][:-1])
    if not again.any():
        return rows, part
    run = np.cumsum(~again)
    twin = np.flatnonzero(again | np.append(again[1:], False))
    run, twin = run[twin], by[twin]
    order = np.lexsort((rows["no"][twin], rows["oid"][twin], run))
    keep = np.ones(len(rows), dtype=bool)
    keep[twin[order[np.append(False, run[order][1:] == run[order][:-1])]]] = False
    return rows[keep], None if part is None else part[keep]


def _directed(rows, a, b):
    import numpy as np

    later = np.zeros(len(a), dtype=bool)
    same = np.ones(len(a), dtype=bool)
    for c in ("oid", "no", "s1"):
        later |= same & (rows[c][a] > rows[c][b])
        same &= rows[c][a] == rows[c][b]
    return np.where(later, a, b), np.where(later, b, a)


def _windows(rows, at, lo, hi, percent, part):
    """(a, b, clear, False) in pieces: the pairs of at[i] with lo[i] to hi[i] - 1 that pass."""
    import numpy as np

    size = np.maximum(hi - lo, 0)
    ends = np.cumsum(size)
    begin = 0
    while begin < len(at):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + STEP, side="right")))
        k = size[begin:stop]
        a = np.repeat(at[begin:stop], k)
        b = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[begin:stop], k)
        ok, clear = _passes(rows, a, b, percent, part)
        yield a[ok], b[ok], clear, np.zeros(len(ok), dtype=bool)
        begin = stop


def _leaders(rows, large, percent, part):
    """Keys with a line of more than FIRST possible partners: all its lines meet the
    first FIRST of them by place, then those without a likely partner the next ones."""
    import numpy as np

    key = rows["key"]
    for k in np.unique(key[large]):
        mine = np.arange(np.searchsorted(key, k), np.searchsorted(key, k, side="right"))
        mine = mine[np.lexsort((rows["s1"][mine], rows["no"][mine], rows["oid"][mine]))]
        left, begin = np.arange(len(mine)), 0
        while begin < len(mine) and len(left):
            end = min(begin + FIRST, len(mine))
            heads = np.arange(begin, end)
            got = np.zeros(len(mine), dtype=bool)
            for at in range(0, len(left), max(1, STEP // FIRST)):
                chunk = left[at:at + max(1, STEP // FIRST)]
                a, b = np.repeat(chunk, len(heads)), np.tile(heads, len(chunk))
                a, b = a[a > b], b[a > b]
                # A pair is in the range of its longer line; small ranges are looked at with those of other keys.
                ok = large[np.maximum(mine[a], mine[b])]
                a, b = a[ok], b[ok]
                ok, clear = _passes(rows, mine[a], mine[b], percent, part)
                a, b = a[ok], b[ok]
                got[a[clear]] = True
                # A line that has a likely partner does not meet what is left.
                yield mine[a], mine[b], clear, got[a] & (a >= end)
            begin = end
            left = left[~got[left] & (left >= begin)]


def _passes(rows, a, b, percent, part):
    """Of the pairs, those that the length, positional and signature filters let pass,
    and which of these leave half of the spare words."""
    import numpy as np

    n = rows["n"].astype(np.int64)
    rest = n - rows["pos"]
    na, nb = n[a], n[b]
    need = -(-percent * (na + nb) // (100 + percent))
    ok = np.flatnonzero((np.minimum(rest[a], rest[b]) >= need) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)))
    if part is not None:
        ok = ok[part[a[ok]] != part[b[ok]]]
    ok = ok[rows["s1"][a[ok]] != rows["s1"][b[ok]]]
    # Words of each that the other lacks, at most.
    spare_a, spare_b = na[ok] - need[ok], nb[ok] - need[ok]
    half = (spare_a + spare_b) // 2
    for i in reversed(range(SIGNS)):
        x, y = rows[f"sig{i}"][a[ok]], rows[f"sig{i}"][b[ok]]
        spare_a, spare_b = spare_a - np.bitwise_count(x & ~y), spare_b - np.bitwise_count(y & ~x)
        good = (spare_a >= 0) & (spare_b >= 0)
        ok, spare_a, spare_b, half = ok[good], spare_a[good], spare_b[good], half[good]
    return ok, spare_a + spare_b >= half


# Verification


def _words(batches, sets):
    """s1, words of the sets in a bit map."""
    import numpy as np
    import pyarrow as pa

    for block in ls.unpack(batches):
        fresh = _fresh(block) & _has(sets.value, block.lines["s1"])
        sizes = block.lines["n"].astype(np.int64)
        words = block.vocabulary[block.ids[np.repeat(fresh, sizes)]].view(np.int64)
        offsets = np.append(0, np.cumsum(sizes[fresh])).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(block.lines["s1"][fresh].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(words))], ["s1", "words"])


def _mark(batches, size: int):
    """A bit map over uint64 keys, as one row of its words that are not zero."""
    import numpy as np

    bits = np.zeros(size // 64, dtype="<u8")
    for batch in batches:
        _set(bits, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
    yield _sparse_bits(bits)


def _set(bits, key):
    """Set the bits that _has tests."""
    import numpy as np

    at = np.unique(key % np.uint64(64 * len(bits)))
    word = (at >> np.uint64(6)).astype(np.int64)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1])[:len(word)])
    if len(first):
        bits[word[first]] |= np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)


def _sparse_bits(bits):
    import numpy as np
    import pyarrow as pa

    at = np.flatnonzero(bits)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits[at].view(np.int64))], ["word", "bits"])


def _bit_map(marks: DataFrame, size: int):
    import numpy as np

    got = marks.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, dtype="<u8")
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _map_size(n: int) -> int:
    """Bits for n keys: 2 MiB of them at least and 16 MiB at most, so that few of many
    million other keys pass. A bit map only prunes."""
    bits = 1 << 24
    while bits < 16 * n and bits < 1 << 27:
        bits *= 2
    return bits


def bit_map(keys: DataFrame):
    """A bit map of a bigint column, broadcast."""
    size = _map_size(keys.count())
    return keys.sparkSession.sparkContext.broadcast(_bit_map(common.map_arrow(keys, partial(_mark, size=size), "word int, bits bigint"), size))


def _verify(blocks: DataFrame, pairs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """s1 of the sets with a verified earlier match; s1 and words of all sets of the pairs."""
    ids = bit_map(pairs.select("x").union(pairs.select("y")))
    sets = common.map_arrow(blocks.select("docs", "lines", "ids", "vocabulary"), partial(_words, sets=ids), "s1 bigint, words array<bigint>")
    sets = common.materialise(sets.groupBy("s1").agg(F.first("words").alias("words")), "line-sets")
    met = pairs.join(sets, F.col("x") == F.col("s1")).select("x", "y", F.col("words").alias("x_words"))
    met = met.join(sets, F.col("y") == F.col("s1"))
    shared = F.size(F.array_intersect("x_words", "words"))
    true = met.filter(shared * (100 + percent) >= (F.size("x_words") + F.size("words")) * percent)
    return common.materialise(true.select(F.col("x").alias("s1")).distinct(), "matched"), sets


def _key_marks(batches, rarity, percent: int, size: int):
    """Bits of the index keys of sets of words."""
    import numpy as np

    bits = np.zeros(size // 64, dtype="<u8")
    for batch in batches:
        column = batch.column(0)
        vocabulary, words = np.unique(column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), return_inverse=True)
        sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        _set(bits, _prefix_keys(vocabulary, words, sizes, rarity.value, percent)[2])
    yield _sparse_bits(bits)


def sampled(blocks: int) -> int:
    """One of how many blocks tells the entries of the cells: 16 blocks or more do, an eighth at least."""
    return max(1, min(8, blocks // 16))


def matches(blocks: DataFrame, percent: int) -> DataFrame:
    """s1 of the sets that have an earlier, different, similar one."""
    import numpy as np

    spark = blocks.sparkSession
    share = spark.sparkContext.broadcast
    words = blocks.select("docs", "lines", "ids", "vocabulary")
    rarity = share(_counters(common.map_arrow(words, _count_words, PACKED), 1 << RARITY_BITS))
    every = sampled(blocks.count())
    picked = words.filter(F.crc32(F.substring("docs", 1, 64)) % every == 0)
    cells = _counters(common.map_arrow(picked, partial(_count_cells, rarity=rarity, percent=percent, every=every), PACKED), CELLS).astype(np.int64)
    n_buckets = max(64, -(-int(cells.sum()) // BUCKET))
    parts = share(np.append(np.maximum(1, -(-cells // BUCKET)), n_buckets))

    common.sweep(spark)

    def met(keys=None, xs=None, vocabulary=None):
        sent = common.map_arrow(words, partial(_send_entries, rarity=rarity, percent=percent, parts=parts, buckets=n_buckets, keys=keys, vocabulary=vocabulary), PACKED)
        return common.map_arrow(_dealt(sent), partial(_meet, percent=percent, parts=parts, xs=xs), "x bigint, y bigint, more boolean")

    first = common.materialise(met().groupBy("x", "y").agg(F.max("more").alias("more")), "pairs")
    common.sweep(spark)
    found, sets = _verify(blocks, first.select("x", "y"), percent)
    open_ = first.filter("more").select(F.col("x").alias("s1")).distinct()
    open_ = common.materialise(open_.join(found, "s1", "left_anti"), "open")
    n = open_.count()
    if n:
        xs = bit_map(open_)
        size = _map_size(16 * n)
        theirs = sets.join(open_, "s1", "left_semi").select("words")
        keys = share(_bit_map(common.map_arrow(theirs, partial(_key_marks, rarity=rarity, percent=percent, size=size), "word int, bits bigint"), size))
        vocabulary = bit_map(theirs.select(F.explode("words").alias("word")).distinct())
        rest = met(keys, xs, vocabulary).select("x", "y").distinct().join(first.select("x", "y"), ["x", "y"], "left_anti")
        rest = common.materialise(rest, "pairs")
        found = common.materialise(found.union(_verify(blocks, rest, percent)[0]).distinct(), "matched")
    common.release(sets)
    return found


# Removal


def _hits(batches, keys):
    """Lines and units whose key may be in the bit map."""
    import numpy as np
    import pyarrow as pa

    for block in ls.unpack(batches):
        rows, dkey = [], []
        for which, doc in (("lines", block.doc_of_lines()), ("units", block.doc_of_units())):
            places = _places(block, which)
            ok = _has(keys.value, places["s1"])
            if which == "units":
                ok &= (places["no"] & 1) == 1
            rows.append(places[ok])
            dkey.append(block.docs["dkey"][doc[ok]])
        rows, dkey = np.concatenate(rows), np.concatenate(dkey)
        columns = [dkey, rows["s1"].view(np.int64), rows["s2"].view(np.int32), rows["oid"], rows["tie"].view(np.int32), rows["no"]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["dkey", "s1", "s2", "oid", "tie", "no"])


def _n_places(blocks: DataFrame) -> int:
    """Lines and units of all blocks."""
    return int(blocks.agg(F.sum("places")).first()[0] or 0)


def removals(docs: DataFrame, percent: int = 80, min_words: int = 1) -> DataFrame:
    """dkey, lines: the numbers of the lines (from 0) to remove and of the units
    (below 0) with an earlier equal, one row per distinct (doc_id, text) that has
    any; dkey is ``doc_key()``."""
    if not 67 <= percent <= 100:
        raise ValueError("percent must be from 67 to 100")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("oid"), doc_key().alias("dkey"), F.col("text").cast("string").alias("text"))
    blocks = common.materialise(common.map_arrow(rows, partial(_read, min_words=min_words), ls.BLOCKS), "blocks", "zstd")
    n = max(64, -(-_n_places(blocks) // BUCKET))
    sent = common.map_arrow(blocks.select("docs", "lines", "units", "inside"), partial(_send_firsts, buckets=n), PACKED)
    repeated = common.materialise(common.map_arrow(_dealt(sent), _repeated, "s1 bigint, s2 int, oid bigint, tie int, no int"), "repeated")
    common.sweep(docs.sparkSession)
    matched = matches(blocks, percent)

    keys = bit_map(repeated.select("s1").union(matched))
    told = common.map_arrow(blocks.select("docs", "lines", "units", "inside"), partial(_hits, keys=keys), "dkey bigint, s1 bigint, s2 int, oid bigint, tie int, no int")
    first = repeated.select("s1", "s2", *[F.col(c).alias(f"first_{c}") for c in ("oid", "tie", "no")])
    same = (F.col("oid") == F.col("first_oid")) & (F.col("tie") == F.col("first_tie")) & (F.col("no") == F.col("first_no"))
    # s2 is no key of the join, so that both joins deal by s1 and the rows travel once.
    told = told.join(first.withColumnRenamed("s2", "first_s2"), (told["s1"] == first["s1"]) & (F.col("s2").bitwiseXOR(F.col("first_s2")) == 0), "left").drop(first["s1"])
    told = told.join(matched.withColumn("hit", F.lit(True)), "s1", "left")
    gone = told.filter((F.col("hit") & (F.col("no") >= 0)) | ~same)
    out = common.materialise(gone.groupBy("dkey").agg(F.collect_set("no").alias("lines")), "removals")
    common.release(blocks)
    return out


def doc_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text").cast("string"))


def without(texts: list[str], hits: list[list[int]], run_words: int) -> list[tuple[str, list[int], int]]:
    """Of each text: the text without the hit lines and runs of units, the numbers of the
    lines that are gone (those that lose all units included), the count of removed units."""
    import numpy as np

    lines = [{x for x in h if x >= 0} for h in hits]
    units = [i for i, h in enumerate(hits) if min(h, default=0) < 0]
    cut: dict[int, dict[int, object]] = {}
    counts_of, gone = {}, dict.fromkeys(range(len(texts)), 0)
    if units:
        h, counts, per_doc = ls.word_hashes([texts[i] for i in units])
        doc_of_line = np.repeat(np.arange(len(units)), per_doc)
        starts, stops, _, doc = ls.cuts(h, counts, doc_of_line, len(units))
        ends = np.cumsum(counts)
        line_of = np.searchsorted(ends, starts, side="right")
        first_line = np.cumsum(per_doc) - per_doc
        # Hit units as places in the list of all, then runs of neighbours in one line.
        first_unit = np.searchsorted(doc, np.arange(len(units)))
        at = np.sort(np.concatenate([first_unit[k] + ((np.array([x for x in hits[i] if x < 0]) - ls.FIRST_UNIT) >> 1) for k, i in enumerate(units)]))
        begin = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (line_of[at[1:]] != line_of[at[:-1]])))
        last = np.append(begin[1:], len(at)) - 1
        for a, b in zip(at[begin].tolist(), at[last].tolist()):
            if stops[b] - starts[a] >= run_words:
                line = int(line_of[a])
                k = int(doc[a])
                gone[units[k]] += b - a + 1
                drop = cut.setdefault(units[k], {}).setdefault(line - int(first_line[k]), np.zeros(int(counts[line]), dtype=bool))
                into = int(ends[line] - counts[line])
                drop[starts[a] - into:stops[b] - into] = True
    out = []
    for i, text in enumerate(texts):
        left = []
        for number, z in enumerate(text.split("\n")):
            drop = cut.get(i, {}).get(number)
            if number in lines[i] or (drop is not None and drop.all()):
                lines[i].add(number)
                continue
            if drop is not None:
                # Each word goes with what stands between it and the next; the first also with what stands before.
                places = [m.start() for m in WORD.finditer(z)]
                places[0] = 0
                z = "".join(z[a:b] for a, b, gone_word in zip(places, [*places[1:], len(z)], drop.tolist()) if not gone_word)
            left.append(z)
        out.append(("\n".join(left), sorted(lines[i]), gone[i]))
    return out


def _without(texts, hits, run_words):
    import pyarrow as pa

    hits = hits.to_pylist()
    some = [i for i, h in enumerate(hits) if h is not None]
    rows: list[tuple] = [(None, None, None)] * len(hits)
    if some:
        for i, r in zip(some, without(texts.take(pa.array(some)).to_pylist(), [hits[i] for i in some], run_words[0].as_py())):
            rows[i] = r
    kinds = (pa.string(), pa.list_(pa.int32()), pa.int32())
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["text", "lines", "units"])


def cleaned(docs: DataFrame, percent: int, min_words: int, run_words: int) -> DataFrame:
    """row: all columns as a struct; cut: null for a text that stays as it is, else
    struct(text, lines, units) of the cleaned text, the numbers of the removed lines
    and the count of removed units."""
    common.ship(docs.sparkSession)
    cut = F.arrow_udf(_without, "text string, lines array<int>, units int")
    gone = removals(docs, percent, min_words)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_key().alias("dkey"))
    # One row a document on the other side: the texts need no sort.
    joined = rows.join(gone.hint("shuffle_hash"), "dkey", "left")
    told = F.when(F.col("lines").isNotNull(), F.col("row.text").cast("string"))
    return joined.select("row", cut(told, F.col("lines"), F.lit(run_words)).alias("cut"))


def dedup_lines(docs: DataFrame, percent: int = 80, min_words: int = 1, run_words: int = 20) -> DataFrame:
    """The rows with their columns; the removed lines and passages are gone from ``text``."""
    out = cleaned(docs, percent, min_words, run_words)
    text = F.coalesce(F.col("cut.text"), F.col("row.text"))
    columns = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == "text":
            value = text
        elif c == "n_chars":
            value = F.when(F.col("row.text").isNull(), value).otherwise(F.length(text).cast(docs.schema[c].dataType))
        columns.append(value.alias(c))
    return out.select(columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, removed lines (sorted numbers), their count, the count of removed
    units, crc32 of the cleaned text."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    out = cleaned(docs, 80, 1, 20)
    lines = F.coalesce("cut.lines", F.array().cast("array<int>"))
    text = F.coalesce(F.col("cut.text"), F.col("row.text"))
    return out.select(
        "row.doc_id",
        F.size(lines).cast("bigint").alias("n_removed"),
        F.coalesce(F.col("cut.units"), F.lit(0)).cast("bigint").alias("n_units"),
        F.array_join(lines.cast("array<string>"), ",").alias("removed"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
