"""Byte formats against their inverses and plain definitions."""

import random

import pytest

from mvmap.functions import keys
from mvmap.sources import blocks, wal
from mvmap.sources.batch import BadFormat
from mvmap.sources.edits import VersionEdit


def test_version_edit():
    edit = VersionEdit(b"bytes", 4, 9, 1 << 40, [(2, keys.internal_key(b"k", 5, 1))], [(0, 7), (1, 8)], [(1, 9, 1 << 33, b"a" * 9, b"")])
    assert VersionEdit.decode(edit.encode()) == edit and len(edit.encode()) == edit.size()
    assert VersionEdit.decode(b"") == VersionEdit() and VersionEdit().size() == 0
    for raw in (edit.encode()[:-1], b"\x09\0\0\0", b"\x02\0\0\0\x01"):
        with pytest.raises(BadFormat):
            VersionEdit.decode(raw)


def test_blocks():
    rng = random.Random(2)
    entries = sorted({bytes(rng.choice(b"ab\xff") for _ in range(rng.randint(0, 9))): rng.randbytes(rng.randint(0, 5)) for _ in range(200)}.items())
    for interval in (1, 16, 1000):
        block = blocks.Block(blocks.build_block(entries, interval))
        assert list(block.entries()) == entries and len(block.restarts) == -(-len(entries) // interval)
        for target in (b"", b"a", b"abab", b"b\xff", b"\xff" * 20, *[k for k, _ in entries[::17]]):
            assert list(block.seek(target)) == [e for e in entries if e[0] >= target]
            assert block.before(target) == next((e for e in reversed(entries) if e[0] < target), None)
    assert list(blocks.Block(blocks.build_block([])).entries()) == []
    for raw in (b"", b"\xff\xff\xff\xff", b"\0\0\0\0"):
        with pytest.raises(BadFormat):
            blocks.Block(raw)
    meta, index = blocks.Handle(3, 4), blocks.Handle(1 << 20, 77)
    assert len(blocks.footer(meta, index)) == 24 and blocks.parse_footer(blocks.footer(meta, index)) == (meta, index)
    with pytest.raises(BadFormat):
        blocks.parse_footer(bytes(24))


def test_bloom():
    made = [b"key%d" % i for i in range(2000)]
    bloom = blocks.Bloom()
    raw = bloom.create(made)
    assert bloom.k == 6 and raw[-1] == 6 and all(bloom.may_match(k, raw) for k in made)
    wrong = sum(bloom.may_match(b"other%d" % i, raw) for i in range(5000))
    assert wrong < 150  # about 1 in 100 at ten bits a key
    assert not bloom.may_match(b"x", bloom.create([])) and bloom.may_match(b"x", b"\0\0\x1f")
    assert blocks.hash32(b"", 5) == 5 and blocks.hash32(b"\xff\xe3\x80") != blocks.hash32(b"\xff\xe3\x81")


def test_log_from_an_offset():
    rng = random.Random(8)
    records = [rng.randbytes(rng.choice([0, 5, 20_000, 32_757, 70_000])) for _ in range(40)]
    raw = wal.frame(records)
    whole, dropped = wal.unframe_at(raw)
    assert [r for _, r in whole] == records and dropped == 0
    for offset in (0, 1, 32_768, 40_000, 100_001, whole[20][0], len(raw)):
        assert wal.unframe_at(raw, offset) == ([x for x in whole if x[0] >= offset], 0)


def test_internal_separators():
    k = keys.internal_key
    a, b = k(b"abcdef", 5, 1), k(b"abzz", 9, 1)
    assert keys.internal_separator(a, b) == k(b"abd", keys.MAX_SEQUENCE, keys.SEEK)
    assert keys.internal_separator(k(b"ab", 5, 1), b) == k(b"ab", 5, 1)
    assert keys.internal_successor(k(b"abc", 5, 1)) == k(b"b", keys.MAX_SEQUENCE, keys.SEEK) and keys.internal_successor(k(b"\xff", 5, 1)) == k(b"\xff", 5, 1)
    assert keys.compare_internal(a, keys.internal_separator(a, b)) < 0 < keys.compare_internal(b, keys.internal_separator(a, b))
    assert keys.compare_internal(k(b"a", 5, 1), k(b"a", 4, 2)) < 0 == keys.compare_internal(a, a)


def test_framing_and_groups_of_frames(spark):
    """Blocks and fragments of a DataFrame's records as those of the bytes themselves."""
    rng = random.Random(6)
    sizes = [rng.choice([0, 3, 37, 32_746, 32_757, 66_000]) for _ in range(120)]
    raw, places = bytearray(), []
    found, _ = wal.unframe_at(wal.frame([bytes(n) for n in sizes]))
    rows = spark.createDataFrame([(i, n, 0) for i, n in enumerate(sizes)], "seq bigint, bytes bigint, log_no bigint")
    got = sorted(wal.framed(rows, "seq", "bytes").collect())
    assert [r.block for r in got] == [at // wal.BLOCK for at, _ in found]
    ends = [at for at, _ in found[1:]]
    assert all(r.fragments >= 1 + (end - 1) // wal.BLOCK - at // wal.BLOCK - 1 for r, (at, _), end in zip(got, found, ends))
    groups = wal.commit_groups(rows, "seq", "bytes").collect()
    total = {}
    for r in sorted(groups):
        total.setdefault(r.commit_no, []).append(r.bytes)
    assert all(sum(g[1:]) <= wal.SMALL_FIRST for g in total.values()) and [n for g in total.values() for n in g] == sizes
    logs = wal.log_numbers(rows.drop("log_no"), "seq", "bytes", 100_000).collect()
    assert all(r.log_no == sum(sizes[:r.seq]) // 100_000 for r in logs)


def test_batch_visitor_and_length_prefix(spark):
    from pyspark.sql import functions as F

    from mvmap.sources.batch import WriteBatch

    batch, copy = WriteBatch().put(b"a", b"1").delete(b"b").put(b"a", b""), WriteBatch()
    batch.iterate(copy)
    assert copy.ops == batch.ops
    raw = keys.length_prefixed(F.lit(bytearray(b"xyz")))
    r = spark.range(1).select(keys.length_value(F.concat(raw, F.lit(bytearray(b"tail")))).alias("v"), keys.length_value(F.lit(bytearray(b"\x05\0\0\0ab"))).alias("short")).first()
    assert (bytes(r.v), r.short) == (b"xyz", None)
