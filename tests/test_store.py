"""The store against a dictionary, and the codecs against their inverses."""

import random

import pytest

from mvmap.functions import keys
from mvmap.plans import leveling
from mvmap.plans.store import Options, SnapshotTooOld, Store, WritesStalled
from mvmap.sources import wal
from mvmap.sources.batch import BadFormat, WriteBatch
from mvmap.sources.manifest import CommitConflict, file_name, parse_file_name
from mvmap.streaming.ingest import ingest


def test_put_get_delete_snapshot_compact(spark, tmp_path):
    path = str(tmp_path / "db")
    s = Store.open(spark, path)
    batch = WriteBatch()
    for i in range(500):
        batch.put(f"key{i}".encode(), f"value{i}".encode())
    s.write(batch)
    assert s.get(b"key77") == b"value77" and s.get(b"nothing") is None
    at = s.snapshot()
    s.write(WriteBatch().delete(b"key1").put(b"key2", b"").delete(b"key3").put(b"key3", b"again"))
    assert (s.get(b"key1"), s.get(b"key2"), s.get(b"key3")) == (None, b"", b"again")
    assert s.get(b"key1", at) == b"value1"
    assert s.view().count() == 499 and s.view(at).count() == 500
    s.compact()
    assert s.get(b"key1", at) == b"value1" and s.get(b"key1") is None
    s.release(at)
    s.compact()
    assert s.log().count() == 499
    with pytest.raises(SnapshotTooOld):
        s.get(b"key1", at)
    assert s.vacuum() == [] and len(s.vacuum(keep_versions=1, pending_seconds=0)) == 3
    again = Store.open(spark, path)
    assert [bytes(r.user_key) for r in again.iterator(b"key10", b"key102").collect()] == [b"key10", b"key100", b"key101"]
    assert bytes(again.iterator(reverse=True).first().user_key) == b"key99"
    assert again.property("num-files-at-level1") == "1"
    assert again.approximate_sizes([(b"a", b"z")])[0] > 0
    assert Store.repair(spark, path).view().count() == 499
    with pytest.raises(FileExistsError):
        Store.open(spark, path, Options(error_if_existing=True))
    assert Store.destroy(spark, path)
    with pytest.raises(FileNotFoundError):
        Store.open(spark, path, Options(create_if_missing=False))


def rows_of(store, **kw):
    return {bytes(r.user_key): bytes(r.value) for r in store.view(**kw).collect()}


def test_levels_against_a_dictionary(spark, tmp_path):
    """Random writes, ranges compacted level by level, snapshots of another handle."""
    rng = random.Random(4)
    path, want, past = str(tmp_path / "db"), {}, {}
    s = Store.open(spark, path, Options(l0_trigger=2))
    other = Store.open(spark, path)
    for step in range(6):
        batch = WriteBatch()
        for _ in range(60):
            k = b"%03d" % rng.randrange(80)
            if rng.random() < 0.3:
                batch.delete(k)
                want.pop(k, None)
            else:
                v = b"%d" % rng.randrange(10**6)
                batch.put(k, v)
                want[k] = v
        s.write(batch)
        if step == 2:
            at = other.snapshot()
            past = dict(want)
        if step in (1, 4):
            s.compact(b"010", b"050")
        if step == 3:
            assert s.maybe_compact() >= 1
        assert rows_of(s) == want
    s.compact()
    assert rows_of(s) == want and rows_of(s, snapshot=at) == past
    assert {f["level"] for f in s.state["files"]} != {0}
    assert [s.get(k) for k in (b"005", b"077", b"999")] == [want.get(k) for k in (b"005", b"077", b"999")]
    got = [bytes(r.user_key) for r in s.iterator(b"020", b"040").collect()]
    assert got == sorted(k for k in want if b"020" <= k < b"040")
    other.close()
    s.compact()
    s.vacuum(keep_versions=1, pending_seconds=0)
    with pytest.raises(SnapshotTooOld):
        s.view(at)
    again = Store.repair(spark, path)
    assert rows_of(again) == want
    with pytest.raises(SnapshotTooOld):
        again.get(b"005", at)


def test_outputs_are_split_and_parts_compacted_alone(spark, tmp_path):
    """Files of about 600 bytes in level 1; a range of them goes on, the others stay as they are."""
    path = str(tmp_path / "db")
    s = Store.open(spark, path, Options(target_file=600))
    value = {b"%04d" % i: b"v%d" % i for i in range(200)}
    batch = WriteBatch()
    for k, v in value.items():
        batch.put(k, v)
    s.write(batch)
    s.put(b"0007", b"again")
    s.compact()
    held = s.state["files"]
    assert len(held) >= 4 and {f["level"] for f in held} == {1} and len({f["file_no"] for f in held}) == len(held)
    spans = sorted((f["smallest_key"], f["largest_key"]) for f in held)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    value[b"0007"] = b"again"
    assert rows_of(s) == value
    s.put(b"0150", b"new")
    value[b"0150"] = b"new"
    s.compact(b"0150", b"0150")
    stayed = {f["folder"] for f in held} & {f["folder"] for f in s.state["files"]}
    assert len(stayed) == len(held) - 1 and rows_of(s) == value
    gone = s.vacuum(keep_versions=1, pending_seconds=0)
    assert any("/part=" in d for d in gone) and rows_of(Store.open(spark, path)) == value
    assert rows_of(Store.repair(spark, path)) == value


def test_repair_leaves_replaced_files_out(spark, tmp_path):
    """A tombstone that compaction dropped does not bring its put back."""
    path = str(tmp_path / "db")
    s = Store.open(spark, path)
    s.put(b"a", b"1")
    s.put(b"b", b"2")
    s.delete(b"a")
    s.compact()
    assert len(s.manifest.folders()) == 4
    again = Store.repair(spark, path)
    assert rows_of(again) == {b"b": b"2"} and again.state["last_sequence"] == 3


def test_damaged_newest_version_is_passed_over(spark, tmp_path):
    path = tmp_path / "db"
    s = Store.open(spark, str(path))
    s.put(b"a", b"1")
    (path / "manifest" / "00000003.json").write_bytes(b"")
    again = Store.open(spark, str(path))
    assert again.get(b"a") == b"1"
    again.put(b"b", b"2")
    assert rows_of(Store.open(spark, str(path))) == {b"a": b"1", b"b": b"2"}


def test_two_writers(spark, tmp_path):
    """The second to commit is refused, its folder goes, and nothing is mixed."""
    path = str(tmp_path / "db")
    a, b = Store.open(spark, path), Store.open(spark, path)
    state = b.state
    a.put(b"k", b"a")
    made = b._add(spark.createDataFrame([(bytearray(b"k"), 1, 1, bytearray(b"b"))], "user_key binary, seq bigint, op int, value binary"), state, 0)
    assert a.vacuum(keep_versions=1) == []  # it may be about to commit
    state["files"] += made
    with pytest.raises(CommitConflict):
        b._commit(state, made)
    assert b.get(b"k") == b"a" and len(a.manifest.folders()) == 1


def test_write_stops_at_a_full_level(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "db"), Options(l0_stop=2))
    s.put(b"a", b"1")
    s.put(b"b", b"2")
    with pytest.raises(WritesStalled):
        s.put(b"c", b"3")
    t = Store.open(spark, str(tmp_path / "db"), Options(l0_stop=2, l0_trigger=2, auto_compact=True))
    t.put(b"c", b"3")
    assert rows_of(t) == {b"a": b"1", b"b": b"2", b"c": b"3"} and t.property("num-files-at-level0") in ("0", "1")


def test_log_recovery_and_groups(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "db"))
    s.put(b"a", b"1")
    batches = [(1, WriteBatch().put(b"a", b"1")), (2, WriteBatch().put(b"b", b"2").delete(b"a")), (4, WriteBatch().put(b"c", b"3"))]
    raw = wal.frame([b.contents(n) for n, b in batches])
    assert s.recover_log(raw + b"\x01" * 5) == 4 and rows_of(s) == {b"b": b"2", b"c": b"3"}
    assert s.recover_log(raw) == 4
    with pytest.raises(BadFormat):
        s.recover_log(wal.frame([WriteBatch().put(b"x", b"").contents(9)]))
    assert s.write_group([WriteBatch().put(b"d", b"4"), WriteBatch().put(b"e", b"5")]) == 6
    assert s.state["version"] == 4  # two batches, one commit
    assert leveling.batch_groups([200_000, 800_000, 100_000, 10, 131_000, 80]) == [[0, 1], [2, 3, 4], [5]]


def test_ingest_replays_nothing(spark, tmp_path):
    """A stream of two files, its checkpoint lost between: no row comes twice."""
    store = Store.open(spark, str(tmp_path / "db"))
    source = str(tmp_path / "in")
    schema = "user_key binary, op int, value binary, at bigint"
    spark.createDataFrame([(bytearray(b"a"), 1, bytearray(b"1"), 5), (bytearray(b"a"), 1, bytearray(b"2"), 7), (bytearray(b"b"), 2, None, None)], schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda at: ingest(spark.readStream.schema(schema).parquet(source), store, "at", str(tmp_path / at)).awaitTermination()
    run("c1")
    assert rows_of(store) == {b"a": b"2"} and store.state["last_sequence"] == 3
    run("c2")  # the same batch number again
    assert store.state["last_sequence"] == 3
    spark.createDataFrame([(bytearray(b"a"), 2, None, 1)], schema).coalesce(1).write.mode("append").parquet(source)
    run("c1")
    assert rows_of(store) == {} and store.state["last_sequence"] == 4 and store.state["epoch"] == 1


def test_compaction_plans():
    """Expansion, grandparents, trivial moves, the level to compact, output cuts."""
    n = iter(range(100))
    f = lambda level, lo, hi, size=1: {"level": level, "smallest_key": lo, "largest_key": hi, "file_size": size, "folder": str(next(n)), "file_no": 0}
    a, b, c = f(0, "10", "20"), f(0, "18", "30"), f(0, "50", "60")
    assert leveling.overlapping([a, b, c], 0, "05", "12") == [a, b]  # through the overlap of a and b
    x, y, z = f(1, "10", "19"), f(1, "20", "29"), f(1, "40", "49")
    below = f(2, "15", "35")
    deep = f(3, "00", "99", 7)
    p = leveling.plan([x, y, z, below, deep], 1, [x])
    assert (p.inputs, p.below, p.grandparents, p.trivial) == ([x, y], [below], [deep], False)
    p = leveling.plan([x, y | {"file_size": 60 << 20}, below], 1, [x])
    assert p.inputs == [x]
    assert leveling.plan([z, deep], 1, [z]).trivial and not leveling.plan([z, deep | {"level": 3, "file_size": 21 << 20}], 1, [z]).trivial
    assert leveling.best_level([a, b, c, x | {"file_size": 9 << 20}]) == (1, 0.9)
    assert leveling.next_seeds([x, y, z], 1, "19") == [y] and leveling.next_seeds([x, y, z], 1, "49") == [x]
    heavy = [f(3, "00", "09", 15 << 20), f(3, "10", "19", 15 << 20), f(3, "20", "29", 15 << 20)]
    assert leveling.grandparent_cuts(heavy) == [(0x19 << 48) + 1]


def test_commit_conflict(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "db"))
    state = s.state
    s.manifest.commit(state)
    with pytest.raises(CommitConflict):
        s.manifest.commit(state)


def test_batch_and_log_round_trip():
    rng = random.Random(3)
    batch = WriteBatch().put(b"", b"").put(b"\x00\x7f\x80\xff", b"x" * 40000).delete(b"k")
    raw = batch.contents(9)
    assert len(raw) == batch.byte_size()
    assert WriteBatch.parse(raw)[0] == 9 and WriteBatch.parse(raw)[1].ops == batch.ops
    with pytest.raises(BadFormat):
        WriteBatch.parse(raw[:-1])
    records = [rng.randbytes(rng.choice([0, 1, 37, 32757, 32756, 32758, 90000])) for _ in range(60)]
    framed = wal.frame(records)
    assert wal.unframe(framed) == (records, 0)
    broken = bytearray(framed)
    broken[20] ^= 1
    assert wal.unframe(bytes(broken))[1] >= 1


def test_keys(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(v,) for v in (-(1 << 63), -5, 0, 7, (1 << 62))], "v bigint")
    assert [r.v for r in rows.orderBy(keys.ordered_long(F.col("v")).desc()).collect()] == [1 << 62, 7, 0, -5, -(1 << 63)]
    for width, v in ((8, 4290304832), (4, 42903048), (2, 65520)):
        r = spark.range(1).select(keys.unfixed_le(keys.fixed_le(F.lit(v), width), width).alias("v"), F.octet_length(keys.fixed_le(F.lit(v), width)).alias("n")).first()
        assert (r.v, r.n) == (v, width)
    tag = F.concat(F.lit(bytearray(b"user")), keys.fixed_le(keys.pack_tag(F.lit(300), F.lit(2)), 8))
    r = spark.range(1).select(keys.parse_internal_key(tag).alias("k"), keys.parse_internal_key(F.lit(bytearray(b"x"))).alias("none")).first()
    assert (bytes(r.k.user_key), r.k.seq, r.k.op, r.none) == (b"user", 300, 2, None)
    assert keys.shortest_separator(b"abcdef", b"abzz") == b"abd" and keys.shortest_separator(b"ab", b"abc") == b"ab"
    assert keys.shortest_successor(b"\xff\x01zz") == b"\xff\x02" and keys.shortest_successor(b"\xff") == b"\xff"
    assert parse_file_name(file_name(7, "table")) == ("table", 7) and parse_file_name("CURRENT") == ("current", None) and parse_file_name("x") is None
