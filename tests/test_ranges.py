"""Ordered operators over several cells against plain Python."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from mvmap.operators import access, files, ranges


@pytest.fixture(autouse=True)
def small_cells(monkeypatch):
    monkeypatch.setattr(ranges, "cuts", lambda rows, key, per_cell=7, f=ranges.cuts: f(rows, key, 7))


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("kind", ["bigint", "binary"])
def test_nearest_and_neighbours(spark, kind):
    rng = random.Random(1)
    code = (lambda v: v) if kind == "bigint" else (lambda v: bytearray(b"prefix" + v.to_bytes(3, "big")))
    keys = sorted(rng.sample(range(1000), 60))
    probes = [rng.randrange(1000) for _ in range(40)] + keys[::9] + [0, 999]
    k, p = table(spark, [(code(v),) for v in keys], f"k {kind}"), table(spark, [(code(v),) for v in probes], f"p {kind}")
    got = {bytes(r.p) if kind == "binary" else r.p: r for r in ranges.nearest(p, k, "p", "k").collect()}
    assert len(got) == len(set(probes))
    plain = lambda v: v if v is None or kind == "bigint" else bytes(v)
    at = lambda i: plain(code(keys[i])) if 0 <= i < len(keys) else None
    for v in probes:
        r, left, right = got[plain(code(v))], bisect.bisect_left(keys, v), bisect.bisect_right(keys, v)
        assert (plain(r.ge), plain(r.lt), plain(r.le)) == (at(left), at(left - 1), at(right - 1))
    links = sorted((plain(r.k), plain(r.prev_key), plain(r.next_key)) for r in access.neighbours(k, "k").collect())
    assert links == [(at(i), at(i - 1), at(i + 1)) for i in range(len(keys))]
    assert ranges.nearest(p, k.limit(0), "p", "k").filter("ge is not null or lt is not null").count() == 0


def test_running_and_next(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), i, rng.randrange(9)) for i in range(120)]
    got = ranges.running(table(spark, rows, "k int, i int, n int"), ["k", "i"], F.col("n"), F.sum, "ahead").collect()
    total, want = 0, {}
    for k, i, n in sorted(rows):
        want[i] = total
        total += n
    assert {r.i: r.ahead or 0 for r in got} == want
    state = [(k, f"v{k}") for k in sorted(rng.sample(range(500), 80))]
    starts = [0, 77, 250, 499, 600]
    got = sorted((r.p, r["rank"], r.k) for r in access.next_n(table(spark, [(p,) for p in starts], "p bigint"), table(spark, state, "k bigint, v string"), "p", "k", 4).collect())
    assert got == [(p, i, k) for p in starts for i, k in enumerate([k for k, _ in state if k >= p][:4], 1)]


def test_intervals(spark):
    rng = random.Random(3)
    make = lambda n: [(i, lo, lo + rng.choice([0, 2, 5, 90]), 10) for i in range(n) for lo in [rng.randrange(300)]]
    a, b = make(50), make(40)
    schema = "file_no bigint, smallest_key bigint, largest_key bigint, file_size bigint"
    x, y = table(spark, a, schema), table(spark, b, schema)
    got = sorted((r.a_file_no, r.b_file_no) for r in files.overlaps(x, y).collect())
    assert got == sorted((i, j) for i, lo, hi, _ in a for j, lo2, hi2, _ in b if lo <= hi2 and lo2 <= hi)
    points = table(spark, [(v,) for v in range(0, 420, 3)], "p bigint")
    inside = sorted(r.p for r in ranges.covered(points, x, "p", "smallest_key", "largest_key").collect())
    assert inside == [v for v in range(0, 420, 3) if any(lo <= v <= hi for _, lo, hi, _ in a)]
    clusters = {r.file_no: r.cluster for r in files.islands(x).collect()}
    seen, number, want = -1, -1, {}
    for i, lo, hi, _ in sorted(a, key=lambda f: (f[1], f[0])):
        number += lo > seen
        seen = max(seen, hi)
        want[i] = number
    assert clusters == want


def test_meeting_in_many_groups(spark, monkeypatch):
    # Two cells hold all: pairs come from groups of starts, so from more tasks than two.
    monkeypatch.setattr(ranges, "MAX_CELLS", 2)
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    was = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        rng = random.Random(5)
        make = lambda n: [(i, lo, lo + rng.choice([-1, 0, 3, 3, 700])) for i in range(n) for lo in [rng.choice([40, rng.randrange(2000)])]]
        a, b = make(150), make(200)
        x, y = table(spark, a, "i bigint, a_lo bigint, a_hi bigint"), table(spark, b, "j bigint, b_lo bigint, b_hi bigint")
        got = ranges.meeting(x, y, "a_lo", "a_hi", "b_lo", "b_hi").select("i", "j", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    sound = lambda rows: [r for r in rows if r[1] <= r[2]]
    assert sorted((r.i, r.j) for r in got) == sorted((i, j) for i, lo, hi in sound(a) for j, lo2, hi2 in sound(b) if lo <= hi2 and lo2 <= hi)
    assert len({r.task for r in got}) > 2


def only_cells_are_joined(found):
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    return joins and all("broadcast" in line for line in joins)


def test_plans_without_pairs(spark):
    rng = random.Random(6)
    make = lambda n, size: [(i, lo, lo + rng.choice([0, 4, 9, 60]), rng.randrange(1, size)) for i in range(n) for lo in [rng.randrange(900)]]
    a, b, c = make(70, 9 << 20), make(40, 9 << 20), make(40, 9 << 20)
    schema = "file_no bigint, smallest_key bigint, largest_key bigint, file_size bigint"
    x, y, z = (table(spark, rows, schema) for rows in (a, b, c))
    meets = lambda lo, hi, rows: [r for r in rows if lo <= r[2] and r[1] <= hi]
    size = lambda rows: sum(r[3] for r in rows)
    widened = lambda lo, hi, rows: (min([lo, *[r[1] for r in rows]]), max([hi, *[r[2] for r in rows]]))
    want = []
    for i, lo, hi, n in a:
        below = meets(lo, hi, b)
        lo, hi = widened(lo, hi, below)
        wider = meets(lo, hi, a)
        grows = below and len(wider) > 1 and len(meets(*widened(lo, hi, wider), b)) == len(below) and size(wider) + size(below) < files.EXPANSION_CAP
        want.append((i, len(wider) if grows else 1, len(below), size(wider) if grows else n, size(below)))
    found = files.compaction_inputs(x, y)
    assert sorted(map(tuple, found.collect())) == want and any(r[1] > 1 for r in want)
    assert only_cells_are_joined(found)
    moves = files.trivial_moves(x, y, z)
    free = [i for i, lo, hi, _ in a if not meets(lo, hi, b) and size(meets(lo, hi, c)) <= files.GRANDPARENT_CAP]
    assert sorted(r.file_no for r in moves.collect()) == free and free
    assert only_cells_are_joined(moves)


def test_files(spark):
    parts = [(i, 20 * i, 20 * i + 14, 100 + i) for i in range(30)]
    f = table(spark, parts, "file_no bigint, smallest_key bigint, largest_key bigint, file_size bigint")
    probes = table(spark, [(v,) for v in range(-5, 640, 7)], "p bigint")
    found = {r.p: r.file_no for r in files.find_file(probes, f, "p").collect()}
    offsets = {r.p: r.bytes_before for r in files.offset_of(probes, f, "p").collect()}
    for v in range(-5, 640, 7):
        assert found[v] == next((i for i, _, hi, _ in parts if hi >= v), None)
        assert offsets[v] == sum(n if hi <= v else 0 if lo > v else n * (v - lo) // (hi - lo + 1) for _, lo, hi, n in parts)


def test_merges(spark):
    schema = "user_key bigint, seq bigint, op int"
    a, b = table(spark, [(1, 3, 1), (2, 1, 1)], schema), table(spark, [(1, 5, 2), (1, 3, 1)], schema)
    got = [(r.user_key, r.seq, r.child) for r in access.merge_sorted([a, b]).collect()]
    assert got == [(1, 5, 1), (1, 3, 0), (1, 3, 1), (2, 1, 0)]
    asked = table(spark, [(k,) for k in range(2000)], "user_key bigint")
    hit = access.may_contain(asked, a, "user_key").count()
    assert 2 <= hit < 100 and access.contains(access.may_contain(asked, a, "user_key"), a, "user_key").count() == 2
