"""The training-data operators on a small table of awkward rows, against plain Python."""

import collections
import random
import struct
import time
import zlib

import pytest

from mvmap.llm import common, decontaminate, idfile, labelled, licenses, line_dedup, near_dup, packing, quality_model, quality_rules, sharding, tokens, toxicity
from mvmap.llm import text as tx

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot int, score string, n int, start string"


def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [None, "", " ", "one", "one two", "A b\x0bC\td", "x  y\n\n z ", "don't stop, 12 été naïve!", "*** $$$ &&&", "line\nline\nline\nline\nline"]
    base = "\n".join(sentence(14) for _ in range(6))
    texts += [base, base, base.upper(), base + "\n" + sentence(9), base.replace(" ", "  ", 1)]
    words = base.split(" ")
    for i in (3, 9):
        words[i] = "changed"
        texts.append(" ".join(words))
    texts += ["\n".join(sentence(rng.randint(1, 20)) for _ in range(rng.randint(1, 9))) for _ in range(25)]
    texts.append(sentence(6000))
    texts.append("Released under the MIT License. " + sentence(20) + " Licensed under the Apache License, Version 2.0.")
    texts.append("This work is licensed under the GNU General Public License, version 3. mit  License")
    texts.append("Licensed under CC BY-NC 4.0. " + sentence(5))
    out = [(i, t, "en", "s", len(t or ""), 1, "x", 2, "y") for i, t in enumerate(texts)]
    out.append((None, base, None, None, None, None, None, None, None))
    out.append(out[11])
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(got):
    out = collections.defaultdict(list)
    for r in got.collect():
        out[r.doc_id].append(r)
    return out


def ids_of(text, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    return [*tok.encode(text or "", add_special_tokens=False).ids, end]


def test_encoder_equals_library():
    enc = tokens.TextEncoder(tokens.tokenizer_path(), limit=50)
    for text in [r[1] for r in rows()] + ["a   b", " lead", "trail  ", "a \n b", "tab\t x", "we're  I'LL", "ß ǅ 中文 字", "  x", "a <|endoftext|> b"]:
        assert enc.encode(text) == struct.pack(f"<{len(ids_of(text, 0)) - 1}I", *ids_of(text, 0)[:-1])


def test_packing(docs, empty):
    got = packing.pack(docs, block_tokens=3000).collect()
    expect = collections.Counter((r[0], tuple(ids_of(r[1], 0))) for r in rows())
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.sequence_id].append(r)
    for p in pieces.values():
        p.sort(key=lambda r: r.offset)
        assert [r.offset for r in p] == [sum(r.length for r in p[:i]) for i in range(len(p))]
        size = sum(r.length for r in p)
        assert size <= 1024 and size & (size - 1) == 0
    assert sum(r.length for r in got) == sum(len(k[1]) * n for k, n in expect.items())
    for (doc, ids), n in expect.items():
        if sum(1 for k in expect if k[0] == doc) == 1:
            mine = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
            raw = b"".join(bytes(r.ids) for r in mine[::n])
            assert raw == struct.pack(f"<{len(ids)}I", *ids) and {r.doc_tokens for r in mine} == {len(ids)}
    assert packing.pack(empty).count() == 0


def test_place_prefers_lowest_cost_and_descends():
    out = packing.place([600, 500, 400, 300, 248], 1024, 1.0, 1 / 1024)
    assert all(len(p) == 1 for p in out[:4])
    assert sum(n for p in out for _, n, _, _ in p) == 2048


@pytest.mark.parametrize("bits", [False, True])
def test_id_files(spark, docs, empty, tmp_path, bits):
    path = str(tmp_path / "ids")
    idfile.write_ids(docs, path, block_ids=777, chunk_ids=5000, bits=bits)
    got = sorted(idfile.read_ids(spark, path).collect(), key=lambda r: r.start)
    want = sorted(((r[0], r[1] or "") for r in rows()), key=lambda x: -1 if x[0] is None else x[0])
    assert [r.doc_id for r in got] == [w[0] for w in want]
    at = 0
    for r, (_, text) in zip(got, want):
        ids = ids_of(text, 2)
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(ids), struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)
    assert sum(r.n_ids for r in idfile.read_index(spark, path).collect()) == at
    idfile.write_ids(empty, path + "0")
    assert idfile.read_ids(spark, path + "0").count() == 0


def test_sharding(spark, docs, empty, tmp_path):
    path = str(tmp_path / "map")
    got = sharding.shard(docs, n_shards=3, n_slots=64, map_path=path).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows())
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.versions(spark, path) == [1, 2]
    before, after = (sharding.SlotMap.load(spark, path, v) for v in (1, 2))
    assert before.shard_of == {str(s): s % 3 for s in range(64)} and set(before.shard_of) <= set(after.shard_of)
    # Where a record lies follows from it and the map; equal texts of a whole slot lie together.
    assert all(after.locate(r.unit) == r.shard and r.map_version == 2 for r in got)
    assert len({r.shard for r in got if r.text_crc32 == 0 and "/" not in r.unit}) <= 1
    # The same rows again move nothing, and other layouts of the table change nothing.
    again = sharding.shard(docs.repartition(7), n_shards=3, n_slots=64, map_path=path).collect()
    assert sharding.versions(spark, path) == [1, 2, 3] and sharding.SlotMap.load(spark, path, 3).shard_of == after.shard_of
    where = lambda rs: collections.Counter((r.doc_id, r.text_crc32, r.shard) for r in rs if r.unit.count("/") < 3)
    assert where(again) == where(got)
    with pytest.raises(Exception, match="(?i)already.exists"):
        after.save(spark, path)
    with pytest.raises(ValueError):
        sharding.shard(docs, n_shards=4, n_slots=64, map_path=path)
    load = {u: 10 for u in before.shard_of}
    even = sharding.SlotMap.first(64, 4).rebalance(load)
    assert even.version == 2 and max(collections.Counter(even.shard_of.values()).values()) == 16
    assert sharding.shard(empty, n_shards=3, n_slots=64).count() == 0


@pytest.mark.parametrize("hot", ["text", "doc_id", "row"])
def test_sharding_law_with_a_hot_group(spark, hot):
    """A third of all rows share a text, a doc_id, or both: sizes still come out near equal."""
    rng = random.Random(4)
    data = [(i, "w" * rng.randint(20, 200)) for i in range(4000)]
    data += [(9999 if hot != "text" else 5000 + i, "same text of some length" if hot != "doc_id" else f"text {i}") for i in range(2000)]
    got = sharding.shard(spark.createDataFrame(data, "doc_id bigint, text string").repartition(5)).collect()
    size = [0] * 24
    for r in got:
        size[r.shard] += r["size"]
    assert sum(size) == sum(len(t) + 8 for _, t in data) and max(size) - min(size) <= 208
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_toxicity_and_quality(spark, docs, empty):
    rng = random.Random(1)
    data, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        t = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(20))
        data.append((i, t + " " + ("idiot" if bad else "fine")))
        labels.append((i, int(not bad), int(bad)))
    train = spark.createDataFrame(data, "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels, (1, None, None), (5_000, 1, 1)], "doc_id bigint, quality int, toxic int")
    for module, label, divisor, held, cut in ((toxicity, "toxic", 4, 2, 0.3), (quality_model, "quality", 3, 1, 0.5)):
        model = module.fit(train, marks)
        scored = module.score(train, model).withColumn("held", labelled.fold(divisor) == held).collect()
        truth = {i: (q, x)[label == "toxic"] for i, q, x in labels}
        fresh = [r for r in scored if r.held]
        assert len(fresh) > 80 and sum((r.score >= cut) == bool(truth[r.doc_id]) for r in fresh) >= 0.95 * len(fresh)
        assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % divisor == held) for r in scored)
        odd = module.score(docs, model).collect()
        assert len(odd) == len(rows()) and all(0 <= r.score <= 1 for r in odd)
        assert module.score(empty, model).count() == 0
        none = module.fit(empty, marks)
        assert {r.score for r in module.score(docs, none).collect()} == {0.5}


def test_licenses(docs, empty):
    got = by_id(licenses.scan(docs))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    for doc, text, *_ in rows():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        places = sorted((a, l) for p, l in licenses.BASE.items() for k in [p.split()] for a in range(len(w) - len(k) + 1) if w[a:a + len(k)] == k)
        for r in got[doc]:
            assert r.n_words == len(w) and sorted((p["at"], p["label"]) for p in r.places) == places
    found = {d: {f["label"] for r in rs for f in r.found} for d, rs in got.items()}
    n = len(rows()) - 2
    assert (found[n - 3], found[n - 2], found[n - 1]) == ({"mit", "apache-2.0"}, {"gpl-3.0"}, {"cc-by-nc-4.0"})
    assert all(not f for d, f in found.items() if d is None or d < n - 3)
    assert licenses.scan(empty).count() == 0


def test_licenses_do_not_depend_on_other_files(spark):
    """One notice in three of five files, then in all."""
    mit = "Released under the MIT License."
    for texts in ([mit, mit, mit, "some prose", "other prose"], [mit] * 5):
        got = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
        assert [[(f.label, f.share) for f in got[i][0].found] for i in range(5)] == [[("mit", 1.0)] if t == mit else [] for t in texts]


def test_licenses_finds_every_notice(spark):
    """Several notices in one file, amid all template words."""
    short = [t[1] for t in licenses.TEMPLATES]
    noise = " ".join(sorted({w for t in short for w in t.split()}))
    mit, nc = short[1], "licensed under cc by nc 4 0"
    texts = [f"{mit} {nc}", f"{short[9]} {short[2]} {nc}", f"{short[5]} {nc}", f"{noise} {' '.join(short)} {noise}", noise]
    got = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
    found = [{f.label for f in got[i][0].found} for i in range(5)]
    assert found == [{"mit", "cc-by-nc-4.0"}, {"bsd", "apache-2.0", "cc-by-nc-4.0"}, {"gpl", "cc-by-nc-4.0"}, {t[0] for t in licenses.TEMPLATES}, set()]


def test_quality_rules(docs, empty):
    got = by_id(quality_rules.base_counts(docs))
    import re

    for doc, text, *_ in rows():
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = collections.defaultdict(list)
        for i in range(len(w) - 4):
            grams[tuple(w[i:i + 5])].append(i)
        covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        for r in got[doc]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
    kept = quality_rules.cascade(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert {r.doc_id for r in kept.collect()}.isdisjoint({0, 1, 2, 3, 4, 5, 8, 9})
    assert quality_rules.cascade(empty).count() == 0


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, empty, width, percent):
    got = by_id(near_dup.near_duplicates(docs, width=width, percent=percent, k=64, listed=32))
    sets = {}
    for doc, text, *_ in rows():
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    live = [d for d in sets if d is not None and sets[d]]
    for a in live:
        for b in live:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    for d, rs in got.items():
        for r in rs:
            assert r.n_shingles == len(sets[d])
            assert (r.component_id, r.kept) == ((None, True) if d is None else (root(d), root(d) == d))
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_short_texts(spark):
    """Sets of four and five shingles at exactly 80 percent, where no run of three is shared for sure."""
    rng = random.Random(15)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        texts += [" ".join(words), " ".join(words[:8])]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), width=5, percent=80).collect()}
    assert got == {i: i - i % 2 for i in range(80)}


def lines_left(table, percent=80):
    """text of each (doc_id, text) without later matches, by comparing each line with all."""
    seen, want = [], {}
    for doc, text in sorted({(r[0], r[1]) for r in table}, key=lambda r: (r[0] is not None, r[0] or 0)):
        left = []
        for z in (text or "").split("\n"):
            w = set(tx.plain_words(z))
            if w:
                again = any(100 * len(w & v) >= percent * len(w | v) for v in seen)
                seen.append(w)
                if again:
                    continue
            left.append(z)
        want[doc] = None if text is None else "\n".join(left)
    return want


def test_line_dedup(docs, empty):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    want = lines_left(rows())
    for r in out.collect():
        assert r.text == want[r.doc_id], r.doc_id
        assert r.n_chars is None or r.n_chars == len(r.text or "")
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(docs, min_words=4).filter("doc_id = 9").first().text == rows()[9][1]
    with pytest.raises(ValueError):
        line_dedup.removals(docs, percent=60)


@pytest.mark.parametrize("rare,common,bucket,first", [(4096, 1 << 18, 1 << 20, 512), (1, 6, 1 << 20, 512), (1, 1, 40, 512), (4096, 1 << 18, 40, 2), (3, 9, 25, 1)])
def test_line_join_of_frequent_words(monkeypatch, rare, common, bucket, first):
    """Lines of few words and families that change a word at a time, over three blocks:
    keys of one, two and three words, split buckets, lines that meet the first of their
    key first. Each line with a true partner leaves with candidates, or may have more;
    as one of several, and with the second pass that asks for all, no pair is lost."""
    import types

    import numpy as np
    import pyarrow as pa

    ld = line_dedup
    for name, value in (("RARE", rare), ("COMMON", common), ("BUCKET", bucket), ("FIRST", first)):
        monkeypatch.setattr(ld, name, value)
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(14)]
    lines = [" ".join(rng.sample(vocabulary, rng.randint(3, 12))) for _ in range(150)]
    for _ in range(200):
        words = rng.choice(lines).split()
        words[rng.randrange(len(words))] = f"n{rng.randrange(40)}"
        lines.append(" ".join(words))
    rng.shuffle(lines)
    blocks = [pa.RecordBatch.from_pylist(sum((b.to_pylist() for b in ld.ls.pack(ld.ls.build((i, 7, lines[i]) for i in range(k, 350, 3)))), [])) for k in range(3)]
    shared = lambda v: types.SimpleNamespace(value=v)

    def reduced(packed, fn):
        rows = sorted((r for b in packed for r in b.to_pylist()), key=lambda r: (r["bucket"], r["part"], r["other"]))
        return fn([pa.RecordBatch.from_pylist(rows)]) if rows else []

    def counters(packed, size):
        out = np.zeros(size, dtype="<u4")
        for b in reduced(packed, lambda x: ld._summed(x, size)):
            for r in b.to_pylist():
                out[r["part"] * size // 64:(r["part"] + 1) * size // 64] = np.frombuffer(r["counts"], dtype="<u4")
        return out

    rarity = shared(counters([b for x in blocks for b in ld._count_words([x])], 1 << ld.RARITY_BITS))
    cells = counters([b for x in blocks for b in ld._count_cells([x], rarity, 80, 1)], ld.CELLS).astype(np.int64)
    parts = shared(np.append(np.maximum(1, -(-cells // bucket)), 4))
    assert bucket > 40 or parts.value[:-1].max() > 1

    def met(xs=None):
        sent = [b for x in blocks for b in ld._send_entries([x], rarity, 80, parts, 4)]
        return [r for b in reduced(sent, lambda x: ld._meet(x, 80, parts, xs)) for r in b.to_pylist()]

    sets = {}
    for i, z in enumerate(lines):
        s1 = int(ld.ls.block([(0, 0, z)]).lines["s1"].astype(np.int64)[0])
        sets.setdefault(s1, (i, frozenset(z.split())))
    want = {}
    for x, (i, w) in sets.items():
        want[x] = {y for y, (j, v) in sets.items() if j < i and v != w and 100 * len(v & w) >= 80 * len(v | w)}
    got = met()
    found, more = collections.defaultdict(set), set()
    for r in got:
        assert sets[r["y"]][0] < sets[r["x"]][0]
        found[r["x"]].add(r["y"])
        if r["more"]:
            more.add(r["x"])
    assert sum(map(bool, want.values())) > 50
    assert all(want[x] <= found[x] or x in more for x in sets)
    everything = collections.defaultdict(set)
    for r in met(shared(np.full(1 << 10, 0xFFFFFFFFFFFFFFFF, dtype="<u8"))):
        everything[r["x"]].add(r["y"])
    assert all(want[x] <= everything[x] for x in sets)


def _bucket_run(rows):
    """x, y, more of a bucket, and the most MB that looking at it took."""
    import tracemalloc
    import types

    import numpy as np
    import pyarrow as pa

    ld = line_dedup
    parts = types.SimpleNamespace(value=np.append(np.ones(ld.CELLS, dtype=np.int64), 64))
    packed = [ld._send(rows[at:at + 4096], *np.zeros((3, len(rows[at:at + 4096])), dtype=np.int64)) for at in range(0, len(rows), 4096)]
    packed = [pa.Table.from_batches(packed).combine_chunks().to_batches()[0]]
    tracemalloc.start()
    got = list(ld._meet(packed, 80, parts))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got] or [np.empty(0)]) for i in range(3)], most


def test_line_join_holds_a_bucket_in_bounded_memory():
    """As many entries as a bucket is dealt, and lines of near copies, whose pairs
    outnumber the entries by far: two tasks of an executor have room for either."""
    import numpy as np

    ld, rng = line_dedup, np.random.default_rng(5)
    rows = np.zeros(ld.BUCKET, dtype=ld.ENTRY)
    for c, high in (("key", 1 << 32), ("s1", 1 << 63), ("sig0", 1 << 63), ("sig1", 1 << 63), ("sig2", 1 << 63), ("oid", 1 << 40)):
        rows[c] = rng.integers(0, high, len(rows))
    rows["n"] = rng.integers(5, 40, len(rows))
    assert _bucket_run(rows)[1] < 200
    family, keys = 1500, 4
    rows = np.zeros(family * keys, dtype=ld.ENTRY)
    rows["n"], rows["s1"], rows["oid"] = 20, rng.permutation(family * keys), np.arange(family * keys)
    rows["key"] = np.arange(family * keys) // family * 1000
    (x, y, more), most = _bucket_run(rows)
    assert most < 200
    place = {int(s): i for i, s in enumerate(rows["s1"])}
    found, others = collections.defaultdict(set), {}
    for a, b, m in zip(x.tolist(), y.tolist(), more.tolist()):
        found[place[a]].add(place[b])
        others[place[a]] = bool(m)
    for i in range(family * keys):
        earlier = range(i - i % family, i)
        assert found.get(i, set()) == set(earlier[:ld.CLEAR])
        assert others.get(i, False) == (len(earlier) > ld.CLEAR)


def test_first_places_are_dealt_by_their_number(spark):
    """Buckets follow the lines and units that there are, not the number of blocks."""
    text = "\n".join(f"a{i}" for i in range(3000))
    blocks = spark.createDataFrame(sum((b.to_pylist() for b in line_dedup.ls.pack(line_dedup.ls.build([(1, 1, text), (2, 2, None)]))), []), line_dedup.ls.BLOCKS)
    b = line_dedup.ls.block([(1, 1, text), (2, 2, "")])
    assert line_dedup._n_places(blocks) == 3000 + len(b.units)
    assert line_dedup._n_places(blocks.limit(0)) == 0


def test_maps_and_sums_of_the_line_join_take_little_memory():
    """A task's bit map takes its bits, not a byte for each; sums leave a part at a time."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    ld, size = line_dedup, 1 << 27
    keys = np.random.default_rng(6).integers(0, 1 << 63, 50_000).astype(np.uint64)
    batches = [pa.RecordBatch.from_arrays([pa.array(k.view(np.int64))], ["k"]) for k in (keys[:30_000], keys[30_000:], keys[:0], keys[:7])]
    tracemalloc.start()
    bits = np.zeros(size // 64, dtype="<u8")
    for b in ld._mark(batches, size):
        bits[b.column(0).to_numpy()] |= b.column(1).to_numpy().view(np.uint64)
    assert tracemalloc.get_traced_memory()[1] < 64e6
    assert ld._has(bits, keys).all() and int(np.bitwise_count(bits).sum()) == len(np.unique(keys % np.uint64(size)))
    del bits
    total = np.arange(1, 1 + (1 << ld.RARITY_BITS))
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    seen = 0
    for b in ld._sparse(total):
        for part, raw in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
            rows = ld._load(raw, [("slot", "<u4"), ("n", "<u4")])
            assert (rows["n"] == total[rows["slot"]]).all() and (rows["slot"] >> 16 == part).all()
            seen += len(rows)
    assert seen == len(total) and tracemalloc.get_traced_memory()[1] - before < 32e6
    tracemalloc.stop()


def test_line_dedup_of_awkward_tables(spark):
    """Clashing columns, rows that share a doc_id, a very long line."""
    line = "one line of several words that stands here"
    data = [(1, line, "a", 1), (1, f"{line}\nother words in this text", "b", 2), (2, line, "c", 3), (3, "x" * 300_000 + " " + " ".join(f"w{i}" for i in range(70_000)), "d", 4)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, _key string, dkey int").selectExpr("*", "dkey AS _lines", "dkey AS s1", "_key AS row", "dkey AS `cut.text`")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    got = {r.dkey: r for r in out.collect()}
    assert sorted([got[1].text, got[2].text].__str__().count(line) for _ in [0]) == [1] and got[3].text == "" and got[4].text == data[3][1]
    assert all((r._key, r._lines, r.s1, r.row, r["cut.text"]) == (data[k - 1][2], k, k, data[k - 1][2], k) for k, r in got.items())


def test_line_dedup_inside_long_lines(spark):
    """A passage of 85 words inside a line of 680, and one that stood over several lines."""
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage, other = fresh(85), fresh(120)
    texts = [f"{fresh(300)} {passage} {fresh(200)}", "\n".join(" ".join(other.split()[i:i + 15]) for i in range(0, 120, 15))]
    mine = [fresh(400), fresh(195), fresh(90), fresh(70)]
    texts += [f"{mine[0]} {passage}, {mine[1]}", f"{mine[2]}; {other}. {mine[3]}\n{mine[2]} {mine[3]}", "Tior, " * 400]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i] for i in (0, 1)] == texts[:2]
    for i, (run, kept) in ((2, (passage, mine[:2])), (3, (other, mine[2:]))):
        words = tx.plain_words(got[i])
        assert all(words.count(w) >= 1 for w in tx.plain_words(" ".join(kept)))
        assert sum(w in words for w in tx.plain_words(run)) < len(run.split()) / 2
    assert len(got[4].split()) < 100


def test_repeated_short_lines_go(spark):
    """Whatever their number of words; lines without a word stay."""
    lines = ["同じ行がもう一度ここに現れるのでこれは消えるはずです", "see below", "one", "---", ""]
    texts = ["\n".join(lines), "\n".join(["intro", *lines])]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {0: texts[0], 1: "intro\n---\n"}


def test_units_do_not_depend_on_neighbours():
    """A text is cut alike alone and in a block; words as the plain definition has them."""
    rng = random.Random(7)
    texts = ["\n".join(" ".join(rng.choice(["a", "bé", "C3", "long" * 80, "x,y", "ß"]) + str(rng.randrange(50)) for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(1, 4))) for _ in range(30)]
    ls = line_dedup.ls
    whole = ls.block([(i, i, t) for i, t in enumerate(texts)])
    at = 0
    for i, t in enumerate(texts):
        one = ls.block([(i, i, t)])
        n = len(one.units)
        assert whole.docs["units"][i] == n and (whole.units[at:at + n] == one.units).all() and (whole.inside[at:at + n] == one.inside).all()
        at += n
        h, counts, per_doc = ls.word_hashes([t])
        words = [tx.plain_words(z) for z in t.split("\n")]
        assert counts.tolist() == [len(w) for w in words] and per_doc.tolist() == [len(words)]
        flat = [w for z in words for w in z]
        assert len(dict(zip(flat, h.tolist()))) == len(set(h.tolist())) == len(set(zip(flat, h.tolist())))


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    item = "the quick brown fox jumps over the lazy dog while seven wizards mix potions in a dark cave"
    edited = item.replace("brown", "browm").replace("wizards", "wizard")
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "short"), (4, "")], "item_id bigint, text string")
    more = spark.createDataFrame([(900, f"Intro. {item.upper()}! End.", 1), (901, f"pre {edited} post", 1), (902, item[:50] + " and something else entirely different here", 1)], "doc_id bigint, text string, distance int")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(more, items).collect())
    assert got == [(900, 1, 0), (900, 1, 0), (901, 1, 2), (901, 1, 2)]
    assert [r.doc_id for r in decontaminate.clean(more, items).collect()] == [902]
    assert decontaminate.clean(more, items).columns == more.columns
    assert decontaminate.matches(docs, items).count() == 0 and decontaminate.matches(empty, items).count() == 0
    assert decontaminate.clean(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == docs.count()
    for _ in range(100):
        p, t = (bytes(rng.choice(b"abc ") for _ in range(n)) for n in (rng.randint(1, 70), rng.randint(0, 80)))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, e in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        assert decontaminate.Myers(p).best(t)[0] == min(row)


def test_decontamination_finds_short_items(spark):
    """Items under min_bytes match exactly, as whole words."""
    texts = ["Who wrote Hamlet?", "intro: who  WROTE hamlet", "who wrote hamlets", "xwho wrote hamlet", "who wrote hamlet first", "who wrote Hamlot", "hamlets; who wrote hamlets, who wrote hamlet!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "Who wrote Hamlet?"), (8, "?"), (9, None)], "item_id bigint, text string")
    got = sorted(tuple(r) for r in decontaminate.matches(docs, items).collect())
    assert got == [(0, 7, 0, 0, 16), (1, 7, 0, 6, 22), (4, 7, 0, 0, 16), (6, 7, 0, 26, 42)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [2, 3, 5]


def test_shuffles_go_with_the_write(spark):
    from pyspark.sql import functions as F

    from mvmap.llm import common

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()) if f.getName().startswith("shuffle_")}
    option = spark.conf.get(common.CLEANUP, "false")
    before = shuffled()
    held = spark.range(20_000).select((F.col("id") % 999).alias("k")).repartition(3, "k").groupBy("k").count()
    out = common.materialise(held, "cleaned")
    assert not shuffled() - before
    assert out.count() == 999 and held.count() == 999
    assert spark.conf.get(common.CLEANUP, "false") == option


def test_second_pass_leaves_out_lines_of_other_words():
    import types

    import numpy as np
    import pyarrow as pa

    ld = line_dedup
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    text = "\n".join(" ".join(rng.sample(words, rng.randint(1, 12))) for _ in range(400))
    block = ld.ls.block([(1, 1, text)])
    known = set(words[:40])
    hashes = {w: ld.ls.word_hashes([w])[0][0] for w in words}
    bits = np.zeros(1 << 12, dtype="<u8")
    ld._set(bits, np.array([hashes[w] for w in known], dtype=np.uint64))
    got = ld._within(block, bits, 80)
    want = [100 * len(known & set(z.split())) >= 80 * len(set(z.split())) for z in text.split("\n")]
    assert got.tolist() == want and any(want) and not all(want)
    # Of the entries with all keys, those of these lines are sent.
    rarity = types.SimpleNamespace(value=np.full(1 << ld.RARITY_BITS, 2, dtype="<u4"))
    parts = types.SimpleNamespace(value=np.append(np.ones(ld.CELLS, dtype=np.int64), 4))
    keys = types.SimpleNamespace(value=np.full(1 << 12, 2**64 - 1, dtype="<u8"))
    packed = list(ld.ls.pack([block]))
    sent = lambda **more: np.concatenate([ld._load(raw, ld.ENTRY) for b in ld._send_entries(packed, rarity, 80, parts, 4, **more) for _, raw in ld._received([b])])
    every, some = sent(), sent(keys=keys, vocabulary=types.SimpleNamespace(value=bits))
    lines = block.lines["s1"][np.array(want)]
    assert len(some) < len(every)
    assert sorted(some.tolist()) == sorted(every[np.isin(every["s1"], lines)].tolist())


def test_first_places_of_keys_that_come_again():
    import numpy as np

    rng = np.random.default_rng(3)
    rows = np.zeros(3000, dtype=line_dedup.FIRSTS)
    for c, most in (("s1", 700), ("s2", 2), ("oid", 5), ("tie", 2), ("no", 4)):
        rows[c] = rng.integers(0, most, len(rows))
    places = collections.defaultdict(list)
    for r in rows.tolist():
        places[r[:2]].append((r[2], r[4], r[3]))
    got = {r[:2]: ((r[2], r[4], r[3]), bool(r[5])) for r in line_dedup._first(rows).tolist()}
    assert got == {k: (min(v), len(set(v)) > 1) for k, v in places.items()}


def test_words_with_marks_and_line_ends_need_no_whole_encoding(monkeypatch):
    rng = random.Random(8)
    encoder = tokens.TextEncoder(tokens.tokenizer_path(), limit=40)
    plain = encoder.memo.plain
    pieces = ["in.", "\n", "Aterble", "ciónado", "$$$", "*", "Èleou", "|", "a", "_", "(x)", '"', "ǅž", "\n\n", "ª", "×", "'s", "12", "́", "中", "\t", " "]
    word = lambda n: "".join(rng.choice(pieces[:n]) for _ in range(rng.randint(1, 5)))
    for _ in range(300):
        text = " ".join(word(rng.choice((8, len(pieces)))) for _ in range(rng.randint(1, 12)))
        assert encoder.encode(text) == plain(text), text
    easy = "x in.\nAterble thlyes$$$ ANLYHE!! |\nÈleou ciónquecoas., so.\nOr\nno"
    want, calls = plain(easy), []
    monkeypatch.setattr(encoder.memo, "plain", lambda t: calls.append(t) or plain(t))
    assert encoder.encode(easy) == want
    assert calls == ["x"]


def test_a_resting_worker_gives_up_its_memos(monkeypatch):
    """Memos that idle workers kept stood beside the executor's heap in the next stages."""

    def fill(batches):
        for b in batches:
            tx.hasher().array([b"word"])
            tokens.encoder(tokens.tokenizer_path()).encode("some words")
            yield b

    monkeypatch.setattr(common, "IDLE", 60.0)
    assert list(common.task(iter([1, 2]), fill)) == [1, 2]
    assert tx._HASHERS and tokens._ENCODERS
    waiting = common._TIMERS[-1]
    # A task that follows in time finds the memos, and puts the rest off.
    monkeypatch.setattr(common, "IDLE", 0.05)
    assert list(common.task(iter([3]), lambda b: (x if tx._HASHERS else None for x in b))) == [3]
    assert waiting.finished.is_set()
    until = time.monotonic() + 10
    while (tx._HASHERS or tokens._ENCODERS) and time.monotonic() < until:
        time.sleep(0.02)
    assert not tx._HASHERS and not tokens._ENCODERS


@pytest.mark.parametrize("kind", ["<u2", "<u4", "<i4", "<i8"])
def test_planes_of_bytes(kind):
    """Numbers come back from their planes, negative ones and empty arrays too."""
    import numpy as np

    for values in ([], [0], [-(1 << 15), -1, 0, 1, 255, 256, (1 << 15) - 1]):
        v = np.array(values, dtype=np.int64).astype(kind)
        raw = line_dedup.ls.planes(v)
        assert raw == v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()
        back = line_dedup.ls.of_planes(np.frombuffer(raw, dtype=np.uint8), kind)
        assert back.dtype == v.dtype and (back == v).all()


def test_few_blocks_tell_the_entries_of_the_cells():
    assert [line_dedup.sampled(n) for n in (0, 1, 31, 32, 128, 100_000)] == [1, 1, 1, 2, 8, 8]
