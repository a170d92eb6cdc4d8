"""The registered queries on a written table, each against plain Python."""

import collections
import struct
import zlib

import pytest

import corpus_pipeline
from mvmap.llm import common, decontaminate, labelled, licenses, quality_model, registry, toxicity
from mvmap.llm import text as tx
from tests.llm.test_operators import SCHEMA, ids_of, lines_left, rows

ITEM = "which of the seven wizards mixed the potion in the cave of the quick brown fox"
#: Columns that the contracts fix, in their order.
COLUMNS = {
    "op1_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op2_virtual_slots": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op5_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op6_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
    "op8_quality_model": ["doc_id", "held_out", "score", "predicted"],
    "op10_plane_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
}


def table():
    return [*rows(), (500, f"Intro words. {ITEM.upper()}! More words here to end the text with.", "en", "s", 1, 1, "x", 2, "y")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(table(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(7, None, None), (7, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def results(spark, folder):
    return {name: f(spark, folder) for name, f in registry.QUERIES.items()}


def test_columns_and_rows(results):
    for name, columns in COLUMNS.items():
        assert results[name].columns[:len(columns)] == columns, name
        if name != "op1_packing":
            assert collections.Counter(r.doc_id for r in results[name].collect()) == collections.Counter(r[0] for r in table()), name


def test_op1_and_op10(results):
    want = collections.Counter()
    for r in table():
        ids = ids_of(r[1], 0)
        want[r[0], len(ids)] += len(ids)
    got = collections.Counter()
    for r in results["op1_packing"].collect():
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == want
    at = 0
    for r, d in zip(sorted(results["op10_plane_files"].collect(), key=lambda r: r.start), sorted(table(), key=lambda d: -1 if d[0] is None else d[0])):
        ids = ids_of(d[1], 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d[0], at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_op2(results):
    got = results["op2_virtual_slots"].collect()
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter((d[0], len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in table())
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and all(0 <= r.shard < 24 for r in got)
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_op3(results):
    want = lines_left(table())
    for r in results["op3_line_dedup"].collect():
        if not r.n_units:
            text = want[r.doc_id]
            assert (r.text_crc32, r.n_removed) == (None if text is None else zlib.crc32(text.encode()), len(r.removed.split(",")) if r.removed else 0)


def plain_ftrl(data, bits, alpha, l1, beta, epochs, order):
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(s):
        return 0.0 if abs(z[s]) <= l1 else -(z[s] - (l1 if z[s] > 0 else -l1)) / ((beta + n[s] ** 0.5) / alpha)

    for _ in range(epochs):
        for i in order.permutation(len(data)):
            slots, y = data[i]
            w = {s: weight(s) for s in slots}
            g = 1 / (1 + 2.718281828459045 ** -max(-35, min(35, sum(w.values())))) - y
            for s in slots:
                z[s] += g - ((n[s] + g * g) ** 0.5 - n[s] ** 0.5) / alpha * w[s]
                n[s] += g * g
    return {s: w for s in z if (w := weight(s))}


def test_op4_fits_as_plain_ftrl(spark):
    import numpy as np

    texts = [f"{'bad ' if i % 3 == 0 else ''}alpha{i % 7} beta{i % 5} gamma" for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id bigint, toxic int")
    slots, weights = toxicity.fit(docs, labels, l1=1.0, epochs=3)
    mine = [i for i in range(90) if zlib.crc32(str(i).encode()) % 4 != 2]
    data = [([*toxicity.features(texts[i], 20).tolist(), 1 << 20], float(i % 3 == 0)) for i in mine]
    want = plain_ftrl(data, 20, 2.0, 1.0, 1.0, 3, np.random.default_rng(7))
    assert set(slots.tolist()) == set(want) and all(abs(w - want[s]) < 1e-9 for s, w in zip(slots.tolist(), weights))
    words = tx.plain_words("a b c d")
    assert len(toxicity.features("a b c d", 20)) == 4 + 3 + 2 + 1 and len(words) == 4


def test_op8_trains_as_plain_descent():
    import numpy as np

    data = [(np.array([0, 3]), np.array([0.5, 0.5]), 1), (np.array([1, 2, 3]), np.array([0.2, 0.3, 0.5]), 0), (np.array([2]), np.array([1.0]), 1)]
    got, bias = quality_model.train(data, 4, 2, 5, 0.7, 3)
    rng = np.random.default_rng(3)
    v = rng.uniform(-0.5, 0.5, (4, 2)).tolist()
    layer, b, step = [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0], 0
    for _ in range(5):
        for i in rng.permutation(3):
            slots, weights, y = (x.tolist() if hasattr(x, "tolist") else x for x in data[i])
            lr = 0.7 * (1 - step / 15)
            step += 1
            mean = [sum(w * v[s][k] for s, w in zip(slots, weights)) for k in (0, 1)]
            z = [sum(mean[k] * layer[k][c] for k in (0, 1)) + b[c] for c in (0, 1)]
            e = [2.718281828459045 ** x for x in z]
            p = [x / sum(e) - (c == y) for c, x in enumerate(e)]
            back = [sum(layer[k][c] * p[c] for c in (0, 1)) for k in (0, 1)]
            for k in (0, 1):
                for c in (0, 1):
                    layer[k][c] -= lr * mean[k] * p[c]
            b = [b[c] - 0.1 * lr * p[c] for c in (0, 1)]
            norm = sum(w * w for w in weights) ** 0.5
            for s, w in zip(slots, weights):
                v[s] = [v[s][k] - lr * w / norm * back[k] for k in (0, 1)]
    want = [sum(v[s][k] * (layer[k][1] - layer[k][0]) for k in (0, 1)) for s in range(4)]
    assert max(abs(a - c) for a, c in zip(got, want)) < 1e-9 and abs(bias - (b[1] - b[0])) < 1e-9


def test_op4_and_op8_digests(results):
    for name, divisor, held, cut in (("op4_toxicity", 4, 2, 0.3), ("op8_quality_model", 3, 1, 0.5)):
        for r in results[name].collect():
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % divisor == held)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)


def test_labelled_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, "b"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (4, 1)], "doc_id bigint, toxic int")
    got = sorted((r.doc_id, r.text, r.y) for r in labelled.sample(docs, labels, "toxic", 4, 5, 10).collect())
    assert got == [(1, "text 0", 1.0), (2, "b", 0.0), (3, None, 1.0)]


def test_op5(results):
    """Base columns, and method labels where a template's key phrase and words stand."""
    for r in results["op5_license_scan"].collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.n_base == 0) == (r.first_word is None) == (r.last_word is None) == (r.base_labels == "")


def test_op5_lower_cases_ascii_alone(spark):
    docs = spark.createDataFrame([(1, "M\u0130T LICENSE mit licen\u017fe MIT LICENSE \u212aelvin")], "doc_id bigint, text string")
    r = licenses.scan(docs).first()
    assert (r.n_words, [(p.at, p.label) for p in r.places]) == (7, [(4, "mit")])


def test_op9(results, spark):
    """Every document and item by the plain distance of the item to any part of the text."""
    assert [(r.doc_id, r.item_id, r.distance) for r in results["op9_decontamination"].collect()] == [(500, 1, 0)]
    import random

    rng = random.Random(3)
    items = [(i, " ".join(rng.choice(["ab", "cde", "fgh", "i"]) for _ in range(25))) for i in range(6)]
    texts = []
    for i in range(30):
        t = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 7)):
            t[rng.randrange(len(t))] = rng.choice(["", "x", "ab"])
        texts.append((i, "pre " * rng.randint(0, 4) + "".join(t) + " post" * rng.randint(0, 4)))
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {}
    for i, t in texts:
        doc = decontaminate.normalise(t)
        for k, item in items:
            p = decontaminate.normalise(item)
            row = [0] * (len(doc) + 1)
            for a, c in enumerate(p, 1):
                new = [a]
                for j, e in enumerate(doc, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
                row = new
            if min(row) <= int(0.06 * len(p)):
                want[i, k] = min(row)
    assert got == want and len(want) > 10


def test_long_texts_and_other_columns(spark, tmp_path):
    """A text of a megabyte, one word of 200,000 characters, columns named as those inside."""
    d = str(tmp_path / "sf")
    long = "\n".join(" ".join(f"w{(i * 7919 + j) % 5000}" for j in range(40)) for i in range(4000))
    data = [(1, long), (2, "x" * 200_000), (3, None), (4, "plain words of a short text stand here, ten at least")]
    names = "dkey slot unit vslot salt1 s1 s2 n sketch rep comp word w plain keyed cand y held score_ ids start length bucket part row cut".split()
    docs = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars", *[f"{i} AS {c}" for i, c in enumerate(names)])
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    for name, f in registry.QUERIES.items():
        got = {r.doc_id for r in f(spark, d).collect()}
        assert got == (set() if name == "op9_decontamination" else {1, 2, 3, 4}), name
    kept = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.materialise(stage(spark, kept, d), name)
        assert kept.columns == docs.columns, name
    assert {r.doc_id for r in kept.collect()} <= {1, 4}
    assert corpus_pipeline.STAGES[-1][1](spark, kept, d).count() > 0


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    d = str(tmp_path / "sf")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
