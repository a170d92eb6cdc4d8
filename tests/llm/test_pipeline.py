"""The whole corpus pipeline against plain Python."""

import collections
import re
import struct

import corpus_pipeline
from mvmap.llm import common, decontaminate
from mvmap.llm import text as tx
from tests.llm.test_operators import SCHEMA, ids_of, rows

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards mix potions in a dark cave"


def passes(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i:i + 5])].append(i)
    covered = {j for a in at.values() if len(a) > 1 for i in a for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    bad = [n < 10, len(re.findall(r"[#*$%&|<>]", text)) * 100 > n * 20, text.count("!") * 100 > n * 50]
    bad += [len(lines) >= 4 and (len(lines) - len(set(lines))) * 100 > len(lines) * 60, sum(map(len, w)) > n * 40, len(covered) * 100 > n * 20]
    return not any(bad)


def without_lines(docs):
    seen, out = [], {}
    for doc, text in sorted(set(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        left = []
        for z in text.split("\n"):
            w = set(tx.plain_words(z))
            hit = len(w) >= 4 and any(100 * len(w & v) >= 80 * len(w | v) for v in seen)
            if len(w) >= 4:
                seen.append(w)
            if not hit:
                left.append(z)
        out[doc, text] = "\n".join(left)
    return [(doc, out[doc, text]) for doc, text in docs]


def representatives(docs):
    sets = {}
    for doc, text in docs:
        w = text.encode().lower().split()
        if doc is not None and w:
            sets[doc] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    comp = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if comp[a] < comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[b], changed = comp[a], True
    return [r for r in docs if comp.get(r[0], r[0]) == r[0]]


def leaks(text):
    """Whether a part of the text is within the item's budget of edits."""
    item, doc = decontaminate.normalise(ITEM), decontaminate.normalise(text)
    column = list(range(len(item) + 1))
    best = column[-1]
    for c in doc:
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(column[i] + 1, new[-1] + 1, column[i - 1] + (p != c)))
        column = new
        best = min(best, column[-1])
    return best <= int(0.06 * len(item))


def test_pipeline(spark, tmp_path):
    filler = [" ".join(f"word{i}x{j}" for j in range(12)) for i in range(3)]
    given = [*rows(), (900, f"{filler[0]}\n{ITEM.upper()}!", *[None] * 7), (901, f"{filler[1]} {ITEM.replace('brown', 'browm')}", *[None] * 7), (902, f"{filler[2]} {ITEM[:40]}", *[None] * 7)]
    sf = str(tmp_path)
    spark.createDataFrame(given, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    want = [(r[0], r[1]) for r in given if passes(r[1])]
    want = [r for r in representatives(without_lines(want)) if not leaks(r[1])]
    assert {900, 901}.isdisjoint(d for d, _ in want) and 902 in [d for d, _ in want]

    pieces = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces[r.doc_id].append(r)
    texts = collections.defaultdict(list)
    for doc, text in want:
        texts[doc].append(ids_of(text, 0))
    assert pieces.keys() == texts.keys()
    for doc, all_ids in texts.items():
        assert sum(r.length for r in pieces[doc]) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            raw = b"".join(bytes(r.ids) for r in sorted(pieces[doc], key=lambda r: r.start))
            assert raw == struct.pack(f"<{len(all_ids[0])}I", *all_ids[0])
    common.purge(spark)
