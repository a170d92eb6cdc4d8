"""Operator 5: licence scans over a positional token index, native expressions only.

Templates are notices of public licences, tokenised once; the index maps each of
their words to (template, position). A file is scanned for the templates of which
a mandatory key phrase stands in it, all of them, whatever the other files hold.
Every occurrence of their words votes for the relative position (file position
minus template position) of each posting. Positions that ``min_votes`` distinct
words agree on are candidates; a candidate counts if one of its template's key
phrases stands in the file where the template lies. ``score`` is the largest share
of a verified template's words found in place.

Beside this, base phrases are found word by word: all their places are counted.

Words are maximal runs of characters other than ASCII non-alphanumerics, A-Z
lower-cased. Null text counts as empty: no words, no labels, score 0. Texts are
scanned whole, whatever their length, one row at a time. Repeated rows are scanned
each; of templates that tie, all count. An empty table gives an empty result; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mvmap.llm import common
from mvmap.llm.quality_rules import let

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The letters that are lower-cased; others, such as the Kelvin sign, stay as they are.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Fixed base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, notice, mandatory key phrases (any of them verifies).
TEMPLATES = [
    ("mit", "released under the mit license", ("the mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("redistribute it and or modify it under the terms",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, UPPER.lower()), SEPARATORS), "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _base_places(w: Column) -> Column:
    """array<struct<at, label>> of every place where a base phrase starts."""
    ends = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.element_at(w, i) == "license")

    def at(i):
        before = lambda k: F.get(w, i - 1 - k)
        return F.when(before(1) == "mit", F.struct((i - 2).cast("bigint").alias("at"), F.lit("mit").alias("label"))).when(
            before(1) == "apache", F.struct((i - 2).cast("bigint").alias("at"), F.lit("apache").alias("label"))
        ).when((before(1) == "public") & (before(2) == "general"), F.struct((i - 3).cast("bigint").alias("at"), F.lit("gpl").alias("label")))

    return F.filter(F.transform(ends, at), lambda x: x.isNotNull())


def _postings() -> Column:
    """Literal map word -> array<struct<tmpl, pos>>."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (_, notice, _) in enumerate(TEMPLATES):
        for p, word in enumerate(notice.split()):
            index.setdefault(word, []).append((t, p))
    cells = []
    for word, places in index.items():
        cells += [F.lit(word), F.array(*[F.struct(F.lit(t).alias("tmpl"), F.lit(p).alias("pos")) for t, p in places])]
    return F.create_map(*cells)


def _keyed(text: Column) -> Column:
    """Numbers of the templates with a key phrase in text, words between single spaces."""
    held = [reduce(Column.__or__, [F.contains(text, F.lit(f" {k} ")) for k in keys]) for _, _, keys in TEMPLATES]
    return F.filter(F.array(*[F.when(h, F.lit(t)) for t, h in enumerate(held)]), lambda t: t.isNotNull())


def _candidates(w: Column, keyed: Column, postings: Column, min_votes: int) -> Column:
    """array<struct<tmpl, off>> of the keyed templates that min_votes distinct words agree on."""
    notices = F.array(*[_strings(sorted(set(t[1].split()))) for t in TEMPLATES])
    vocabulary = F.array_distinct(F.flatten(F.transform(keyed, lambda t: F.element_at(notices, t + 1))))

    def votes(vocabulary):
        hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("word"), i.alias("at"))), lambda e: F.array_contains(vocabulary, e["word"]))
        cast = lambda e: F.filter(F.element_at(postings, e["word"]), lambda p: F.array_contains(keyed, p["tmpl"]))
        return F.array_sort(F.flatten(F.transform(hits, lambda e: F.transform(
            cast(e), lambda p: F.struct(p["tmpl"].alias("tmpl"), (e["at"] - p["pos"]).alias("off"), e["word"].alias("word"))))))

    def once(s):
        return F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1) != e, F.lit(True)))

    def agreed(s):
        # Sorted by (tmpl, off, word), each once: a place's entry number min_votes stands for it.
        same = lambda a, b: F.coalesce((a["tmpl"] == b["tmpl"]) & (a["off"] == b["off"]), F.lit(False))
        full = F.filter(s, lambda e, i: same(F.get(s, i - (min_votes - 1)), e) & ~same(F.get(s, i - min_votes), e))
        return F.transform(full, lambda e: F.struct(e["tmpl"].alias("tmpl"), e["off"].alias("off")))

    return let(let(let(vocabulary, votes), once), agreed)


def _verified(w: Column, candidates: Column) -> Column:
    """array<struct<label, share>> of the candidates whose key phrase is in place."""
    names = _strings([t[0] for t in TEMPLATES])
    notices = F.array(*[_strings(t[1].split()) for t in TEMPLATES])
    keys = F.array(*[_strings([f" {k} " for k in t[2]]) for t in TEMPLATES])

    def judge(c):
        tokens = F.element_at(notices, c["tmpl"] + 1)
        window = F.slice(w, F.greatest(c["off"], F.lit(0)) + 1, F.size(tokens) + F.least(c["off"], F.lit(0)))
        text = F.concat(F.lit(" "), F.array_join(window, " "), F.lit(" "))
        in_place = F.size(F.filter(F.transform(tokens, lambda t, i: F.coalesce(F.get(w, c["off"] + i) == t, F.lit(False))), lambda x: x))
        ok = F.exists(F.element_at(keys, c["tmpl"] + 1), lambda k: F.contains(text, k))
        return F.when(ok, F.struct(F.element_at(names, c["tmpl"] + 1).alias("label"), (in_place / F.size(tokens)).alias("share")))

    return F.filter(F.transform(candidates, judge), lambda x: x.isNotNull())


def scan(docs: DataFrame, min_votes: int = 2) -> DataFrame:
    """doc_id, n_words, places (array of base places), found (array of verified
    templates)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("w", words(F.col("text")))
    rows = rows.withColumn("plain", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    rows = rows.withColumn("keyed", _keyed(F.col("plain")))
    no_places = F.array().cast("array<struct<at:bigint,label:string>>")
    no_found = F.array().cast("array<struct<label:string,share:double>>")
    w = F.col("w")
    rows = rows.withColumn("places", F.when(F.array_contains(w, "license"), _base_places(w)).otherwise(no_places))
    rows = rows.withColumn("cand", F.when(F.size("keyed") > 0, _candidates(w, F.col("keyed"), _postings(), min_votes)))
    rows = rows.withColumn("found", F.when(F.size("cand") > 0, _verified(w, F.col("cand"))).otherwise(no_found))
    return rows.select("doc_id", F.size("w").cast("bigint").alias("n_words"), "places", "found")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(common.documents(spark, sf_dir))
    starts = F.transform("places", lambda p: p["at"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    both = F.array_union(base, F.transform("found", lambda f: f["label"]))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)).alias("score"),
    )
