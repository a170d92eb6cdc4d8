"""Operator 6: a short-circuit cascade of quality rules, native expressions only.

A rule is a boolean column that rejects a text. On a sample of about ``sample_rows``
rows, those of the least hashes, every rule is run alone: its time per row, the least
of ``RUNS`` runs after one that is not counted, is its cost, the share it rejects its
selectivity. The cascade is one CASE whose branches stand in descending order
of rejection per cost, so most rejected texts never meet the dear rules. The
sample only chooses the order; the verdict is the same in any order, and the
named reason is that of the first rule that fires.

Null and empty texts have no words and fail ``few_words``. Repeated rows are
judged each, texts whole, whatever their length; of rules that tie, the one given
first stands first. An empty table gives an empty result and keeps the given order.
Other columns pass through as they are, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mvmap.llm import common

#: Fixed values of the word and symbol definitions.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Timed runs of a rule on the sample.
RUNS = 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for a body that names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeat_words(w: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more in the text.
    Windows are compared by 64-bit hash."""

    def windows(h):
        return F.when(
            F.size(h) >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>"))

    def covered(starts):
        gaps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(b - a, F.lit(WINDOW)).cast("bigint"))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def repeated(s):
        twice = F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
        return F.array_sort(F.transform(twice, lambda e: e["i"]))

    def count(g):
        at = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(let(let(at, repeated), covered))

    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(windows(h), count))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint")


#: Fixed thresholds of the rules.
MIN_WORDS, REPEAT_PERCENT = 10, 20
SYMBOL_PERCENT, BANG_PERCENT, DUP_LINE_PERCENT, LONG_WORD = 20, 50, 60, 40


def rules(text: Column) -> dict[str, Column]:
    """Rules over a text column. Ratios are per word, compared in integers."""
    n = lambda: F.size(words(text))
    return {
        "few_words": F.size(F.array_remove(F.split(text, SPACE, MIN_WORDS + 2), "")) < MIN_WORDS,
        "symbols": symbols(text) * 100 > n() * SYMBOL_PERCENT,
        "shouting": F.regexp_count(text, F.lit("!")) * 100 > n() * BANG_PERCENT,
        "duplicate_lines": let(F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)), lambda x: (F.size(x) >= 4) & ((F.size(x) - F.size(F.array_distinct(x))) * 100 > F.size(x) * DUP_LINE_PERCENT)),
        "long_words": F.length(F.regexp_replace(text, SPACE, "")) > n() * LONG_WORD,
        "repeated_words": let(words(text), lambda w: repeat_words(w) * 100 > F.size(w) * REPEAT_PERCENT),
    }


def order_rules(sample: DataFrame, checks: dict[str, Column]) -> list[tuple[str, float, float]]:
    """(name, seconds a row, share rejected), most rejection per cost first."""
    held = sample.persist()
    try:
        n = held.count()
        if not n:
            return [(name, 0.0, 0.0) for name in checks]
        out = []
        for name, fails in checks.items():
            took, hit = [], 0
            for _ in range(1 + RUNS):
                began = time.perf_counter()
                hit = held.agg(F.count_if(fails).alias("n")).first()["n"]
                took.append(time.perf_counter() - began)
            out.append((name, min(took[1:]) / n, hit / n))
    finally:
        held.unpersist()
    return sorted(out, key=lambda r: -(r[2] + 0.5 / n) / r[1])


def verdict(docs: DataFrame, sample_rows: int = 1000) -> tuple[Column, list[tuple[str, float, float]]]:
    """The first rule that rejects ``text`` (null: none does), and the order used."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    checks = rules(text)
    # Twice the share that is wanted, so that the limit is reached; a row's hash draws it.
    share = min(1 << 30, (2 * sample_rows << 30) // max(1, docs.count()))
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) <= share)
    order = order_rules(drawn.select("text").limit(sample_rows), checks)
    reason = F.lit(None).cast("string")
    for name, _, _ in reversed(order):
        reason = F.when(checks[name], F.lit(name)).otherwise(reason)
    return reason, order


def cascade(docs: DataFrame, sample_rows: int = 1000) -> DataFrame:
    """The rows whose text no rule rejects, with their columns as they were."""
    return docs.filter(verdict(docs, sample_rows)[0].isNull())


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text and the base counts."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = rows.withColumn("w", words(F.col("text")))
    return held.select(
        "doc_id",
        "text",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        symbols(F.col("text")).alias("n_symbols"),
        dup_lines(F.col("text")).alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    reason, _ = verdict(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    counts = base_counts(docs).withColumn("base_failed", failed)
    return counts.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(reason.isNull())).drop("text")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, (w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 5)),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
s AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS step FROM t WHERE c > 1),
r AS (SELECT doc_id, sum(step) AS n FROM s GROUP BY doc_id),
b AS (SELECT w.doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 100 > n_words * 20 OR len(regexp_extract_all(text, '!')) * 100 > n_words * 50
            OR (n_lines >= 4 AND n_dup_lines * 100 > n_lines * 60) OR word_chars > n_words * 40) AS kept
FROM f
"""
