"""Operator 4: toxicity by FTRL-proximal logistic regression.

Features are the distinct hashed word unigrams, bigrams and skip-bigrams (one or two
words left out) of a text. The model is fitted on a bounded sample of labelled
rows, document by document, with per-coordinate rates; the L1 term keeps most
weights at exactly zero, so what travels to the executors is a short sparse list
(at most ``2 ** bits`` entries). Every whole text is scored.

Null and empty texts have no features and get the score of the bias alone. With
no labelled row the model is empty and every score is 0.5. Texts are scored whole,
whatever their length. Repeated rows are scored each; a null doc_id is in no fold and
is scored. A labelled document is learned once, by its least text, if its rows differ.
An empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mvmap.llm import common, labelled
from mvmap.llm import text as tx


#: Distances of the words of a skip-bigram.
SKIPS = (2, 3)


def features(text: str | None, bits: int):
    """Distinct feature slots, without the bias."""
    import numpy as np

    h = tx.hasher().array(tx.plain_words(text))
    parts = [tx.grams(h, (0,)), tx.grams(h, (0, 1)), *(tx.grams(h, (0, k)) ^ np.uint64(k * 0x5DEECE66D) for k in SKIPS)]
    return np.unique((np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64))


def _featurise(batches, bits: int):
    import pyarrow as pa

    for batch in batches:
        rows = [features(t.as_py(), bits).astype("<i4").tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(rows, pa.binary())], ["doc_id", "y", "slots"])


class Ftrl:
    """FTRL-proximal logistic regression over binary features; slot ``2 ** bits`` is the bias."""

    def __init__(self, bits: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0):
        import numpy as np

        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, slots):
        import numpy as np

        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, slots, y: float) -> float:
        import numpy as np

        w = self.weights(slots)
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - y
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g
        return p

    def sparse(self):
        import numpy as np

        w = self.weights(np.arange(len(self.z)))
        at = np.flatnonzero(w)
        return at, w[at]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", divisor: int = 4, held: int = 2, bits: int = 20, max_rows: int = 8000, epochs: int = 10, l1: float = 8.0):
    """(slots, weights) of the fitted model, from at most ``max_rows`` rows."""
    import numpy as np

    rows = labelled.sample(docs, labels, label, divisor, held, max_rows)
    rows = common.map_arrow(rows.select("doc_id", "y", "text"), partial(_featurise, bits=bits), "doc_id bigint, y double, slots binary").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    model = Ftrl(bits, l1=l1)
    data = [(np.append(np.frombuffer(s, dtype="<i4").astype(np.int64), 1 << bits), y) for s, y in zip(rows["slots"], rows["y"])]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(data)):
            model.learn(*data[i])
    return model.sparse()


def _score(batches, slots, weights, bits: int):
    import numpy as np
    import pyarrow as pa

    dense = np.zeros((1 << bits) + 1)
    dense[slots] = weights
    bias = dense[1 << bits]
    for batch in batches:
        out = [bias + dense[features(t.as_py(), bits)].sum() for t in batch.column(1)]
        score = 1.0 / (1.0 + np.exp(-np.clip(np.array(out, dtype=float), -35, 35)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, model, bits: int = 20) -> DataFrame:
    """doc_id, score of every row."""
    fn = partial(_score, slots=model[0], weights=model[1], bits=bits)
    return common.map_arrow(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), fn, "doc_id bigint, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(labelled.fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
