"""Connected components of an edge table, as joins of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mvmap.llm import common


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp: the least node each node reaches. Labels pass along edges and
    then jump to their label's label, so rounds grow with the logarithm of the
    longest chain. Each round is cut into the shared folder. Only counts reach
    the driver; a node of many edges is a skewed join key, which adaptive
    execution splits, as both sides are written tables."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct()
    both = common.materialise(both, "edges")
    label = common.materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("comp")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = both.join(label, both.v == label.node).groupBy("u").agg(F.min("comp").alias("near"))
        met = label.join(near, label.node == near.u, "left").select("node", "comp", F.least("comp", "near").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("comp").alias("jumped"))
        new = met.join(jump, "low", "left").select("node", F.col("comp").alias("old"), F.least("low", "jumped").alias("comp"))
        new = common.materialise(new, "labels")
        changed = new.filter(F.col("old") != F.col("comp")).limit(1).count()
        label = new.select("node", "comp")
        if not changed:
            return label
