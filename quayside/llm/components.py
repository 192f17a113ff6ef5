"""Connected components of an edge table by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of edges(a, b), the smallest node that it reaches.

    Each round gives a node the smallest label around it, then the label of its label, so long chains
    shorten by half and more. Labels are checkpointed between rounds; only a count of changes reaches the driver.
    Self loops are allowed, null ends are dropped, an empty table gives an empty table.

    A node with very many edges is no single task's: labels are broadcast while they are few, else Spark splits the skewed join,
    and the smallest label of a node's neighbours is taken within tasks first.
    """
    e = edges.select("a", "b").dropna()
    both = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")))
    hint = F.broadcast if few(labels) else (lambda df: df)
    while True:
        near = both.join(hint(labels.select(F.col("node").alias("b"), "component")), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = cut(step.join(hint(up), "component").select("node", "old", F.least("component", "up").alias("component")))
        changed = new.filter("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
