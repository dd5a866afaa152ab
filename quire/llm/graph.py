"""Connected components of a link table, labelled by the smallest reachable id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import discard, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node of an edge: the smallest node reachable. Nodes without edges are absent.

    Rounds of neighbour minimum and pointer jumping, each written to the shared folder: stars settle in two rounds,
    a chain of n nodes in about log n. Minima combine before the shuffle, so a node with very many links is no hot key.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = written(pairs.union(pairs.select("other", "node")).distinct(), "links")
    labels = written(both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("l")), "other").groupBy("node").agg(F.min("l").alias("l"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = written(lower.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        discard(labels)
        labels = after.select("node", "label")
        if after.where("old <> label").isEmpty():
            return labels
