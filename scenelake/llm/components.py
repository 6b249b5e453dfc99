"""Connected components of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """``node`` and ``label`` (the least node of its component), for all nodes of the edges.

    A round gives each node the least label among its neighbours, then the label
    of that label; the rounds grow with the logarithm of the longest path. Every
    round is a table in the shared folder.
    """
    both = materialize(
        edges.select(F.col(a).alias("v"), F.col(b).alias("u"))
        .union(edges.select(F.col(b).alias("v"), F.col(a).alias("u")))
        .where("v <> u")
        .distinct(),
        f"{name}-edges",
    )
    labels = materialize(both.groupBy(F.col("v").alias("node")).agg(F.min(F.least("v", "u")).alias("label")), f"{name}-0")
    while True:
        of_u = labels.select(F.col("node").alias("u"), F.col("label").alias("new"))
        near = both.join(of_u, "u").select(F.col("v").alias("node"), "new")
        own = labels.select("node", F.col("label").alias("new"))
        least = near.union(own).groupBy("node").agg(F.min("new").alias("label"))
        least = materialize(least, f"{name}-least")
        of_label = least.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        jumped = least.join(of_label, "label").select("node", F.col("jump").alias("label"))
        after = materialize(jumped, f"{name}-next")
        old = labels.select("node", F.col("label").alias("old"))
        changed = not after.join(old, "node").where("label <> old").isEmpty()
        discard(least)
        discard(labels)
        labels = after
        if not changed:
            discard(both)
            return labels
