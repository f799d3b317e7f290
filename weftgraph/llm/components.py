"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import discard, stage


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of bigint nodes: (node, label), the label being the component's least node.

    A round gives each node the least label among its neighbours and then the label of its label,
    so that chains shorten by a factor a round. Minima are summed map-side, so hubs cost no more
    than other nodes; each round is written to the shared folder, and the loop ends when no label
    changes. Only nodes with a link take part.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label").union(labels)
        least = near.groupBy("node").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = least.join(up, "label").select("node", F.least("label", "above").alias("label"))
        new = stage(jumped)
        old = labels.select("node", F.col("label").alias("was"))
        same = new.join(old, "node").where("label <> was").isEmpty()
        discard(labels)
        if same:
            discard(both)
            return new
        labels = new
