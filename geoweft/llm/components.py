"""Connected components of a table of links."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); a component's label is its least node.

    Every round takes the least label among a node and its neighbours, then follows labels to
    their own labels, so paths halve from round to round. Nodes and links stay distributed;
    each round is a stored table."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        # A hot label (that of a large component) is a skewed key of this join, which Spark splits.
        after = stored(lower.join(target, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        if after.filter("was != label").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
