"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b); component is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the label
    of the label, so chains shrink geometrically. Rounds are written to the
    shared folder. A round shuffles the links once; nothing is collected.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "links", narrow=True)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels", narrow=True)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("component").alias("higher"))
        step = written(step.join(up, "label").select("node", "old", F.least("label", "higher").alias("component")), "labels", narrow=True)
        labels = step.select("node", "component")
        if step.where("old <> component").isEmpty():
            return labels
