"""Connected components of a link table, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.shared import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (a, b); the label is the least node of the component.

    Every round takes the least label among neighbours and then the label of
    that label, so chains halve; each round's table is written to the shared
    folder. Links and labels never leave the executors.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = last = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        told = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        best = labels.select("node", "label").union(told).groupBy("node").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        jumped = best.join(up, "label").select("node", F.least("label", "higher").alias("label"))
        old = labels.select("node", F.col("label").alias("old"))
        made = materialize(jumped.join(old, "node"), "labels")
        discard(last)
        labels, last = made.select("node", "label"), made
        if made.where(F.col("label") != F.col("old")).isEmpty():
            return labels
