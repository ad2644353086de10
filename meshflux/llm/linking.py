"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshflux.llm.common import Lineage


def components(lineage: Lineage, links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the smallest node of its component.

    Each round a node takes the smallest label among its neighbours and itself,
    then the label of that label, so the number of rounds follows the logarithm
    of the diameter. Rounds are written to the shared folder; the loop ends when
    no label changes.
    """
    both = lineage.cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = lineage.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        onward = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = lineage.cut(step.join(onward, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")))
        changed = not moved.where("root < old").isEmpty()
        lineage.drop(labels)
        if not changed:
            lineage.drop(both)
            roots = moved.select("node", "root")
            roots._cut_path = moved._cut_path
            return roots
        labels = moved.drop("old")
        labels._cut_path = moved._cut_path
