"""Connected components of a large edge list, by hooking and halving labels; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the least node of its component.

    Each round a node takes the least label among its neighbours, and so does the node that its label names; labels are
    replaced by their own labels. Trees of labels thus hook onto others and halve their height, so rounds are few. Beyond the
    first pass over its edges a round handles one row a node.
    """
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = cut(edges.where("a <> b").select(ends.alias("e")).select("e.*").distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        there = label.select(F.col("node").alias("b"), F.col("label").alias("near"))
        near = both.join(there, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        met = cut(label.join(near, "node"))  # one row a node
        hook = met.groupBy("label").agg(F.min("near").alias("hook")).select(F.col("label").alias("node"), "hook")
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = met.join(hook, "node", "left").join(jump, "label", "left")
        step = cut(step.select("node", F.least("label", "near", F.coalesce("hook", "label"), F.coalesce("far", "label")).alias("new"), "label"))
        label = step.select("node", F.col("new").alias("label"))
        if step.where("new <> label").isEmpty():
            return label
