"""Connected components of names of any kind, by labels that spread and jump. Nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): the least name that links reach.

    Each round, a node takes the least label of its neighbours, and every label is replaced by the label's own, so the
    rounds grow with the logarithm of the longest way, not with its length.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a is not null and b is not null").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        low = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("low"))
        own = labels.join(low.withColumnRenamed("a", "node"), "node").select("node", "component", F.least("component", "low").alias("to"))
        up = labels.select(F.col("node").alias("to"), F.col("component").alias("up"))
        nxt = written(own.join(up, "to").select("node", F.least("to", "up").alias("component"), (F.least("to", "up") < F.col("component")).alias("moved")), "labels")
        drop_written(labels)
        labels = nxt.select("node", "component")
        if nxt.where("moved").isEmpty():
            drop_written(both)
            return labels
