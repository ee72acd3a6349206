"""Connected components by label propagation with pointer jumping. Nothing is gathered on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b): component is the least id that links reach, itself included.

    Each round takes the least label among neighbours and then the label's own label, so long chains
    shrink by half at least. Rows with a null, loops and repeated edges do no harm; no edges, no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    e = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).select(F.col("a").alias("id"), "component"), "labels")
    while True:
        near = e.join(labels, e["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        up = labels.select(F.col("id").alias("to"), F.col("component").alias("up"))
        nxt = written(step.join(up, "to").select("id", F.least("to", "up").alias("component"), (F.least("to", "up") != F.col("was")).alias("moved")), "labels")
        drop_written(labels)
        labels = nxt.select("id", "component")
        if nxt.where("moved").isEmpty():
            drop_written(e)
            return labels
