"""Connected components by joins: labels go along links and jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import met, salt, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the component's smallest node.

    Each round is joins and a minimum per node, combined before the shuffle; a node with very many edges, and a label
    with very many nodes, are dealt out by salts, unless a count shows labels few enough to broadcast.  Only whether a label changed comes to the driver.  Rounds end when
    nothing changes.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = stored(both.select(F.col("a").alias("from"), F.col("b").alias("node"), salt("a").alias("salt")), "links")
    labels = both.groupBy(F.col("from").alias("at")).agg(F.min("node").alias("near"))
    labels = stored(labels.select(F.col("at").alias("node"), F.least("at", "near").alias("label")), "labels")
    while True:
        own = labels.select("node", "label", F.col("label").alias("old"))
        seen = met(both, "node", labels).select(F.col("from").alias("node"), "label", F.lit(None).cast(edges.schema["a"].dataType).alias("old"))
        moved = own.unionByName(seen).groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old")).withColumn("salt", salt("node"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("end"))
        moved = met(stored(moved, "moved"), "label", jump, how="left").select("node", "old", F.least("label", F.coalesce("end", "label")).alias("label"))
        moved = stored(moved, "labels")
        labels = moved.select("node", "label")
        if not moved.filter("label <> old").limit(1).count():
            return labels
