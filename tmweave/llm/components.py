"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def components(edges: DataFrame, names: DataFrame) -> DataFrame:
    """edges: a, b (not null). names: v, name for every node of an edge at least; name is a struct that ends in the node itself (field node), so no two are alike.

    Gives v, name for every node of an edge, staged: the smallest name among all nodes that v is linked with. Each round takes the least
    name among a node's neighbours, and then the name that the named node has got itself; names are staged, and rounds end when none changes.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct()
    both = stage(both, "cc-edges")
    labels = stage(both.select("v").distinct().join(names.select("v", "name"), "v"), "cc-labels")
    while True:
        least = both.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("name").alias("m"))
        near = labels.join(least, "v").select("v", F.col("name").alias("old"), F.least("name", "m").alias("name"))
        up = labels.select(F.col("v").alias("node"), F.col("name").alias("up"))
        near = near.withColumn("node", F.col("name.node"))
        new = stage(near.join(up, "node", "left").select("v", "old", F.least("name", F.coalesce("up", "name")).alias("name")), "cc-labels")
        discard(labels)
        labels = new
        if not new.where("name <> old").limit(1).count():
            discard(both)
            out = new.select("v", "name")
            out.staged_path = new.staged_path
            return out
