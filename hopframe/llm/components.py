"""Connected components of a table of edges, by label propagation with pointer jumping in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); the component is its smallest node.

    Each round every node takes the smallest label around it and then the label of that label, so chains shorten
    exponentially. Each round is written to the shared folder; joins are on plain columns, so that the runtime can
    split a node with very many edges.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a != b").distinct(), "cc-edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("b"))
                         .select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "cc-labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")) \
            .agg(F.min("label").alias("around"))
        lowered = labels.join(around, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "around").alias("label"))
        lowered = materialize(lowered, "cc-lowered")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        stepped = materialize(
            lowered.join(jump, "label").select(
                "node", F.least("label", "further").alias("label"),
                (F.least("label", "further") != F.col("old")).alias("moved")), "cc-labels")
        labels = stepped.select("node", "label")
        if not stepped.where("moved").limit(1).count():
            return labels.withColumnRenamed("label", "component")
