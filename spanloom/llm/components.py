"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, label): each linked node and the smallest node of its component.

    links: (a, b), both long. Each round takes the smallest label among neighbours, then
    the label's own label; rounds end when no label changes, which a chain of n nodes
    reaches in about log n rounds. Every round is a written table.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.where("a <> b").distinct(), "edges")
    labels = written(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
            "node", F.least("node", "near").alias("label")
        ),
        "labels",
    )
    while True:
        near = (
            edges.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.least("label", "near").alias("low"), "label"
        )
        lower = written(lower, "labels")
        jumped = lower.join(
            lower.select(F.col("node").alias("low"), F.col("low").alias("lowest")), "low"
        ).select("node", F.col("lowest").alias("label"), (F.col("lowest") != F.col("label")).alias("new"))
        jumped = written(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("new").isEmpty():
            return labels
