"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``id``, ``label``): each node with the smallest id of its component. Nodes without an edge don't occur.

    A round takes the least label of a node's neighbours, then the label of that label, so the rounds grow with the
    logarithm of a component's diameter. Labels are written after each round; the driver sees a count only. Neighbours are
    aggregated with partial results, so a node with very many links costs a task one row.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = materialize(pairs.union(pairs.select("y", "x")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("x").alias("id")).agg(F.least(F.first("x"), F.min("y")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("y"), "label"), "y").groupBy(F.col("x").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = lower.join(labels.select(F.col("id").alias("label"), F.col("label").alias("far")), "label").select("id", "old", F.least("label", "far").alias("label"))
        done = materialize(jumped, "labels")
        labels = done.select("id", "label")
        if done.where("label <> old").limit(1).count() == 0:
            return labels
