"""Connected components of a graph given as edges, with no group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch


def connected_components(edges: DataFrame, work: Scratch, label: str = "cc") -> DataFrame:
    """(a, b) edges to (node, component): the least node reachable, for nodes with an edge.

    Each round every node takes the least label among its neighbours and itself, and then
    the label of that label; rounds end when nothing changes. Labels are combined before
    they are shuffled, so a node with very many neighbours is one row per task.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = work.save(both.where(F.col("a") != F.col("b")).distinct(), f"{label}_edges")
    labels = both.groupBy("a").agg(F.min("b").alias("_b")).select(F.col("a").alias("node"), F.least("a", "_b").alias("component"))
    labels = work.save(labels, f"{label}_0")
    at = 0
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("_heard"))
        near = labels.join(heard, F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("_old"), F.least("component", "_heard").alias("_new")
        )
        jump = labels.select(F.col("node").alias("_via"), F.col("component").alias("_far"))
        moved = near.join(jump, F.col("_new") == F.col("_via"), "left").select(
            "node", "_old", F.least("_new", F.coalesce("_far", "_new")).alias("component")
        )
        moved = work.save(moved, f"{label}_{at + 1}")
        work.drop(f"{label}_{at}")
        at += 1
        changed = moved.where(F.col("_old") != F.col("component")).limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels
