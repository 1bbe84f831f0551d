"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch


def components(scratch: Scratch, edges: DataFrame, name: str, rounds: int | None = None) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the component's least node.

    Rounds of least-neighbour labels and pointer jumping, until no label changes.
    Sums over a hub's neighbours are partial before any shuffle, and joins on a hub
    can be split.  Repeated edges and loops do no harm.
    With ``rounds`` it may stop early: nodes of a label are then connected, but a
    component may have several labels.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.write(both, f"{name}-edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}-0")
    turn = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        # the label's own label, from the round before
        step = step.join(labels.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left")
        turn += 1
        new = scratch.write(step.select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old"), f"{name}-{turn}")
        moved = new.where(F.col("label") != F.col("old")).limit(1).count()
        scratch.drop(f"{name}-{turn - 1}")
        labels = new.select("node", "label")
        if not moved or turn == rounds:
            scratch.drop(f"{name}-edges")
            return labels
