"""Connected components by contraction, with every step in the shared folder and nothing on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, join_unique, staged


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long); label is the least node of its component.

    Each round points a node at its least neighbour, jumps once along these pointers and contracts the edges. Loops
    and repeated edges are ignored; no edges give no rows. A node may have any share of the edges.
    """
    left = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), name)
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")), name)
        far = near.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        step = staged(join_unique(near, far, "to", "left").select("node", F.coalesce("beyond", "to").alias("to")), name)
        if labels is None:
            labels = staged(step.select("node", F.col("to").alias("label")), name)
        else:
            old = labels
            labels = staged(join_unique(old, step.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), name)
            free(old)
        at = lambda c: step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        half = staged(join_unique(left, at("a"), "a"), name)
        new = join_unique(half, at("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).filter("a < b").distinct()
        new = staged(new, name)
        free(left, near, step, half)
        left = new
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("label"))
