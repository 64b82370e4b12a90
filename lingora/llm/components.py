"""Connected components of an edge list, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingora.llm.common import durable, looked_up


def _roots(parent: DataFrame) -> DataFrame:
    """(a, up) with up followed to its end; each join doubles the steps that are followed."""
    while True:
        over = parent.select(F.col("a").alias("up"), F.col("up").alias("top"))
        jumped = durable(looked_up(parent, over, "up", "a").select("a", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), small=True)
        parent = jumped.select("a", "up")
        if jumped.where("moved").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the least node that can be reached.

    Each pass points every node to its least neighbour, follows the pointers to local minima, and contracts the edges to
    these, which at least halves the nodes that still have edges. Minima are pre-aggregated and pointers are looked up
    by salted keys, so neither a node of very many edges nor the root of very many nodes is a hot spot.

    Defined results: edges from a node to itself, those with a null end and repeated ones add nothing; other columns are
    ignored; without edges there are no rows.
    """
    one = edges.where("a <> b").select("a", "b")
    flip = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = None
    left = durable(flip(one), small=True)
    while not left.isEmpty():
        root = _roots(left.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")))
        to_a, to_b = root.select("a", F.col("up").alias("x")), root.select(F.col("a").alias("b"), F.col("up").alias("y"))
        contracted = looked_up(looked_up(left, to_a, "a", "b"), to_b, "b", "a").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        if labels is None:
            labels = root.select(F.col("a").alias("node"), F.col("up").alias("label"))
        else:
            step = root.select(F.col("a").alias("label"), F.col("up").alias("next"))
            labels = durable(looked_up(labels, step, "label", "node", "left").select("node", F.coalesce("next", "label").alias("label")), small=True)
        left = durable(contracted, small=True)
    return labels if labels is not None else one.select(F.col("a").alias("node"), F.col("b").alias("label"))
