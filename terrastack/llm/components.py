"""Connected components of an edge table, by hooking and contraction.

Every round replaces edges by edges to smaller neighbours and aggregates with ``min`` (combined before the
shuffle), so a node with very many neighbours stays cheap: its rows are folded on the map side. No node list,
edge list or component reaches the driver, which only compares two counts per round. Rounds are staged in the
shared folder, so a lost executor costs the current round at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastack.llm.staging import staged


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _to_roots(hooks: DataFrame) -> DataFrame:
    """``hooks(a, b)`` with b < a to ``(a, b)`` with b the end of each chain; every step halves the chains."""
    jump = staged(hooks, "hooks")
    while True:
        further = jump.select(F.col("a").alias("b"), F.col("b").alias("further"))
        longer = staged(jump.join(further, "b", "left").select("a", F.coalesce("further", "b").alias("b"), F.col("further").isNotNull().alias("moved")), "hooks")
        jump = longer.select("a", "b")
        if longer.where("moved").isEmpty():
            return jump


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)``, any order and direction, to ``(node, component)``: component is the smallest node reachable.

    Nodes without an edge to another node don't appear. An empty edge table gives an empty result.
    Each round hooks every node that has a smaller neighbour onto its smallest one and contracts the chains;
    only local minima remain, at most half of the nodes, so the rounds grow with the logarithm of the nodes.
    """
    links = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        roots = _to_roots(links.groupBy("a").agg(F.min("b").alias("b")))
        if labels is None:
            nodes = links.select(F.explode(F.array("a", "b")).alias("component")).distinct().select(F.col("component").alias("node"), "component")
        else:
            nodes = labels
        moves = roots.select(F.col("a").alias("component"), F.col("b").alias("target"))
        labels = staged(nodes.join(moves, "component", "left").select("node", F.coalesce("target", "component").alias("component")), "labels")
        to_a, to_b = roots.select("a", F.col("b").alias("na")), roots.select(F.col("a").alias("b"), F.col("b").alias("nb"))
        renamed = links.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("na", "a").alias("x"), F.coalesce("nb", "b").alias("y")).where("x <> y")
        links = staged(renamed.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
        if links.isEmpty():
            return labels
