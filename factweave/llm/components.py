"""Connected components of an edge table, on DataFrames only.

Every node hooks to its smallest neighbour, the resulting trees are flattened by
pointer doubling, and edges are rewritten between the roots, until none is left.
Hooks only lead to smaller ids, so the root of a component is its smallest member.
Each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the edges (columns a, b).

    Loops, repeated edges and nulls (dropped) are fine; no edges give an empty table.
    """
    left = _plain(edges.select("a", "b"))
    found = None
    while True:
        left = materialize(left, "cc-edges")
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        hooks = _flattened(materialize(hooks, "cc-hooks"))
        up = lambda side: hooks.select(F.col("node").alias(side), F.col("up").alias(f"{side}_up"))
        left = _plain(left.join(up("a"), "a").join(up("b"), "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b")))
        if found is None:
            found = hooks.select("node", F.col("up").alias("component"))
        else:
            step = hooks.select(F.col("node").alias("component"), "up")
            found = materialize(found.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "cc-found")
    return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0) if found is None else found


def _plain(edges: DataFrame) -> DataFrame:
    """Smaller end first, no loops, each edge once."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _flattened(hooks: DataFrame) -> DataFrame:
    """Pointer doubling: ``up`` becomes the root."""
    while True:
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("root"))
        doubled = materialize(hooks.join(above, "up").select("node", F.col("root").alias("up"), (F.col("root") != F.col("up")).alias("moved")), "cc-doubled")
        hooks = doubled.select("node", "up")
        if doubled.where("moved").isEmpty():
            return hooks
