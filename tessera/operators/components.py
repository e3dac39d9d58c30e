"""Connected components by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.storage import dropped, stored


def hooked(edges: DataFrame) -> DataFrame:
    """node, root: each node hooks to the least of itself and its neighbours, then paths are halved until all nodes
    know their tree's root. Parents are smaller than children, so there are no cycles and a root is its tree's least."""
    both = edges.select("u", "v").union(edges.select("v", "u")).toDF("node", "v")
    tree = stored(both.groupBy("node").agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")), "tree")
    while True:
        up = tree.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stored(tree.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "tree")
        dropped(tree.sparkSession, tree)
        tree = new.select("node", "root")
        if new.where("moved").isEmpty():
            return tree


def components(edges: DataFrame) -> DataFrame:
    """node, component of each node with an edge; a component is named by its least node.

    edges: u, v of one orderable type, self-loops ignored. Each round contracts trees to their roots and keeps the
    edges between roots; at most half of the nodes are roots, and a dense group is one root after a round. Rounds
    are written to the shared folder; the driver sees only whether anything is left.
    """
    ordered = lambda e: e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    now = stored(ordered(edges), "edges")
    levels = []
    while levels == [] or not now.isEmpty():
        tree = hooked(now)
        levels.append(tree)
        side = lambda c: tree.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))  # noqa: B023, E731
        left = stored(ordered(now.join(side("u"), "u").join(side("v"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))), "edges")
        dropped(now.sparkSession, now)
        now = left
    dropped(now.sparkSession, now)
    out = levels[0]
    for tree in levels[1:]:
        out = out.join(tree.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out.toDF("node", "component")
