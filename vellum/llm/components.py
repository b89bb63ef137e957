"""Connected components of a graph given by edges: hooking, compression and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """``node, label``: the smallest node of its component, for every node that has an edge ``a, b`` to another.

    Every node starts below its smallest neighbour. Then, in turns, parents are replaced by their parents until all
    are roots; edges are contracted to edges between roots; and each root hooks onto its smallest neighbour, if
    that is smaller. A turn leaves at most half of the roots that have edges, and the edges left are few. Each table
    is written: lineage stays short, and both sides of a join are plain exchanges, so that one root with most nodes
    below it is split by AQE.
    """
    plain = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = ws.write(plain, f"{name}-links-0")
    if not links.take(1):
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tree = ws.write(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("parent")), f"{name}-tree-0")
    turn, step, old = 0, 0, [f"{name}-tree-0"]

    def save(df: DataFrame) -> DataFrame:
        nonlocal step
        step += 1
        out = ws.write(df, f"{name}-tree-{step}")
        ws.drop(*old)
        old[:] = [f"{name}-tree-{step}"]
        return out

    while True:
        moved = True
        while moved:
            above = tree.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            tree = save(tree.select("node", "parent").join(above, "parent").select("node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved")))
            moved = bool(tree.where("moved").take(1))
        root = tree.select("node", "parent")
        ends = links.join(root.select(F.col("node").alias("a"), F.col("parent").alias("x")), "a").join(root.select(F.col("node").alias("b"), F.col("parent").alias("y")), "b")
        ends = ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        turn += 1
        links = ws.write(ends, f"{name}-links-{turn}")
        ws.drop(f"{name}-links-{turn - 1}")
        if not links.take(1):
            return root.select("node", F.col("parent").alias("label"))
        hooks = ws.write(links.groupBy(F.col("b").alias("parent")).agg(F.min("a").alias("to")), f"{name}-hooks-{turn}")
        tree = save(root.join(hooks, "parent", "left").select("node", F.coalesce("to", "parent").alias("parent")))
