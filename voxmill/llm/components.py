"""Connected components by hooking, pointer jumping and contraction, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _flat_forest(hooks: DataFrame) -> DataFrame:
    """(v, p) with p < v: point every v at the root of its tree. Each round halves the depth."""
    hooks = written(hooks, "hooks")
    while True:
        up = hooks.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jumped = written(hooks.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "jump")
        moved = not jumped.filter("moved").isEmpty()
        forget(hooks)
        hooks = jumped.select("v", "p")
        if not moved:
            return hooks


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected edges (a, b) of one orderable type to (v, root): each vertex of an edge, and the least vertex that it reaches.

    Every round each vertex with a lesser neighbour hooks to its least one (a map-side combined minimum, so a hub costs no
    more than its partial minima), trees are flattened by pointer jumping, and edges are contracted to roots. At most half of the vertices
    with edges are left after a round. All tables of a round are written to the shared folder. Self-loops and repeated
    edges are fine, edges with a null end are left out; no edges give an empty table.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    e = written(e.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    labels = None
    while True:
        hooks = e.filter("x < y").groupBy(F.col("y").alias("v")).agg(F.min("x").alias("p"))
        if hooks.isEmpty():
            break
        forest = _flat_forest(hooks)
        root = lambda frame, k: frame.join(forest.select(F.col("v").alias(k), F.col("p").alias("__r")), k, "left").withColumn(k, F.coalesce("__r", k)).drop("__r")
        if labels is None:
            new = written(e.select(F.explode(F.array("x", "y")).alias("v")).distinct().withColumn("root", F.col("v")).transform(lambda d: root(d, "root")), "labels")
        else:
            new = written(root(labels, "root"), "labels")
            forget(labels)
        labels = new
        nxt = root(root(e, "x"), "y").filter("x <> y")
        nxt = written(nxt.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
        forget(e)
        forget(forest)
        e = nxt
    if labels is None:
        labels = e.select(F.explode(F.array("x", "y")).alias("v")).distinct().withColumn("root", F.col("v"))
    return labels.select("v", "root")
