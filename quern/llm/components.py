"""Connected components of links that only the cluster can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Workspace


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """``node`` and ``comp`` (the least node reachable) for each node of the edges (u, v).

    Each round hooks every component to its least neighbour, follows these hooks to their
    ends and contracts the edges; at least half of the unfinished components vanish in a
    round. Rounds are written tables; everything is an aggregation or a plain join.
    """
    edges = space.table(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct(), f"{name}-edges")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    labels = space.table(nodes.select("node", F.col("node").alias("comp")), f"{name}-labels")
    step = 0
    old = [f"{name}-edges", f"{name}-labels"]
    while not edges.isEmpty():
        step += 1
        both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("to")), F.struct(F.col("v").alias("c"), F.col("u").alias("to")))).alias("x"))
        hooks = both.select("x.c", "x.to").groupBy("c").agg(F.min("to").alias("to")).select("c", F.least("c", "to").alias("to"))
        hooks, jump = space.table(hooks, f"{name}-hooks-{step}-0"), 0
        while True:
            further = hooks.select(F.col("c").alias("c2"), F.col("to").alias("to2"))
            moved = hooks.join(further, F.col("to") == F.col("c2"))
            if moved.filter("to2 < to").isEmpty():
                break
            jump += 1
            hooks = space.table(moved.select("c", F.col("to2").alias("to")), f"{name}-hooks-{step}-{jump}")
        left = hooks.select(F.col("c").alias("u"), F.col("to").alias("u2"))
        right = hooks.select(F.col("c").alias("v"), F.col("to").alias("v2"))
        contracted = edges.join(left, "u").join(right, "v").filter("u2 <> v2")
        contracted = contracted.select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct()
        renamed = labels.join(hooks, labels.comp == hooks.c, "left").select("node", F.coalesce("to", "comp").alias("comp"))
        edges, labels = space.table(contracted, f"{name}-edges-{step}"), space.table(renamed, f"{name}-labels-{step}")
        space.drop(*old, *(f"{name}-hooks-{step}-{k}" for k in range(jump + 1)))
        old = [f"{name}-edges-{step}", f"{name}-labels-{step}"]
    return labels
