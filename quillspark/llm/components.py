"""Connected components by repeated contraction, in DataFrame joins and aggregations.

Every node adopts the smallest id among itself and its neighbours, one pointer jump follows, and the
edges between adopted ids go into the next round. A star ends in one round, and edges shrink in each.
Aggregations combine before they shuffle; joins are on unique keys and keep a hub's rows apart (``join_unique``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, join_unique


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """edges: ``u``, ``v`` of one integer type, undirected; repeats and loops may occur, nulls are no edge.

    Returns ``node``, ``label`` for every node of an edge between two different nodes; the label is the
    smallest id of the node's component. No edges: no rows.
    """
    edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
    edges, maps, k = scratch.save(edges, f"{name}-e0"), [], 0
    while not edges.isEmpty():  # once for each round
        near = edges.union(edges.select("v", "u")).toDF("node", "near")
        near = scratch.save(near.groupBy("node").agg(F.least("node", F.min("near")).alias("to")), f"{name}-n")
        jump = join_unique(near, near.select(F.col("node").alias("to"), F.col("to").alias("far")), "to")
        jump = scratch.save(jump.select("node", F.col("far").alias("to")), f"{name}-m{k}")
        left = jump.toDF("u", "tu")
        right = jump.toDF("v", "tv")
        after = join_unique(join_unique(edges, left, "u"), right, "v")
        after = after.select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v")).where("u < v").distinct()
        edges = scratch.save(after, f"{name}-e{k + 1}")
        scratch.drop(f"{name}-e{k}")
        maps.append(jump)
        k += 1
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels = maps[0].toDF("node", "label")
    for m in maps[1:]:
        labels = join_unique(labels, m.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return scratch.save(labels, f"{name}-labels")
