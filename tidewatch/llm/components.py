"""Connected components of a large edge table, by alternating star contractions (Kiveris et al. 2014).

Every round is two joins on the smallest neighbour; its edges are written to the shared folder, so lineage stays short
and a lost executor costs at most one round. A node with very many neighbours is no hot group: its smallest neighbour is
a partial aggregate, and the join on it is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest one: those larger than the node (large star), or the rest and the node itself."""
    if large:
        near = edges.select(F.col("u"), F.col("v")).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = near.join(least, "u")
    out = hung.filter(F.col("v") > F.col("u")) if large else hung.filter(F.col("v") != F.col("m"))
    out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge table (u, v) of longs; a component is named by its least node.

    Null ends and loops are dropped; repeated edges don't matter; an empty table gives an empty result.
    """
    now = stored(edges.select("u", "v").dropna().filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or not state[0]:
            break
        mark = tuple(state)
        after = stored(_star(_star(now, True), False), "edges")
        discard(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
