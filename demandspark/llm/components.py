"""Connected components by alternating large-star and small-star, on Spark.

Large-star links every larger neighbour of a node to the smallest node of its
neighbourhood, small-star does so with the smaller ones. Rounds repeat until no
edge changes; the edges are then stars around the smallest node.

Edges are rows; nothing is gathered by node. The smallest neighbour of a node is
a partial aggregate, and it meets the node's edges in a sort-merge join between
two written tables, which adaptive execution splits when a node holds a large
part of the edges. Each round's edges are a table in the shared folder, so the
lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandspark.session import stage

MAX_ROUNDS = 60


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest of a node and the v's beside it."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = both.join(_lowest(both), "u").where(F.col("v") > F.col("u"))
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from larger to smaller; the node itself moves to the smallest as well."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = _lowest(down)
    moved = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = lowest.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u != v").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        ).first()
    )


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge.

    Loops and repeated edges add nothing; edges with a null end are left out.
    """
    a, b = F.col(f"`{u}`"), F.col(f"`{v}`")
    now = stage(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seen = _digest(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        now = stage(_small_star(_large_star(now)))
        after = _digest(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centres)
