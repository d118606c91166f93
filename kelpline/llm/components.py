"""Connected components of a distributed edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


#: A node with more than one in so many edges' ends is a large centre, so there are fewer of them than this; their answers are broadcast.
LARGE = 1000


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One round.  A node's least neighbour is pre-aggregated, then goes to the node's edges: by broadcast to those of large centres, so no
    task gets all edges of one."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    centres = F.broadcast(least.where(F.col("n") > 2 * total / LARGE).select("a", "m"))
    others = least.where(F.col("n") <= 2 * total / LARGE).select("a", "m")
    joined = both.join(centres, "a").unionByName(both.join(centres, "a", "left_anti").join(others, "a"))
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Nodes of at least one edge (``a``, ``b`` longs) -> ``node``, ``root`` (the component's least node).

    The frame's edges are written to the shared folder in every round, so a lost executor costs part of one round.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before, total = None, edges.count()
    while True:
        between = cut(_star(edges, True, total), name)
        new = cut(_star(between, False, total), name)
        state = tuple(new.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
        drop_cut(edges.sparkSession, [edges, between])
        edges, total = new, state[0]
        if state == before:
            break
        before = state
    # a fixed point is a star around each least node
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
