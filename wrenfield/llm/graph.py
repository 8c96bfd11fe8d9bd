"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenfield.session import spooled


def _state(edges: DataFrame) -> tuple:
    """The number of edges and two sums of their hashes: the same edges in any order have the same."""
    own = F.xxhash64("x", "y")
    return tuple(edges.agg(F.count("*"), F.bit_xor(own), F.sum(own.cast("decimal(38,0)"))).first())


def components(edges: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each node's component, for every node of an edge.

    Union-find without a driver: in each round every node that isn't its component's least is hung under the least node
    that it or a neighbour knows, then all edges move to these. Rounds grow as the log of the longest path. Every round is
    a written table in the shared folder, so losing an executor costs one round at most. Only counts and hash sums of a round
    reach the driver; edges that stay the same for a round stay so for ever.
    """
    known = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    known = spooled(known.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    state = _state(known)
    while True:
        # Large star: larger neighbours, to the least of the whole neighbourhood.
        both = known.union(known.select("y", "x"))
        least = both.groupBy(F.col("x").alias("c")).agg(F.min("y").alias("m"))
        least = least.select("c", F.least("c", "m").alias("m"))
        large = both.join(least, F.col("x") == F.col("c")).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        # Small star: smaller neighbours, and the node itself, to the least of them.
        down = large.distinct()
        base = down.groupBy(F.col("x").alias("c")).agg(F.min("y").alias("m"))
        small = down.join(base, F.col("x") == F.col("c")).select("x", "y", "m")
        after = small.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(small.select("x", F.col("m").alias("y"))).where("x <> y").distinct()
        known, before = spooled(after), state
        state = _state(known)
        if state == before:
            break
    up = known.groupBy("x").agg(F.min("y").alias("root"))
    return up.select(F.col("x").alias("node"), "root").union(up.select(F.col("root").alias("node"), "root").distinct())
