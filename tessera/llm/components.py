"""Connected components of an edge table, by alternating large and small stars.

Each step joins edges with the smallest neighbour of their ends; hubs are only ever on the
many-row side of a join or in a grouped minimum, never gathered.  Each round is written to
the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every neighbour larger than a node to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node.

    Loops and repeated edges are ignored; an empty table gives an empty result.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = stage(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = stage(_small_star(_large_star(now).distinct()).filter("a <> b").distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    members = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
