"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored, temporary


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node that has an edge, and the smallest node it can reach.

    Nodes move to the neighbour of lowest hash and edges follow, until none is left; chains shrink by
    a factor in each round, whatever their numbering. Loops and repeated edges do no harm, edges with
    a null end are left out. Rounds are written out, so a lost executor repeats one round at most.
    """
    with temporary():
        return _components(edges)


def _components(edges: DataFrame) -> DataFrame:
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    moves = []
    while not left.isEmpty():
        low = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("to")))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("to"))
        best = both(left).groupBy("a").agg(low.alias("low")).select("a", F.least("low", own)["to"].alias("to"))
        move = stored(best)
        moves.append(move)
        at = lambda c, move=move: move.select(F.col("a").alias(c), F.col("to").alias(f"{c}_to"))
        moved = left.join(at("a"), "a").join(at("b"), "b")
        low, high = F.least("a_to", "b_to"), F.greatest("a_to", "b_to")
        left = stored(moved.select(low.alias("a"), high.alias("b")).where("a < b").distinct())
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
    found = moves[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for move in moves[1:]:
        on = move.select(F.col("a").alias("root"), F.col("to").alias("next"))
        found = found.join(on, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    found = stored(found)
    smallest = found.groupBy("root").agg(F.min("node").alias("component"))
    return stored(found.join(smallest, "root").select("node", "component"), outlive=True)
