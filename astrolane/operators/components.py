"""Connected components of an edge table by contraction in hashed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import discard, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of one integer type -> (node, component): the smallest node that a path of edges reaches.

    Every node moves to the neighbour (or itself) with the smallest hash, edges follow their ends, and this repeats
    until none is left; hashed order keeps chains short, so the number of rounds grows as the logarithm of the
    longest path.  Rounds exchange one row per node or edge; minima are combined before the shuffle.  Loops and
    repeated edges are allowed; nodes without edges to others do not come back.
    """
    key = F.xxhash64("node")
    left = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    moves: list[DataFrame] = []
    spent: list[DataFrame] = []
    while left.count():  # read from the footers of the files just written
        both = left.union(left.select("b", "a")).toDF("node", "other")
        best = both.groupBy("node").agg(F.min(F.struct(F.xxhash64("other").alias("h"), F.col("other").alias("to"))).alias("best"))
        own = F.struct(key.alias("h"), F.col("node").alias("to"))
        move = staged(best.select("node", F.least("best", own)["to"].alias("to")), "moves")
        moves.append(move)
        follow = left.join(move.toDF("a", "to_a"), "a").join(move.toDF("b", "to_b"), "b").where("to_a <> to_b")
        after = staged(follow.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        spent.append(left)
        left = after
    spent.append(left)
    if not moves:
        discard(*spent)
        return staged(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0), "components")
    roots = moves[0].select("node", F.col("to").alias("root"))
    for move in moves[1:]:
        step = move.toDF("root", "next")
        roots = roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    roots = staged(roots, "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    out = staged(roots.join(staged(least, "least"), "root").select("node", "component"), "components")
    discard(*spent, *moves, roots)
    return out
