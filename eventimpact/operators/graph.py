"""Connected components of an edge table by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", stars: bool = False) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each round every node moves to the neighbour (or itself) of smallest random priority and the edges follow;
    priorities are drawn anew each round, so the edge table shrinks by a constant factor on average, whatever the
    shape of the graph (a chain of n nodes takes O(log n) rounds). The loop ends when no edge is left. A hot
    node costs one partial minimum per task, and its edges are a skewed join side that AQE splits. With ``stars`` the
    first round prefers the neighbour of most edges, which takes in all of a star's leaves at once.
    """
    a, b = F.col(u), F.col(v)
    e = written(edges.filter(a.isNotNull() & b.isNotNull()).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
                .distinct(), "edges")
    moves, seed = [], 0
    while True:
        loose = e.filter("u <> v")
        if loose.isEmpty():
            break
        near = loose.select("u", "v").unionAll(loose.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), F.col(c).alias("n"))
        if stars and not moves:
            degree = written(near.groupBy("u").agg((-F.count(F.lit(1))).alias("d")), "degrees")
            first = lambda c: F.struct("d", F.xxhash64(c).alias("h"), F.col(c).alias("n"))
            best = near.join(degree.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min(first("v")).alias("m")).join(degree, "u")
            best = best.select(F.col("u").alias("node"), F.least(F.col("m"), first("u"))["n"].alias("to"))
        else:
            best = near.groupBy("u").agg(F.min(rank("v")).alias("m"))
            best = best.select(F.col("u").alias("node"), F.least(F.col("m"), rank("u"))["n"].alias("to"))
        move = written(best, "moves")
        x = loose.join(move.select(F.col("node").alias("u"), F.col("to").alias("u2")), "u")
        x = x.join(move.select(F.col("node").alias("v"), F.col("to").alias("v2")), "v")
        e2 = x.filter("u2 <> v2").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct()
        moves.append((move, e))
        e, seed = written(e2, "edges"), seed + 1
    if not moves:
        return e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    top = moves[-1][0].select("node", F.col("to").alias("root"))
    for move, _ in reversed(moves[:-1]):
        up = top.select(F.col("node").alias("to"), "root")
        top = move.join(up, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    alone = moves[0][1].filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    top = written(top.unionAll(alone.join(top, "node", "left_anti")), "roots")
    least = top.groupBy("root").agg(F.min("node").alias("component"))
    return top.join(least, "root").select("node", "component")
