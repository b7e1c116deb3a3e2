"""Connected components of a graph given as rows of edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge (a, b); loops and nulls are ignored.

    Each round gives a node the smallest of its neighbours for parent, follows parents one step further,
    and contracts the edges by it, so the rounds grow with the logarithm of a component's width. Minima
    are taken before the shuffle and the joins are ones that Spark may split, so a node that a third of
    the edges share meets in no task of its own. Each round is written out: nothing is kept in executors
    or collected. An empty edge table gives an empty result.
    """
    left = materialize(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        parent = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")), "parents")
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        top = materialize(parent.join(above, "up").select("node", F.col("top").alias("component")), "tops")
        rounds.append(top)
        one, two = top.select(F.col("node").alias("a"), F.col("component").alias("x")), top.select(F.col("node").alias("b"), F.col("component").alias("y"))
        mapped = left.join(one, "a").join(two, "b").where("x <> y")
        left = materialize(mapped.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def follow(below: DataFrame, above: DataFrame) -> DataFrame:
        further = above.select(F.col("node").alias("component"), F.col("component").alias("top"))
        return below.join(further, "component", "left").select("node", F.coalesce("top", "component").alias("component"))

    return reduce(follow, rounds)
