"""Distributed union-find: stars of each task's edges; what doesn't fit one task goes on in large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm import store as S
from engramlake.operators import graph

#: So many edges are joined at once, in bounded memory; fewer need no rounds.
HELD = 1 << 21


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, root) of every node of ``edges`` (two bigint columns a, b): root is the least node reachable.

    Loops and repeated edges don't matter; null ends are left out. Tasks first replace their edges by stars, a row for each node. If those
    are fewer than HELD, one task joins them, without a plan of joins for each round, all of which the driver would hold. Else each
    round hooks every node's larger neighbours, then its smaller ones, to its least neighbour and is written to the shared folder, so
    a lost executor never costs earlier rounds. Rounds needed grow with the logarithm of the nodes.
    """
    most = HELD
    stars = S.lean(lambda batches: graph.forests(batches, most))
    own = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    parts = S.written(own.mapInArrow(stars, "a bigint, b bigint"), small=True)
    few = parts.count() < most
    edges = S.written(parts.coalesce(1).mapInArrow(stars, "a bigint, b bigint") if few else parts.distinct(), small=True)
    S.dropped(parts)
    if few:
        return _with_roots(edges)
    mark = _mark(edges)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hooked = large.join(small.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = S.written(hooked.union(small.select("a", F.col("m").alias("b"))).distinct(), small=True)
        S.dropped(edges)
        edges, before = new, mark
        mark = _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return _with_roots(edges)


def _with_roots(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())
