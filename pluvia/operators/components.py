"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.operators.skew import skewed_lookup
from pluvia.session import Scratch


def _star(edges: DataFrame, size: int, large: bool) -> DataFrame:
    """One contraction round over ``size`` edges: neighbours of a node are hung below the least of them.

    A node of very many neighbours is looked up by broadcast, so that its neighbours stay where they are.
    """
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    joined = skewed_lookup(near, least, "a", "n", 2 * size if large else size)
    moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(
        F.col("b").alias("a"), F.col("m").alias("b")
    ).union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node on an edge ``a``-``b`` of longs.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every round keeps the edge count at most and
    the connectivity as it is, and ends with a star per component. Each round's edges are written to the shared
    folder, so lineage stays short; the driver sees two sums a round.
    """
    now = scratch.write(edges.filter("a <> b").select("a", "b").distinct(), "edges-0")
    mark, size = None, now.count()
    for k in range(1, max_rounds + 1):
        half = scratch.write(_star(now, size, True), f"half-{k}")
        new = scratch.write(_star(half, half.count(), False), f"edges-{k}")
        scratch.drop(f"half-{k}")
        scratch.drop(f"edges-{k - 1}")
        got = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now, size = new, got[0]
        if got == mark:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = got
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
