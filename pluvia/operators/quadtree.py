"""Nearest points by an adaptive quadtree: crowded cells are split again and again, empty ones never exist.

Points stand in square cells; a cell with more than ``CROWD`` of them is split into ``SPLIT`` by ``SPLIT`` smaller ones,
so leaves are small wherever the points are. Each node keeps the box of its points. A search goes down level by level for
all seekers at once: a box promises a point no farther than its far corner, and nodes whose near corner is beyond the best
promise are given up. What is opened in the end is a few leaves a seeker, whatever stands in one cell.

Nodes, lists of children and leaves are one row a node with a bounded list, and are looked up with hot nodes broadcast,
so a cell that holds most seekers or most points isn't one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.operators.skew import skewed_left, skewed_lookup
from pluvia.session import Scratch

CROWD, SPLIT, DEEPEST = 64, 8, 16
NEAR = 1 + 1e-9  # boxes are kept a little beyond the bound, so that rounding loses none


def _cell(side: float) -> list[Column]:
    return [F.floor(F.col("lat") / side).cast("long").alias("y"), F.floor(F.col("lon") / side).cast("long").alias("x")]


class Quadtree:
    """``roots`` (y, x and box of the cells of ``side``), ``children`` (a list for each split node) and ``leaves`` (a list of points)."""

    def __init__(self, points: DataFrame, side: float, scratch: Scratch):
        self.side, self.levels = side, 0
        box = [f(c).alias(f"{f.__name__}_{c}") for c in ("lat", "lon") for f in (F.min, F.max)]
        left, total, nodes, leaves = points, points.count(), [], []
        while total and self.levels < DEEPEST:
            level, width = self.levels, side / SPLIT**self.levels
            placed = left.select("key", "lat", "lon", *_cell(width))
            cells = scratch.write(placed.groupBy("y", "x").agg(F.count("*").alias("n"), *box).withColumn("level", F.lit(level)), f"cells-{level}")
            sums = cells.agg(F.max("n").alias("most"), F.sum(F.when(F.col("n") > CROWD, F.col("n"))).alias("crowded")).first()
            nodes.append(cells)
            counted = skewed_left(placed, cells.select("y", "x", "n"), ["y", "x"], "n", total)
            if sums.crowded:
                counted = scratch.write(counted, f"points-{level}")
            leaves.append(counted.filter((F.col("n") <= CROWD) | F.lit(level == DEEPEST - 1)).withColumn("level", F.lit(level)))
            left, total = counted.filter(F.col("n") > CROWD).select("key", "lat", "lon"), sums.crowded or 0
            self.levels += 1
        self.depth = self.levels
        if not nodes:
            return
        split = (F.col("n") > CROWD) & (F.col("level") < DEEPEST - 1)
        every = reduce(DataFrame.unionByName, nodes).withColumn("split", split)
        self.roots = every.filter("level = 0").drop("n")
        parent = [(F.col("level") - 1).alias("level"), *[F.floor(F.col(c) / SPLIT).cast("long").alias(c) for c in "yx"]]
        child = F.struct("level", "y", "x", "min_lat", "max_lat", "min_lon", "max_lon", "split").alias("node")
        self.children = scratch.write(every.filter("level > 0").select(*parent, child).groupBy("level", "y", "x").agg(F.collect_list("node").alias("nodes")), "children")
        point = F.struct("lat", "lon", "key")
        self.leaves = scratch.write(reduce(DataFrame.unionByName, leaves).groupBy("level", "y", "x").agg(F.collect_list(point).alias("points")), "leaves")


NODE = ["level", "y", "x"]


def _looked_up(asking: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``asking`` joined to the one row of ``table`` each; keys that many ask for are broadcast."""
    sizes = asking.groupBy(*keys).agg(F.count("*").alias("_asked"))
    total = asking.count()
    return skewed_lookup(asking, table.join(sizes, keys), keys, "_asked", total).drop("_asked")


def _reach(least: bool) -> Column:
    """Distance of the seeker (lat, lon) from the near or the far side of a box."""

    def along(c: str) -> Column:
        below, above = F.col(f"min_{c}") - F.col(c), F.col(c) - F.col(f"max_{c}")
        return F.greatest(below, above, F.lit(0.0)) if least else F.greatest(F.abs(below), F.abs(above))

    return F.sqrt(along("lat") * along("lat") + along("lon") * along("lon"))


def _seen(found: DataFrame) -> DataFrame:
    return found.select("lat", "lon", *NODE, "split", _reach(True).alias("near"), _reach(False).alias("far"))


def _kept(found: DataFrame, band: float) -> DataFrame:
    """Of each seeker's nodes those that can hold a point nearer than its best promise and than ``band``."""
    parts = [*NODE, "split", "near", "far"]
    listed = found.groupBy("lat", "lon").agg(F.collect_list(F.struct(*parts)).alias("nodes"))
    bound = F.least(F.array_min(F.transform("nodes", lambda n: n.far)), F.lit(band)) * NEAR
    some = listed.withColumn("_bound", bound).withColumn("n", F.explode("nodes")).filter(F.col("n.near") <= F.col("_bound"))
    return some.select("lat", "lon", *[F.col(f"n.{c}").alias(c) for c in parts])


def nearest_within(left: DataFrame, right: DataFrame, band: float) -> DataFrame:
    """a_key, b_key and distance of the nearest right point nearer than ``band``; ties by lat, lon, key.

    Both sides have (key, lat, lon). Rows without a place match nothing; points of one place count once, seekers of one
    place seek once.
    """
    spark = left.sparkSession
    scratch = Scratch(spark, "quadtree")
    somewhere = "lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)"
    points = scratch.write(right.filter(somewhere).groupBy("lat", "lon").agg(F.min("key").alias("key")), "points")
    asked = left.filter(somewhere).select(F.col("key").alias("a_key"), "lat", "lon")
    seekers = scratch.write(asked.groupBy("lat", "lon").agg(F.count("*").alias("asks")), "seekers")
    tree = Quadtree(points, band, scratch)
    if not tree.depth:
        return asked.limit(0).select("a_key", F.lit(None).cast(right.schema["key"].dataType).alias("b_key"), F.lit(None).cast("double").alias("distance"))
    around = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    start = seekers.select("lat", "lon", *_cell(band), around.alias("d")).select("lat", "lon", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    at = scratch.write(_kept(_seen(_looked_up(start, tree.roots, ["y", "x"])), band), "at-0")
    for level in range(1, tree.depth):
        inner = _looked_up(at.filter("split").select("lat", "lon", *NODE), tree.children, NODE)
        below = inner.select("lat", "lon", F.explode("nodes").alias("n")).select("lat", "lon", "n.*")
        # leaves found above come along as boxes of which the corners' distances are known
        at = scratch.write(_kept(_seen(below).unionByName(at.filter("NOT split")), band), f"at-{level}")
    opened = _looked_up(at.select("lat", "lon", *NODE), tree.leaves, NODE)

    def measured(p: Column) -> Column:
        apart = F.sqrt((F.col("lat") - p.lat) * (F.col("lat") - p.lat) + (F.col("lon") - p.lon) * (F.col("lon") - p.lon))
        return F.struct(apart.alias("distance"), p.lat.alias("b_lat"), p.lon.alias("b_lon"), p.key.alias("b_key"))

    best = opened.select("lat", "lon", F.array_min(F.transform("points", measured)).alias("best")).groupBy("lat", "lon").agg(F.min("best").alias("best"))
    found = scratch.write(best.filter(F.col("best.distance") < band).join(seekers, ["lat", "lon"]), "found")
    answers = skewed_lookup(asked, found, ["lat", "lon"], "asks", seekers.agg(F.sum("asks")).first()[0] or 0)
    return answers.select("a_key", F.col("best.b_key").alias("b_key"), F.col("best.distance").alias("distance"))

