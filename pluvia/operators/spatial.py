"""Grids, nearest points and interpolation between points, in degrees."""

from __future__ import annotations

import math
import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvia.operators.blocks import Block, Points, over_blocks
from pluvia.operators.quadtree import nearest_within
from pluvia.session import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def grid(spark: SparkSession, lat: tuple[float, float] = (32, 42), lon: tuple[float, float] = (110, 123), step: float = 0.5) -> DataFrame:
    """Points of a regular grid, ends included, numbered latitude first. Coordinates are index times step, never sums."""
    rows, columns = (round((high - low) / step) + 1 for low, high in (lat, lon))
    return spark.range(rows * columns).select(
        F.col("id").alias("seq"),
        (F.lit(float(lat[0])) + F.floor(F.col("id") / columns) * step).alias("latitude"),
        (F.lit(float(lon[0])) + (F.col("id") % columns) * step).alias("longitude"),
    )


def distance(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    return F.sqrt((lat_a - lat_b) * (lat_a - lat_b) + (lon_a - lon_b) * (lon_a - lon_b))


def in_box(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float], lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """Rows inside a closed box."""
    return df.filter(F.col(lat_col).between(*lat) & F.col(lon_col).between(*lon))


def band_join(left: DataFrame, right: DataFrame, band: float) -> DataFrame:
    """Pairs of points at most ``band`` degrees apart on both axes; both have (key, lat, lon).

    An equi-join on square cells of that width: a left point looks into its own and the eight neighbouring cells, so
    the plan has no nested loop and each right point is shuffled once.
    """
    cell = lambda c: F.floor(F.col(c) / band).cast("long")
    near = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    a = left.select(F.col("key").alias("a_key"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), cell("lat").alias("y"), cell("lon").alias("x"))
    a = a.withColumn("dy", near).withColumn("dx", near).withColumn("y", F.col("y") + F.col("dy")).withColumn("x", F.col("x") + F.col("dx")).drop("dy", "dx")
    b = right.select(F.col("key").alias("b_key"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), cell("lat").alias("y"), cell("lon").alias("x"))
    close = (F.abs(F.col("a_lat") - F.col("b_lat")) <= band) & (F.abs(F.col("a_lon") - F.col("b_lon")) <= band)
    return a.join(b, ["y", "x"]).drop("y", "x").filter(close).withColumn("distance", distance(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))


def _nearest(pairs: DataFrame) -> DataFrame:
    best = F.min(F.struct("distance", "b_lat", "b_lon", "b_key")).alias("best")
    return pairs.groupBy("a_key").agg(best).select("a_key", F.col("best.b_key").alias("b_key"), F.col("best.distance").alias("distance"))


def nearest_in_band(left: DataFrame, right: DataFrame, band: float) -> DataFrame:
    """a_key, b_key and distance of the nearest right point in the band and nearer than ``band``; ties by lat, lon, key.

    However many points crowd a cell on either side, no cell's pairs are all compared.
    """
    return nearest_within(left, right, band)


CROWD, FINE = 64, 16


def _by_cells(left: DataFrame, right: DataFrame, band: float) -> DataFrame:
    """Nearest right point of each left point that has one within ``band``, by way of occupied cells.

    Right points are summed up to the boxes of the cells they stand in, ``FINE`` to a band. Of the boxes near a left point
    only those that can hold its nearest point are opened.
    """
    step = band / FINE
    row, column = F.floor(F.col("lat") / step).cast("long"), F.floor(F.col("lon") / step).cast("long")
    placed = right.withColumn("row", row).withColumn("column", column)
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("lat", "lon") for f in (F.min, F.max)]
    boxes = placed.groupBy("row", "column").agg(*ends).withColumn("key", F.struct("row", "column"))
    middle = boxes.select(F.struct("key", "min_lat", "max_lat", "min_lon", "max_lon").alias("key"), ((F.col("row") + 0.5) * step).alias("lat"), ((F.col("column") + 0.5) * step).alias("lon"))
    near = band_join(left, middle, band + step).drop("distance").withColumn("box", F.col("b_key"))

    def reach(c: str, at: str, least: bool) -> Column:
        below, above = F.col(f"box.min_{c}") - F.col(at), F.col(at) - F.col(f"box.max_{c}")
        return F.greatest(below, above, F.lit(0.0)) if least else F.greatest(F.abs(below), F.abs(above))

    far = lambda least: F.hypot(reach("lat", "a_lat", least), reach("lon", "a_lon", least))
    near = near.select("a_key", "a_lat", "a_lon", far(True).alias("from"), far(False).alias("to"), "box.key")
    some = near.groupBy("a_key", "a_lat", "a_lon").agg(F.min("to").alias("bound"), F.collect_list(F.struct("from", "key")).alias("cells"))  # (2 FINE + 3) ** 2 at most
    opened = some.select("a_key", "a_lat", "a_lon", F.explode(F.filter("cells", lambda c: c["from"] <= F.col("bound") * (1 + 1e-9))).alias("c"))
    opened = opened.select("a_key", "a_lat", "a_lon", F.col("c.key.row").alias("row"), F.col("c.key.column").alias("column"))
    pairs = opened.join(placed.select("row", "column", F.col("key").alias("b_key"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")), ["row", "column"])
    return _nearest(pairs.withColumn("distance", distance(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))))


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """a_key, b_key and distance of the nearest of all right points; ties by lat, lon, key.

    Right points of one place count once. The band begins where no cell holds more than ``CROWD`` right points and grows
    eightfold for the points that found nothing within it; these look at occupied cells first, so that no round
    compares all pairs. The rounds are a logarithm of the extent, and what a round leaves is written.
    """
    spark = left.sparkSession
    scratch = Scratch(spark, "nearest")
    right = scratch.write(right.filter("lat IS NOT NULL AND lon IS NOT NULL").groupBy("lat", "lon").agg(F.min("key").alias("key")).select("key", "lat", "lon"), "right")
    rest = scratch.write(left.filter("lat IS NOT NULL AND lon IS NOT NULL").select("key", "lat", "lon"), "rest-0")
    ends = [f(c) for c in ("lat", "lon") for f in (F.min, F.max)]
    box, reach = right.agg(F.count("*"), *ends).first(), rest.agg(*ends).first()
    if not box[0] or reach[0] is None:
        return spark.createDataFrame([], "a_key long, b_key long, distance double")
    extent = max(max(reach[1], box[2]) - min(reach[0], box[1]), max(reach[3], box[4]) - min(reach[2], box[3]), 1e-9)
    area = max((box[2] - box[1]) * (box[4] - box[3]), 1e-18)
    band = min(extent, max(2 * math.sqrt(area / box[0]), extent * 1e-6))
    while band > extent * 1e-6:
        cells = right.groupBy(F.floor(F.col("lat") / band), F.floor(F.col("lon") / band)).count()
        if cells.agg(F.max("count")).first()[0] <= CROWD:
            break
        band /= 8
    found, k = [], 0
    while True:
        k += 1
        final = band >= extent
        near = _by_cells(rest, right, band * 1.000001) if k > 1 or final else _nearest(band_join(rest, right, band * 1.000001))
        found.append(scratch.write(near if final else near.filter(F.col("distance") <= band), f"found-{k}"))
        if final:
            break
        rest = scratch.write(rest.join(found[-1].select(F.col("a_key").alias("key")), "key", "left_anti"), f"rest-{k}")
        if rest.isEmpty():
            break
        band = min(extent, band * 8)
    return reduce(DataFrame.unionByName, found)


def first_match(near: DataFrame, listed: DataFrame, order: str) -> DataFrame:
    """The match of the station that comes first in the list, which need not be the nearest one: ``near`` has (a_key, ...),
    ``listed`` the stations (key, ``order``)."""
    return near.join(listed.select(F.col("key").alias("a_key"), F.col(order).alias("_nth")), "a_key").orderBy("_nth", "a_key").limit(1).drop("_nth")


def merged_points(sources: list[DataFrame], places: int = 2) -> DataFrame:
    """Points (seq, latitude, longitude) of several sources, rounded half to even (as scaled doubles, like numpy does); of
    points in one place that of the earliest source stays, and within it the least ``seq``."""
    scale = float(10**places)
    both = [s.select(F.lit(k).alias("src"), "seq", *[(F.rint(F.col(c) * scale) / scale).alias(c) for c in ("latitude", "longitude")]) for k, s in enumerate(sources)]
    return dedup_first(reduce(DataFrame.unionByName, both), ["latitude", "longitude"], ["src", "seq"])


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in the given order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")


def inverse_distance(pairs: DataFrame, value: str, power: float = 2.0) -> DataFrame:
    """Mean of ``value`` over the pairs of each a_key, weighted by inverse distance; a point at distance 0 decides alone."""
    weight = 1 / F.pow("distance", F.lit(power))
    return pairs.groupBy("a_key").agg(
        F.coalesce(F.avg(F.when(F.col("distance") == 0, F.col(value))), F.sum(F.when(F.col("distance") > 0, weight * F.col(value))) / F.sum(F.when((F.col("distance") > 0) & F.col(value).isNotNull(), weight))).alias(value)
    )


class Weighted(Block):
    """Sums of the values around each left point, weighted by inverse distance, and of those at it."""

    def __init__(self, left: Points, band: float, power: float):
        super().__init__(left, band)
        self.power, self.sums, self.met = power, np.zeros((4, len(left))), np.zeros(len(left), bool)

    def see(self, rows: slice, right: Points, distance: np.ndarray, close: np.ndarray, own: bool) -> None:
        known = ~np.isnan(right.value)
        value, at, away = np.where(known, right.value, 0.0), close & known & (distance == 0), close & known & (distance > 0)
        weight = np.zeros_like(distance)
        np.divide(1.0, distance**self.power, out=weight, where=away)
        self.sums[:, rows] += at @ value, at.sum(axis=1), weight @ value, weight.sum(axis=1)
        self.met[rows] |= close.any(axis=1)

    def rows(self) -> list[pa.Array]:
        return [pa.array(self.left.key[self.met]), *[pa.array(s[self.met]) for s in self.sums]]


def inverse_distance_within(left: DataFrame, right: DataFrame, band: float, power: float = 2.0) -> DataFrame:
    """:func:`inverse_distance` of the right values at most ``band`` degrees away on both axes, for left points that have any.

    Both sides have (key, lat, lon), the right one also value; NaN is no value. Pairs are summed up where they meet.
    """
    sums = over_blocks(left.withColumn("value", F.lit(0.0)), right.withColumn("key", F.lit(0)), band, lambda points, reach: Weighted(points, reach, power), "a_key long, at double, ats double, around double, weight double")
    at, ats, around, weight = (F.sum(c) for c in ("at", "ats", "around", "weight"))
    return sums.groupBy("a_key").agg(F.when(ats > 0, at / ats).when(weight > 0, around / weight).alias("value"))


def bilinear(points: DataFrame, nodes: DataFrame, value: str, step: float) -> DataFrame:
    """``value`` of grid ``nodes`` (lat, lon, value) at ``points`` (key, lat, lon); null if a needed corner is missing."""
    y, x = F.floor(F.col("lat") / step).cast("long"), F.floor(F.col("lon") / step).cast("long")
    at = points.select("key", (F.col("lat") / step - y).alias("v"), (F.col("lon") / step - x).alias("u"), y.alias("y"), x.alias("x"))
    corners = [F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)]
    share = lambda d, t: F.when(F.col(d) == 1, F.col(t)).otherwise(1 - F.col(t))
    at = at.withColumn("corner", F.explode(F.array(*corners))).select("key", "u", "v", F.col("corner.dy").alias("dy"), F.col("corner.dx").alias("dx"), "y", "x")
    at = at.withColumn("w", share("dy", "v") * share("dx", "u")).filter("w > 0").withColumn("y", F.col("y") + F.col("dy")).withColumn("x", F.col("x") + F.col("dx"))
    known = nodes.select(F.round(F.col("lat") / step).cast("long").alias("y"), F.round(F.col("lon") / step).cast("long").alias("x"), F.col(value).alias("_value"))
    joined = at.join(known, ["y", "x"], "left")
    return joined.groupBy("key").agg(F.when(F.count("_value") == F.count("*"), F.sum(F.col("w") * F.col("_value"))).alias(value))
