"""Ordinary kriging of point values such as correction factors.

The variogram is counted by Spark, pair by pair within a reach, into distance bins; a curve is fitted to the bins, of which
there are a fixed number. Each target then has a small linear system over its nearest points within the reach, solved
where its neighbours are; targets share nothing, so they are dealt freely.

Defined results: points without a place or a known value are left out, points of one place count as one with their mean.
A target without a point in reach gets nulls; a target at a point gets that point's value where the variogram has no
nugget. Targets that repeat a key are solved each.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.functions.et0 import known
from pluvia.operators.blocks import COLUMNS, ROWS, WIDER, Block, Points, over_blocks
from pluvia.session import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS, NEIGHBOURS = 15, 16
WIDEN, CROWD, NARROWEST = 4, 64, 12
RUN, NODES = 16, 6


def known_points(points: DataFrame) -> DataFrame:
    """One row a place: key (the least), lat, lon and value (the mean)."""
    there = points.filter(known(F.col("lat").cast("double")).isNotNull() & known(F.col("lon").cast("double")).isNotNull() & known(F.col("value").cast("double")).isNotNull())
    return there.groupBy("lat", "lon").agg(F.min("key").alias("key"), F.avg(F.col("value").cast("double")).alias("value")).select("key", "lat", "lon", "value")


class Runs:
    """Neighbours of one latitude, summed up: places of the points, box, count, sums of value and square, and ``NODES`` weighted
    places that stand for the points in a sum of a smooth function of the longitude (Chebyshev interpolation)."""

    def __init__(self, points: Points, centre: float, most: float):
        lat, lon, value = points.lat, points.lon, points.value - centre
        apart = np.diff(lon)[np.diff(lat) == 0]
        width = min(most, RUN * apart.mean()) if len(apart) else most
        cell = np.floor(lon / max(width, 1e-300))
        first = np.flatnonzero(np.append(True, (np.diff(lat) != 0) | (np.diff(cell) != 0)))
        length = np.diff(np.append(first, len(lon)))
        first = np.concatenate([np.arange(f, f + n, 2 * RUN) for f, n in zip(first, length)]) if length.max() > 2 * RUN else first
        self.n = np.diff(np.append(first, len(lon)))
        self.lat, self.low, self.high = lat[first], lon[first], lon[first + self.n - 1]
        self.value, self.square = np.add.reduceat(value, first), np.add.reduceat(value * value, first)
        at = np.arange(2 * RUN)
        self.points = np.where(at < self.n[:, None], first[:, None] + at, len(lon))
        nodes = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
        middle, half = (self.low + self.high) / 2, np.maximum((self.high - self.low) / 2, 1e-300)
        self.nodes = middle[:, None] + half[:, None] * nodes
        of = np.repeat(np.arange(len(first)), self.n)
        u = (lon - middle[of]) / half[of]
        basis = [np.prod([(u - nodes[j]) / (nodes[i] - nodes[j]) for j in range(NODES) if j != i], axis=0) for i in range(NODES)]
        self.weights = np.add.reduceat(np.array(basis), first, axis=1).T


def _padded(points: Points) -> Points:
    """With one more, that is in no pair, at the end."""
    return Points(np.append(points.key, -1), *(np.append(x, np.nan) for x in (points.lat, points.lon, points.value)))


class Bins(Block):
    """Counts and sums of the pairs at most ``band`` apart by distance bin, each pair twice.

    Where points stand in rows of one latitude, as those of a grid do, runs of them are compared first: two runs whose
    pairs are all in one bin are summed up from their sums, and points are looked at only for the others.
    """

    def __init__(self, left: Points, band: float, bins: int):
        super().__init__(left, band)
        self.bins, self.sums = bins, np.zeros((3, bins + 1))  # the last for pairs that don't count
        self.centre = left.value.mean()
        self.runs, self.padded = Runs(self.left, self.centre, band / bins / 4), _padded(self.left)

    def add(self, right: Points, own: bool) -> None:
        runs = Runs(right, self.centre, self.band / self.bins / 4)  # batches come in order of lat and lon
        if len(runs.n) * 4 > len(right) or len(self.runs.n) * 4 > len(self.left):
            return super().add(right, own)
        right = _padded(right)
        step = max(1, (1 << 18) // len(runs.n))
        for i in range(0, len(self.runs.n), step):
            self._meet(np.arange(i, min(i + step, len(self.runs.n))), runs, right, own)

    def _meet(self, some: np.ndarray, runs: Runs, right: Points, own: bool) -> None:
        mine, width = self.runs, self.band / self.bins
        low, high = mine.low[some, None], mine.high[some, None]
        y = np.abs(mine.lat[some, None] - runs.lat)
        x = np.maximum(0.0, np.maximum(runs.low - high, low - runs.high))
        least = np.sqrt(y * y + x * x)
        x = np.maximum(runs.high - low, high - runs.low)
        most = np.sqrt(y * y + x * x) * WIDER
        near = least <= self.band * WIDER
        bins = np.minimum(np.floor(most / width), self.bins - 1)
        alike = near & (most <= self.band) & (np.floor(least / WIDER / width) == bins) & ((high - low) + (runs.high - runs.low) <= least / 16) & (least > 0)
        a, b = np.nonzero(alike)
        bins, y, a, twice = bins[a, b].astype(np.int64), y[a, b], some[a], 1.0 if own else 2.0
        for i in range(0, len(a), COLUMNS):
            p, q, gap = a[i : i + COLUMNS], b[i : i + COLUMNS], y[i : i + COLUMNS]
            apart = mine.nodes[p][:, :, None] - runs.nodes[q][:, None]
            distance = np.einsum("pi,pij,pj->p", mine.weights[p], np.sqrt(apart * apart + (gap * gap)[:, None, None]), runs.weights[q])
            squares = runs.n[q] * mine.square[p] - 2 * mine.value[p] * runs.value[q] + mine.n[p] * runs.square[q]
            for k, w in enumerate((mine.n[p] * runs.n[q], distance, squares)):
                self.sums[k] += twice * np.bincount(bins[i : i + COLUMNS], w, self.bins + 1)
        a, b = np.nonzero(near & ~alike)
        a, step = some[a], 1 + ROWS * COLUMNS // (4 * RUN * RUN)
        for i in range(0, len(a), step):
            p, q = mine.points[a[i : i + step]], runs.points[b[i : i + step]]
            p, q = p[:, : (p < len(self.left)).sum(axis=1).max()], q[:, : (q < len(right) - 1).sum(axis=1).max()]
            left, other = self.padded[p[:, :, None]], right[q[:, None, :]]
            y, x = np.abs(left.lat - other.lat), np.abs(left.lon - other.lon)
            self._count(left, other, np.sqrt(y * y + x * x), (y <= self.band) & (x <= self.band), own)

    def see(self, rows: slice, right: Points, distance: np.ndarray, close: np.ndarray, own: bool) -> None:
        left = self.left[rows]
        self._count(Points(left.key[:, None], left.lat[:, None], left.lon[:, None], left.value[:, None]), right, distance, close, own)

    def _count(self, left: Points, right: Points, distance: np.ndarray, close: np.ndarray, own: bool) -> None:
        close &= distance <= self.band
        if own:
            close &= left.key != right.key
        distance = distance[close]
        bins = np.minimum((distance / (self.band / self.bins)).astype(np.int64), self.bins - 1)
        gap = (left.value - right.value)[close]
        for k, w in enumerate((None, distance, gap * gap)):
            self.sums[k] += (1.0 if own else 2.0) * np.bincount(bins, w, self.bins + 1)

    def rows(self) -> list[pa.Array]:
        seen = np.flatnonzero(self.sums[0, : self.bins])
        n, distance, gap = self.sums[:, seen]
        return [pa.array(seen, pa.int32()), pa.array(n, pa.int64()), pa.array(distance), pa.array(gap)]


def variogram(points: DataFrame, reach: float, bins: int = BINS) -> DataFrame:
    """bin, n, distance (mean) and gamma (half the mean squared difference) of the pairs at most ``reach`` apart, each pair once.

    All pairs in reach count, where their points meet; of a pair nothing is shuffled. Keys are unique.
    """
    there = points.filter(known(F.col("value").cast("double")).isNotNull())
    sums = over_blocks(there, there, reach, lambda left, band: Bins(left, band, bins), "bin int, n long, distance double, gap double", once=True)
    n = F.sum("n")
    return sums.groupBy("bin").agg((n / 2).cast("long").alias("n"), (F.sum("distance") / n).alias("distance"), (F.sum("gap") / n / 2).alias("gamma"))


class Nearest(Block):
    """The ``most`` nearest right points at most ``band`` away from each left point; ties by key."""

    def __init__(self, left: Points, band: float, most: int):
        super().__init__(left, band)
        self.most, self.held, self.size = most, [], 0
        self.bound = np.full(len(left), band)

    def see(self, rows: slice, right: Points, distance: np.ndarray, close: np.ndarray, own: bool) -> None:
        at, of = np.nonzero(close & (distance <= self.bound[rows, None]))
        self.held.append((at + rows.start, distance[at, of], right[of]))
        self.size += len(at)
        if self.size > 4 * self.most * len(self.left) + (1 << 16):
            self._settle()

    def _settle(self) -> tuple[np.ndarray, Points]:
        """Leaves the nearest ones, in order."""
        at, distance = (np.concatenate([h[i] for h in self.held]) if self.held else np.zeros(0, t) for i, t in ((0, np.int64), (1, np.float64)))
        points = Points.joined([h[2] for h in self.held] or [self.left[:0]])
        order = np.lexsort((points.key, distance, at))
        at = at[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        last = nth == self.most - 1
        self.bound[at[last]] = distance[order][last]
        order, at = order[nth < self.most], at[nth < self.most]
        self.held, self.size = [(at, distance[order], points[order])], len(at)
        return at, points[order]

    def rows(self) -> list[pa.Array]:
        at, points = self._settle()
        ends = np.searchsorted(at, np.arange(len(self.left) + 1))
        near = pa.StructArray.from_arrays([pa.array(points.lat), pa.array(points.lon), pa.array(points.value)], ["b_lat", "b_lon", "value"])
        return [pa.array(self.left.key), pa.array(self.left.lat), pa.array(self.left.lon), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near)]


def _first_band(points: DataFrame, reach: float) -> int:
    """How often ``reach`` is divided by ``WIDEN`` until a point shares its cell with ``CROWD`` at most, on average."""
    k = 0
    while k < NARROWEST:
        cells = points.groupBy(*[F.floor(F.col(c) / (reach / WIDEN**k)) for c in ("lat", "lon")]).agg(F.count("*").cast("double").alias("n"))
        crowd = cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
        if crowd <= CROWD:
            break
        k += max(1, int(np.log(crowd / CROWD) / np.log(WIDEN**2)))
    return min(k, NARROWEST)


def nearest_points(targets: DataFrame, points: DataFrame, reach: float, most: int, scratch: Scratch) -> DataFrame:
    """row, a_lat, a_lon and the list ``near`` (b_lat, b_lon, value) of the ``most`` nearest points within ``reach`` of each target
    (key, lat, lon) that has a place; ties by key.

    A narrow band comes first. Targets that find ``most`` points there are done, as none outside is nearer; the band
    widens for the others.
    """
    found, rest = [], targets.select("key", "lat", "lon")
    for k in range(_first_band(points, reach), -1, -1):
        schema = "row long, a_lat double, a_lon double, near array<struct<b_lat: double, b_lon: double, value: double>>"
        asked = rest.withColumn("value", F.lit(0.0))
        near = scratch.write(over_blocks(asked, points, reach / WIDEN**k, lambda left, band: Nearest(left, band, most), schema), f"near-{k}")
        whole = (F.size("near") >= most) | F.lit(k == 0)
        found.append(near.filter(whole))
        rest = near.filter(~whole).select(F.col("row").alias("key"), F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon"))
        if k and rest.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


@dataclass(frozen=True)
class Curve:
    """gamma(d) = nugget + sill (1 - exp(-3 d / spread)) for d > 0, and 0 at 0."""

    nugget: float
    sill: float
    spread: float

    def __call__(self, d: np.ndarray) -> np.ndarray:
        return np.where(d > 0, self.nugget + self.sill * (1 - np.exp(-3 * d / self.spread)), 0.0)

    @classmethod
    def fit(cls, distance: np.ndarray, gamma: np.ndarray, n: np.ndarray, reach: float) -> Curve:
        """Least squares weighted by pairs: the spread by a fixed grid, nugget and sill (neither below 0) in closed form."""
        if not len(distance):
            return cls(0.0, 1.0, reach)
        best = (np.inf, 0.0, 0.0, reach)
        for spread in reach * np.geomspace(0.05, 3, 60):
            shape = 1 - np.exp(-3 * distance / spread)
            x, w = np.column_stack([np.ones_like(shape), shape]), np.sqrt(n)
            tried = [np.linalg.lstsq(x * w[:, None], gamma * w, rcond=None)[0], (0.0, (n * shape * gamma).sum() / max((n * shape * shape).sum(), 1e-300)), ((n * gamma).sum() / n.sum(), 0.0)]
            for nugget, sill in tried:
                if nugget >= 0 and sill >= 0:
                    best = min(best, (float((n * (gamma - nugget - sill * shape) ** 2).sum()), float(nugget), float(sill), float(spread)))
        _, nugget, sill, spread = best
        return cls(nugget, sill, spread) if nugget + sill > 0 else cls(0.0, 1.0, spread)  # constant values: any curve gives them back


def solve(curve: Curve, at: np.ndarray, near: np.ndarray, values: np.ndarray) -> tuple[float, float]:
    """Estimate and its variance at ``at`` (lat, lon) from ``near`` (point, lat and lon): weights that add up to 1."""
    apart = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    k = len(near)
    system = np.ones((k + 1, k + 1))
    system[:k, :k], system[k, k] = curve(apart(near, near)), 0.0
    right = np.append(curve(apart(near, at[None]))[:, 0], 1.0)
    try:
        weights = np.linalg.solve(system, right)
    except np.linalg.LinAlgError:  # a curve that is flat at 0 over all neighbours
        weights = np.linalg.lstsq(system, right, rcond=None)[0]
    return float(weights[:k] @ values), max(0.0, float(weights @ right))


def krige(targets: DataFrame, points: DataFrame, reach: float, neighbours: int = NEIGHBOURS, curve: Curve | None = None) -> DataFrame:
    """a_key, n, value and variance of each target (key, lat, lon) from its nearest points (key, lat, lon, value) within ``reach``.

    The ``neighbours`` nearest ones are the method's own window; ties by key. Without a ``curve`` it is fitted to the
    variogram of all points.
    """
    scratch = Scratch(targets.sparkSession, "kriging")
    points = scratch.write(known_points(points), "points")
    if curve is None:
        bins = variogram(points, reach).toPandas()  # BINS rows at most
        curve = Curve.fit(*(bins[c].to_numpy(dtype=float) for c in ("distance", "gamma", "n")), reach)
    asked = scratch.write(targets.select("key", "lat", "lon").withColumn("row", F.monotonically_increasing_id()), "targets")
    listed = nearest_points(asked.select(F.col("row").alias("key"), "lat", "lon"), points, reach, neighbours, scratch).filter(F.size("near") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lat, lon, near in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                found.append(solve(curve, np.array([lat, lon]), np.array([[p["b_lat"], p["b_lon"]] for p in near]), np.array([p["value"] for p in near])))
            values, variances = zip(*found) if found else ((), ())
            sizes = [len(near) for near in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(values, pa.float64()), pa.array(variances, pa.float64())], ["row", "n", "value", "variance"])

    solved = listed.select("row", "a_lat", "a_lon", "near").mapInArrow(run, "row long, n int, value double, variance double")
    found = asked.select("row", F.col("key").alias("a_key")).join(solved, "row", "left")
    return found.select("a_key", F.coalesce("n", F.lit(0)).alias("n"), "value", "variance")
