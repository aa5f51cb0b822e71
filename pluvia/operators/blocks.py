"""Sums and nearest points over all pairs of two sets of points in a band, without a row for a pair.

Points stand in square cells a little wider than the band. A cell's left points, dealt to parts of about ``PART`` where
there are more, meet the right points of the cell and its neighbours in one group; a group's left points are held and its
right points pass by in batches, so memory is bounded however many points crowd a cell. What is shuffled are points.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART, ROWS, COLUMNS, SHARE = 1 << 15, 64, 1024, 50_000
LEFT, OWN, OTHER = 0, 1, 2  # sides
WIDER = 1 + 1e-9  # cells and searches are a little wider than the band, so that rounding loses no pair
POINT = ["key", "lat", "lon", "value"]


class Points:
    """Arrays key, lat, lon and value."""

    def __init__(self, key: np.ndarray, lat: np.ndarray, lon: np.ndarray, value: np.ndarray):
        self.key, self.lat, self.lon, self.value = key, lat, lon, value

    def __len__(self) -> int:
        return len(self.key)

    def __getitem__(self, at: slice | np.ndarray) -> Points:
        return Points(self.key[at], self.lat[at], self.lon[at], self.value[at])

    @classmethod
    def joined(cls, parts: list[Points]) -> Points:
        return cls(*(np.concatenate([getattr(p, c) for p in parts]) for c in POINT))


class Block:
    """What one group finds out: ``see`` gets blocks of pairs, ``rows`` gives the columns of the result."""

    def __init__(self, left: Points, band: float):
        self.left, self.band = left[np.lexsort((left.lon, left.lat))], band

    def add(self, right: Points, own: bool) -> None:
        """Where cells meet once, ``right`` is of the cell itself (``own``) or of its neighbours. Only right points in reach of ``ROWS`` left ones are looked at."""
        right, far = right[np.argsort(right.lon)], self.band * WIDER
        for i in range(0, len(self.left), ROWS):
            rows = slice(i, i + ROWS)
            left = self.left[rows]
            low, high = np.searchsorted(right.lon, [left.lon.min() - far, left.lon.max() + far], side="left")
            near = low + np.flatnonzero((right.lat[low:high] >= left.lat[0] - far) & (right.lat[low:high] <= left.lat[-1] + far))
            for j in range(0, len(near), COLUMNS):
                some = right[near[j : j + COLUMNS]]
                y, x = np.abs(left.lat[:, None] - some.lat), np.abs(left.lon[:, None] - some.lon)
                distance = np.sqrt(y * y + x * x)
                self.see(rows, some, distance, (y <= self.band) & (x <= self.band), own)

    def see(self, rows: slice, right: Points, distance: np.ndarray, close: np.ndarray, own: bool) -> None:
        raise NotImplementedError

    def rows(self) -> list[pa.Array]:
        raise NotImplementedError


def over_blocks(left: DataFrame, right: DataFrame, band: float, begin: Callable[[Points, float], Block], schema: str, once: bool = False) -> DataFrame:
    """Rows of the blocks that ``begin`` makes of each group's left points; both sides have (key long, lat, lon, value).

    With ``once`` both sides are the same points and two neighbouring cells meet once. Rows without a key or a place are left out.
    """
    spark, width = left.sparkSession, band * WIDER
    somewhere = "key IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)"

    def placed(df: DataFrame) -> DataFrame:
        point = [F.col("key").cast("long").alias("key"), *[F.col(c).cast("double").alias(c) for c in POINT[1:]]]
        return df.filter(somewhere).select(*point, *[F.floor(F.col(c) / width).cast("long").alias(k) for c, k in (("lat", "y"), ("lon", "x"))])

    a = placed(left)
    sizes = a.groupBy("y", "x").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    crowded = F.broadcast(sizes.filter("parts > 1"))  # one for ``PART`` left points at most
    a = a.join(crowded, ["y", "x"], "left").withColumn("part", F.pmod(F.xxhash64("key", "lat", "lon"), F.coalesce("parts", F.lit(1))).cast("int")).withColumn("side", F.lit(LEFT))
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if not once or (dy, dx) >= (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps]))
    b = placed(right).withColumn("step", step).withColumn("side", F.when((F.col("step.dy") == 0) & (F.col("step.dx") == 0) | F.lit(not once), OWN).otherwise(OTHER))
    b = b.withColumn("y", F.col("y") + F.col("step.dy")).withColumn("x", F.col("x") + F.col("step.dx"))
    b = b.join(sizes, ["y", "x"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["y", "x", "part", "side", *POINT]
    tasks = max(4 * spark.sparkContext.defaultParallelism, (left.count() + right.count()) // SHARE)
    rows = a.select(*columns).unionByName(b.select(*columns)).repartition(tasks, "y", "x", "part").sortWithinPartitions("y", "x", "part", "side", "lat", "lon")

    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block, done = None, [], None, []

        def finish() -> None:
            if at is not None:
                done.append(pa.RecordBatch.from_arrays((block or begin(Points.joined(held), band)).rows(), names))

        for batch in batches:
            y, x, part, side, *point = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(len(columns)))
            points, groups = Points(*point), np.column_stack((y, x, part, side))
            starts = np.flatnonzero(np.append(True, (groups[1:] != groups[:-1]).any(axis=1)))[: len(groups)].tolist()
            for low, high in zip(starts, [*starts[1:], len(groups)]):
                *group, where = groups[low].tolist()
                if group != at:
                    finish()
                    at, held, block = group, [], None
                if where == LEFT:
                    held.append(points[low:high])
                    continue
                if block is None:
                    block = begin(Points.joined(held), band)
                block.add(points[low:high], where == OWN)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done.clear()
        finish()
        yield from done

    return rows.mapInArrow(run, schema)
