"""The archive of observations as a Spark data source, for batches and for streams.

What a fetch brings lands as blocks (see :func:`pluvia.sources.weather.archive`) in one folder a unit,
``chunk=<number>/year=<year>``: a chunk of points and a year are what one request asks for. A unit is one file, written in
one move, so a file that is there is whole; a request that found nothing lands a file without blocks.

``spark.read.format("pluvia_archive")`` has a partition per unit. Filters on chunk and year, and what a filter on the
time says about the year, are pushed down and leave whole units unread. ``spark.readStream`` gives the units in the
order in which they are fetched, chunk by chunk and year by year, as far as they have landed without a gap; its offset
is the last unit given, so a query that starts again goes on behind the units that its checkpoint has.

Options: ``path``, any URI that ``pyarrow.fs`` opens; for streams also ``chunks`` (how many) and ``years`` (first-last).
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from pluvia.operators.series import chunks
from pluvia.sources.weather import ARCHIVE_VALUES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "pluvia_archive"
ROWS = pa.schema(
    [("latitude", pa.float64()), ("longitude", pa.float64()), ("timestamp", pa.timestamp("us")), *((v, pa.float64()) for v in ARCHIVE_VALUES), ("chunk", pa.int32()), ("year", pa.int32())]
)
SCHEMA = ", ".join(f"{f.name} {({'timestamp[us]': 'timestamp_ntz', 'int32': 'int'}).get(str(f.type), 'double')}" for f in ROWS)
BLOCKS = 64  # blocks that are unfolded at once


class Unit(ds.InputPartition):
    def __init__(self, chunk: int, year: int):
        super().__init__((chunk, year))
        self.chunk, self.year = chunk, year


class Landing:
    """The folder of units."""

    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path)

    def names(self, folder: str) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [f.base_name for f in found]

    def numbers(self, folder: str, key: str) -> list[int]:
        found = (re.fullmatch(rf"{key}=(-?[0-9]+)", name) for name in self.names(folder))
        return sorted(int(m[1]) for m in found if m)

    def units(self) -> Iterator[Unit]:
        for chunk in self.numbers(self.root, "chunk"):
            for year in self.numbers(f"{self.root}/chunk={chunk}", "year"):
                yield Unit(chunk, year)

    def parts(self, unit: Unit) -> list[str]:
        folder = f"{self.root}/chunk={unit.chunk}/year={unit.year}"
        return [f"{folder}/{name}" for name in sorted(self.names(folder)) if name.endswith(".parquet") and name[0] not in "._"]

    def rows(self, unit: Unit) -> Iterator[pa.RecordBatch]:
        for part in self.parts(unit):
            with self.files.open_input_file(part) as opened:
                for blocks in pq.ParquetFile(opened).iter_batches(BLOCKS):
                    yield unfolded(blocks, unit)


def unfolded(blocks: pa.RecordBatch, unit: Unit) -> pa.RecordBatch:
    """A row per instant of each block: ``start``, one ``interval_s`` on, and so on before ``end``; short arrays end in nulls."""
    heads = {name: blocks.column(name).to_pylist() for name in ("lat", "lon", "start", "end", "interval_s")}
    lists = {v: blocks.column(v) for v in ARCHIVE_VALUES}
    sizes = []
    for i in range(len(blocks)):
        longest = max((len(of[i]) if of[i].is_valid else 0) for of in lists.values())
        room = -(-(heads["end"][i] - heads["start"][i]) // heads["interval_s"][i])
        sizes.append(max(0, min(longest, room)))
    times = [heads["start"][i] + np.arange(n) * heads["interval_s"][i] for i, n in enumerate(sizes)]
    columns = [np.repeat(np.array(heads[c], dtype=float), sizes) for c in ("lat", "lon")]
    columns.append(pa.array(np.concatenate([*times, np.zeros(0, np.int64)]).astype(np.int64) * 1_000_000, pa.int64()).cast(pa.timestamp("us")))
    for of in lists.values():
        cut = [(of[i].values.slice(0, n) if of[i].is_valid else pa.array([], pa.float64())).cast(pa.float64()) for i, n in enumerate(sizes)]
        whole = [x for c, n in zip(cut, sizes) for x in (c, pa.nulls(n - len(c), pa.float64()))]
        columns.append(pa.concat_arrays(whole) if whole else pa.array([], pa.float64()))
    columns += [np.full(sum(sizes), n, np.int32) for n in (unit.chunk, unit.year)]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=ROWS)


class ArchiveReader(ds.DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Take filters on chunk and year; of those on the time take the year, and leave them to Spark too."""
        compare = {ds.EqualTo: "__eq__", ds.GreaterThan: "__gt__", ds.GreaterThanOrEqual: "__ge__", ds.LessThan: "__lt__", ds.LessThanOrEqual: "__le__"}
        loose = {"__gt__": "__ge__", "__lt__": "__le__"}
        for f in filters:
            column, value = getattr(f, "attribute", ("",))[0], getattr(f, "value", None)
            if column in ("chunk", "year") and isinstance(f, (ds.In, ds.IsNotNull)):
                if isinstance(f, ds.In):
                    self.tests.append((column, "in", tuple(value)))
            elif column in ("chunk", "year") and type(f) in compare:
                self.tests.append((column, compare[type(f)], value))
            else:
                if column == "timestamp" and type(f) in compare:
                    how = compare[type(f)]
                    self.tests.append(("year", loose.get(how, how), value.year))
                yield f

    def wanted(self, unit: Unit) -> bool:
        return all(getattr(unit, c) in v if how == "in" else getattr(getattr(unit, c), how)(v) for c, how, v in self.tests)

    def partitions(self) -> Sequence[Unit]:
        return [u for u in Landing(self.path).units() if self.wanted(u)]

    def read(self, partition: Unit | None) -> Iterator[pa.RecordBatch]:
        return Landing(self.path).rows(partition) if partition is not None else iter(())  # None where no unit is wanted


class ArchiveStream(ds.DataSourceStreamReader):
    """Units in fetching order. An offset names the last unit given; ``chunk`` -1 stands before the first."""

    def __init__(self, path: str, count: int, first: int, last: int):
        self.path, self.count, self.first, self.last = path, count, first, last
        self.at = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"chunk": -1, "year": self.last}

    def after(self, offset: dict) -> Iterator[Unit]:
        """The units of the plan behind ``offset``."""
        for year in range(offset["year"] + 1, self.last + 1):
            yield Unit(offset["chunk"], year)
        for chunk in range(offset["chunk"] + 1, self.count):
            for year in range(self.first, self.last + 1):
                yield Unit(chunk, year)

    def latestOffset(self) -> dict:
        landing = Landing(self.path)
        for unit in self.after(self.at):
            if not landing.parts(unit):
                break
            self.at = {"chunk": unit.chunk, "year": unit.year}
        return self.at

    def partitions(self, start: dict, end: dict) -> Sequence[Unit]:
        last = (end["chunk"], end["year"])
        found = []
        for unit in self.after(start):
            if (unit.chunk, unit.year) > last:
                break
            found.append(unit)
        return found

    def read(self, partition: Unit | None) -> Iterator[pa.RecordBatch]:
        return Landing(self.path).rows(partition) if partition is not None else iter(())  # None where no unit is wanted


class Archive(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def streamReader(self, schema) -> ArchiveStream:
        first, last = re.fullmatch(r"(-?[0-9]+)-(-?[0-9]+)", self.options["years"]).groups()
        return ArchiveStream(self.options["path"], int(self.options["chunks"]), int(first), int(last))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Observation rows with their chunk and year. Turns on push-down to sources of this kind for the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(Archive)
    return spark.read.format(NAME).option("path", path).load()


def stream_archive(spark: SparkSession, path: str, chunks: int, years: tuple[int, int]) -> DataFrame:
    spark.dataSource.register(Archive)
    return spark.readStream.format(NAME).option("path", path).option("chunks", chunks).option("years", f"{years[0]}-{years[1]}").load()


def numbered_points(observations: DataFrame, size: int = 10) -> DataFrame:
    """The points of ``observations`` by latitude and longitude, with their chunk of ``size``."""
    points = observations.select("latitude", "longitude").filter("latitude IS NOT NULL AND longitude IS NOT NULL").distinct()
    return chunks(points, ["latitude", "longitude"], size).select("latitude", "longitude", F.col("chunk").cast("int").alias("chunk"))


def blocks(observations: DataFrame, points: DataFrame) -> DataFrame:
    """Hourly blocks of each point and year: what a fetch of the observations would land.

    Values of an hour are averaged, hours without any are null. A block has the hours of a year at most.
    """
    hour = F.unix_date(F.to_date("timestamp")).cast("long") * 24 + F.hour("timestamp")  # the same in any session zone
    values = [c if c in observations.columns else None for c in ARCHIVE_VALUES]
    means = [(F.avg(v) if v else F.lit(None).cast("double")).alias(name) for v, name in zip(values, ARCHIVE_VALUES)]
    hours = observations.filter("timestamp IS NOT NULL").groupBy("latitude", "longitude", F.year("timestamp").alias("year"), hour.alias("hour")).agg(*means)
    grouped = hours.groupBy("latitude", "longitude", "year").agg(F.min("hour").alias("first"), F.max("hour").alias("last"), F.map_from_entries(F.collect_list(F.struct("hour", F.struct(*ARCHIVE_VALUES).alias("v")))).alias("by_hour"))
    axis = F.sequence("first", "last")

    def filled(value: str) -> Column:
        return F.transform(axis, lambda hour: F.col("by_hour")[hour][value]).alias(value)

    found = grouped.select("latitude", "longitude", "year", (F.col("first") * 3600).alias("start"), ((F.col("last") + 1) * 3600).alias("end"), F.lit(3600).alias("interval_s"), *map(filled, ARCHIVE_VALUES))
    return found.join(points, ["latitude", "longitude"]).withColumnsRenamed({"latitude": "lat", "longitude": "lon"})


def land(blocks: DataFrame, path: str) -> None:
    """Write blocks into their units, one file each."""
    dealt = blocks.repartition("chunk", "year").sortWithinPartitions("chunk", "year", "lat", "lon")
    dealt.write.mode("append").partitionBy("chunk", "year").parquet(path)
