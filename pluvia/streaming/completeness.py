"""Completeness of each point and year as hours arrive, in any order.

The state of a point and year is a bitmap of the hours seen (about 1 kB), so a replayed or doubled hour counts once. A
change of class is given as it happens. A year is open until the watermark, which follows the ends of the years seen and
not the hours themselves, has passed its end: then a timer gives its last class and its state goes. Rows of a closed year
are dropped.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pluvia.operators.quality import COMPLETE_ABOVE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ["latitude", "longitude", "year"]
CHANGES = "latitude double, longitude double, year int, n long, status string, closed boolean"


class HoursSeen(StatefulProcessor):
    """Emits (key, n, status, closed) when a point and year changes its class, and when its year closes."""

    def __init__(self, complete_above: int):
        self.complete_above = complete_above

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("hours", "bits binary, n long")

    def status(self, n: int) -> str:
        return "complete" if n > self.complete_above else "partial" if n else "missing"

    def change(self, key: tuple, n: int, closed: bool) -> Iterator[pd.DataFrame]:
        latitude, longitude, year = key
        yield pd.DataFrame({"latitude": [latitude], "longitude": [longitude], "year": [year], "n": [n], "status": [self.status(n)], "closed": [closed]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        bits, before = (int.from_bytes(held[0], "little"), held[1]) if held else (0, None)
        for frame in rows:
            if before is None:
                self.handle.registerTimer(int(frame["year_end_ms"].iloc[0]))
                before = 0
            for hour in frame["hour_of_year"].dropna().astype(int).unique():
                bits |= 1 << int(hour)
        n = bits.bit_count()
        self.state.update((bits.to_bytes((bits.bit_length() + 7) // 8, "little"), n))
        if held is None or self.status(n) != self.status(before):
            yield from self.change(key, n, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.state.get()[1] if self.state.exists() else 0
        self.state.clear()
        yield from self.change(key, n, True)

    def close(self) -> None:
        pass


def expected_rows(points: DataFrame, years: list[int]) -> DataFrame:
    """A row without an hour for each expected point and year: sent ahead of the observations, it makes those without any known as missing."""
    each = points.select("latitude", "longitude").distinct().withColumn("year", F.explode(F.array(*map(F.lit, years))))
    return each.select("latitude", "longitude", F.expr("make_timestamp_ntz(year, 1, 1, 0, 0, 0)").alias("timestamp"), F.lit(False).alias("seen"))


def running_completeness(observations: DataFrame, open_for: str = "10 years", complete_above: int = COMPLETE_ABOVE) -> DataFrame:
    """Changes of class of a stream of (latitude, longitude, timestamp, seen); ``seen`` false only announces a point and year.

    A year closes once a row of a year that ends ``open_for`` later has come. Rows without a place or time are left out.
    """
    spark = observations.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    year = F.year("timestamp")
    hour = (F.dayofyear("timestamp") - 1) * 24 + F.hour("timestamp")
    end = F.to_timestamp(F.concat((year + 1).cast("string"), F.lit("-01-01 00:00:00 UTC")), "yyyy-MM-dd HH:mm:ss z")
    rows = observations.filter("latitude IS NOT NULL AND longitude IS NOT NULL AND timestamp IS NOT NULL").select(
        "latitude", "longitude", year.alias("year"), F.when(F.col("seen"), hour).alias("hour_of_year"), end.alias("year_end"), F.unix_millis(end).alias("year_end_ms")
    )
    return rows.withWatermark("year_end", open_for).groupBy(*KEYS).transformWithStateInPandas(HoursSeen(complete_above), CHANGES, "Append", "EventTime")


def latest(changes: DataFrame) -> DataFrame:
    """The class of each point and year by the last of its changes; hours only ever grow."""
    return changes.groupBy(*KEYS).agg(F.max("n").alias("n"), F.max_by("status", "n").alias("status"), F.bool_or("closed").alias("closed"))


def follow(spark: SparkSession, landing: str, changes: str, checkpoint: str, files_a_batch: int = 1000, **settings):
    """Read what has landed in ``landing`` (Parquet: latitude, longitude, timestamp, seen) and add the changes to ``changes``."""
    kind = "latitude double, longitude double, timestamp timestamp_ntz, seen boolean"
    arrived = spark.readStream.schema(kind).option("maxFilesPerTrigger", files_a_batch).parquet(landing)
    found = running_completeness(arrived, **settings)
    return found.writeStream.format("parquet").option("path", changes).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
