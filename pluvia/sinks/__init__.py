"""Table writers and small files."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.operators.writes import add_missing_columns, insert_ignore, replace_table, upsert, write_observations
from pluvia.session import Scratch, exists

# Fixed schemas of the tables that are planned beside the observations.
PLANNED = {
    "stations": "station_id STRING, name_cn STRING, lat DOUBLE, lon DOUBLE, province STRING",
    "daily_weather": "id BIGINT, station_id STRING, date DATE, t_max DOUBLE, t_min DOUBLE, precip DOUBLE, wind_speed DOUBLE, humidity DOUBLE, source STRING",
    "spei_results": "station_id STRING, date DATE, spei_1 DOUBLE, spei_3 DOUBLE, spei_12 DOUBLE, drought_level STRING, is_predicted BOOLEAN",
}
OBSERVATION_KEYS = ["latitude", "longitude", "timestamp"]


def append_new_observations(spark: SparkSession, new: DataFrame, path: str, order: list[str]) -> None:
    """Insert-or-ignore into the year-partitioned table: only the years of the batch are read for known keys.

    Of several new rows of a key the first by ``order`` stays; columns of ``order`` that the table lacks aren't stored.
    """
    new = Scratch(spark, "append").write(new, "new")  # read more than once
    there = exists(spark, path)
    old = spark.read.parquet(path) if there else new.limit(0)
    stored = [c for c in new.columns if c in old.columns] if there else [c for c in new.columns if c not in order or c in OBSERVATION_KEYS]
    if there:
        years = [r[0] for r in new.select(F.year("timestamp")).distinct().collect()]  # a row a year
        old = old.filter(F.col("obs_year").isin(years))
    write_observations(insert_ignore(old, new, OBSERVATION_KEYS, order).select(*stored), path)


class ObservationTable:
    """Observations in a table partitioned by year and bucketed by place, sorted by place and time.

    ``place`` is a hash of the coordinates: buckets of a double can't serve a join, which compares normalised doubles.

    An insert anti-joins the batch with the years it touches. The batch is dealt by place as the buckets are, so history
    is read bucket by bucket where it lies and is never shuffled. A place has an hour's row once a key, so a bucket's size
    is bounded by its places and hours, whatever source sends most.

    The files lie in ``path``, which the driver and all executors must share; a table whose files are there but that the
    session's catalog doesn't know is taken up again.
    """

    KEYS = ["place", *OBSERVATION_KEYS]

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 16):
        self.spark, self.name, self.path, self.buckets = spark, name, path.rstrip("/"), buckets
        if not spark.catalog.tableExists(name) and exists(spark, self.path):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(self.path).schema)
            spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (obs_year) CLUSTERED BY (place)"
                f" SORTED BY (place, timestamp) INTO {buckets} BUCKETS LOCATION '{self.path}'"
            )
            spark.sql(f"MSCK REPAIR TABLE {name}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _dealt(self, new: DataFrame) -> DataFrame:
        place = F.xxhash64(F.col("latitude") + 0.0, F.col("longitude") + 0.0)  # the sum makes one of both zeros
        return new.withColumns({"place": place, "obs_year": F.year("timestamp")}).repartition(self.buckets, "place")

    def fresh(self, new: DataFrame, order: list[str]) -> DataFrame:
        """The rows of ``new`` to append: the first by ``order`` of each key that the table doesn't have."""
        dealt = self._dealt(new)
        if not self.spark.catalog.tableExists(self.name):
            return insert_ignore(dealt.limit(0), dealt, self.KEYS, order)
        years = [r[0] for r in new.select(F.year("timestamp")).distinct().collect()]  # a row a year
        old = self.table().filter(F.col("obs_year").isin(years))
        return insert_ignore(old, dealt, self.KEYS, order, "merge")

    def insert(self, new: DataFrame, order: list[str], keep: list[str] = ()) -> None:
        """Insert or ignore. The table's columns are those of the first insert, without those of ``order`` that are neither keys nor in ``keep``."""
        new = Scratch(self.spark, "insert").write(new, "new")  # read more than once
        there = self.spark.catalog.tableExists(self.name)
        with place_is_enough(self.spark):
            found = self.fresh(new, order)
            if there:
                found = add_missing_columns(found, self.table().schema).select(*self.table().columns)
            else:
                found = found.drop(*(c for c in order if c not in self.KEYS and c not in keep))
            writer = found.write.mode("append").format("parquet").partitionBy("obs_year").option("path", self.path)
            writer.bucketBy(self.buckets, "place").sortBy("place", "timestamp").saveAsTable(self.name)


@contextmanager
def place_is_enough(spark: SparkSession) -> Iterator[None]:
    """Joins planned meanwhile may meet rows that are dealt by some of the join's keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, False)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def upsert_samples(spark: SparkSession, new: DataFrame, path: str, order: list[str]) -> None:
    """Upsert by timestamp; columns that the table lacks are added.

    The table is partitioned by day (``sample_date``), and only the days of the batch are read and replaced.
    """
    day = F.to_date("timestamp")
    scratch = Scratch(spark, "upsert")
    new = scratch.write(new, "new")  # read more than once
    if exists(spark, path):
        old = add_missing_columns(spark.read.option("mergeSchema", True).parquet(path).drop("sample_date"), new.schema)
        days = [r[0] for r in new.select(day).distinct().collect()]  # a row a day
        old = old.filter(day.isin(days))
    else:
        old = new.limit(0)
    update = [c for c in new.columns if c not in ("timestamp", *order)]
    merged = upsert(old, new, ["timestamp"], order, update).withColumn("sample_date", day)
    merged = scratch.write(merged, "merged")  # as it reads what it replaces
    dealt = merged.repartition("sample_date").sortWithinPartitions("sample_date", "timestamp")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_date").parquet(path)
    scratch.drop()


def truncate(spark: SparkSession, path: str) -> None:
    """Empty the table and keep its columns."""
    replace_table(spark, spark.read.parquet(path).limit(0), path)


def snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for station lists and mappings."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def health_row(spark: SparkSession, status: str) -> DataFrame:
    return spark.range(1).select(F.expr("uuid()").alias("id"), F.current_timestamp().alias("check_time"), F.lit(status).alias("status"))


def health_probe(spark: SparkSession, checks: DataFrame, key: str) -> DataFrame:
    """One row: whether the engine answers, and the first of the ``checks`` by ``key`` (nulls where there is none)."""
    alive = spark.sql("SELECT version() IS NOT NULL AS alive")
    return alive.join(F.broadcast(checks.orderBy(key).limit(1)), F.lit(True), "left")  # one row each


def create_planned(spark: SparkSession, database: str) -> None:
    """The planned tables, where they aren't there yet."""
    for name, columns in PLANNED.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
