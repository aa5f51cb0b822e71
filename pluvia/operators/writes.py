"""Keyed writes as DataFrame transforms, and table writers over them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.session import Scratch


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], how: str | None = None) -> DataFrame:
    """Rows of ``new`` to append: the first by ``order`` of each key that ``old`` doesn't have. ``how`` hints at the join."""
    first = Window.partitionBy(*keys).orderBy(*order)
    fresh = new.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")
    known = old.select(*keys)
    return fresh.join(known.hint(how) if how else known, keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], update: list[str]) -> DataFrame:
    """The table after an upsert: of ``new`` the last row of each key replaces the ``update`` columns of the old one."""
    last = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    latest = new.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth")
    renamed = latest.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_hit"))
    joined = old.withColumn("_old", F.lit(True)).join(renamed, keys, "full_outer")
    columns = []
    for c in old.columns:
        if c in keys:
            columns.append(F.col(c))
        elif c in new.columns:
            take = F.col("_hit").isNotNull() & (F.col("_old").isNull() | F.lit(c in update))
            columns.append(F.when(take, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return joined.select(*columns)


def add_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema`` that it lacks, null."""
    missing = [f for f in schema if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def with_ids(new: DataFrame, start: int, order: list[str]) -> DataFrame:
    """``new`` with ids from ``start`` + 1 on in the given order: sorted by range, counted per part, then numbered."""
    dealt = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    # written, so that a row's part and place are the same when counted and when numbered
    dealt = Scratch(new.sparkSession, "ids").write(dealt.withColumn("_row", F.monotonically_increasing_id()), "dealt")
    sizes = {r._part: r.n for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row per partition
    before, offsets = start, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    if not offsets:
        return new.withColumn("id", F.lit(0).cast("long"))
    base = F.broadcast(new.sparkSession.createDataFrame(offsets, "_part int, _before long"))
    joined = dealt.join(base, "_part")
    return joined.withColumn("id", F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_row", "_before")


def write_observations(df: DataFrame, path: str, ts: str = "timestamp", mode: str = "append", files_a_year: int = 16) -> None:
    """Parquet partitioned by year and sorted by place and time, so that year filters prune files.

    A year's places are dealt to ``files_a_year`` tasks and files.
    """
    dated = df.withColumn("obs_year", F.year(ts)).withColumn("_deal", F.pmod(F.xxhash64("latitude", "longitude"), F.lit(files_a_year)))
    dealt = dated.repartition("obs_year", "_deal").sortWithinPartitions("obs_year", "latitude", "longitude", ts)
    dealt.drop("_deal").write.mode(mode).partitionBy("obs_year").parquet(path)


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replace a Parquet folder by ``df`` (which may read it): written beside it, then moved into place.

    The old folder is moved aside first and deleted last, so at every moment one of the two is whole; a folder that an
    interrupted call left aside is put back by the next one.
    """
    path = path.rstrip("/")
    put_back(spark, path)
    spare = f"{path}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(spare)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    target, source, aside = (fs_path(p) for p in (path, spare, f"{path}-replaced"))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        files.rename(target, aside)
    files.rename(source, target)
    files.delete(aside, True)
    spark.catalog.refreshByPath(path)


def put_back(spark: SparkSession, path: str) -> None:
    """Undo what a :func:`replace_table` that was interrupted between its two moves left."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    target, aside = fs_path(path), fs_path(f"{path}-replaced")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(aside):
        if files.exists(target):
            files.delete(aside, True)
        else:
            files.rename(aside, target)
