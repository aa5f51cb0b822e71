"""Daily refresh of the drought index from kept counts.

Ranks over a whole series change with every new value. The kept table has a row per point (and calendar month, if asked
for) and distinct balance: the instants that had it, how many smaller ones there are (``before``) and how many in all
(``total``). A day's values are merged into it: counts of larger balances go up, instants of equal ones are added, new
balances get their count from the sums of the smaller ones. No series is sorted, and the table, bucketed by point, is read
where it lies; what is shuffled is the day.

Versions are written whole beside each other, and the last whole one holds, so a merge that dies changes nothing and is
made again. A point's rows are bounded by its instants, whatever point has most.

Defined results: a balance is null until ``scale`` values are there, or where one of them is missing; such rows are kept
and get no index. New rows must come after all known ones of their point; a null point is a point of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvia.functions.et0 import known
from pluvia.functions.normal import norm_ppf
from pluvia.functions.spei import CLIP, MIN_SAMPLE, clip, rolling_sum
from pluvia.session import Scratch, exists
from pluvia.sinks import place_is_enough

GROUP = ["point", "season"]


class SpeiTable:
    """Kept state of the index of (point, t, precip, et0) series in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, scale: int = 3, by_month: bool = False, buckets: int = 16):
        self.spark, self.path, self.scale, self.by_month, self.buckets = spark, path.rstrip("/"), scale, by_month, buckets

    def _files(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the last whole version, 0 for none. The tail is written last."""
        at, files = self._files("")
        found = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
        return max((int(name[5:]) for name in found if name.startswith("tail-") and exists(self.spark, f"{self.path}/{name}/_SUCCESS")), default=0)

    def _table(self, version: int) -> str:
        return f"spei_{abs(hash(self.path)):x}_{version}"

    def counted(self) -> DataFrame:
        """point, season, value, ts, before and total of the version that holds, in place by bucket."""
        version = self.version()
        name = self._table(version)
        if not self.spark.catalog.tableExists(name):
            kind = self.spark.read.parquet(f"{self.path}/counted-{version}").schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (point) INTO {self.buckets} BUCKETS LOCATION '{self.path}/counted-{version}'")
        return self.spark.table(name)

    def _write(self, counted: DataFrame, tail: DataFrame, version: int) -> None:
        for name in (f"counted-{version}", f"tail-{version}"):  # of an attempt that died
            at, files = self._files(name)
            files.delete(at, True)
        name = self._table(version)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        dealt = counted.select(*GROUP, "value", "ts", "before", "total")
        dealt.write.format("parquet").option("path", f"{self.path}/counted-{version}").bucketBy(self.buckets, "point").saveAsTable(name)
        tail.select("point", "t", "water").write.parquet(f"{self.path}/tail-{version}")
        if version > 2:  # the one before stays for readers that are at work
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(version - 2)}")
            for old in (f"counted-{version - 2}", f"tail-{version - 2}"):
                at, files = self._files(old)
                files.delete(at, True)

    def _balances(self, rows: DataFrame) -> DataFrame:
        value = rolling_sum(F.col("water"), Window.partitionBy("point").orderBy("t"), self.scale)
        season = F.month("t") if self.by_month else F.lit(0)
        return rows.withColumn("value", value + 0.0).withColumn("season", season)  # the sum makes one of both zeros

    def _tail(self, rows: DataFrame) -> DataFrame:
        last = Window.partitionBy("point").orderBy(F.col("t").desc())
        return rows.withColumn("_nth", F.row_number().over(last)).filter(F.col("_nth") < self.scale).drop("_nth")

    @staticmethod
    def _water(series: DataFrame) -> DataFrame:
        return series.select("point", "t", (known(F.col("precip").cast("double")) - known(F.col("et0").cast("double"))).alias("water"))

    def create(self, series: DataFrame) -> None:
        """The first version, by one sort of each point's values."""
        scratch = Scratch(self.spark, "spei")
        rows = scratch.write(self._balances(self._water(series).repartition(self.buckets, "point")), "rows")
        counted = rows.repartition(self.buckets, "point").groupBy(*GROUP, "value").agg(F.array_sort(F.collect_list("t")).alias("ts"))
        n = F.when(F.col("value").isNotNull(), F.size("ts")).otherwise(0)
        of = Window.partitionBy(*GROUP)
        before = F.coalesce(F.sum(n).over(of.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counted = counted.withColumn("before", before).withColumn("total", F.sum(n).over(of))
        self._write(counted, self._tail(rows), 1)
        scratch.drop()

    def merged(self, day: DataFrame) -> DataFrame:
        """The counts with a day's balances (point, season, value, t)."""
        counted = self.counted()
        listed = day.groupBy(*GROUP).agg(F.collect_list(F.struct("value", "t")).alias("day")).withColumnsRenamed({c: f"_{c}" for c in GROUP})
        same_group = F.col("point").eqNullSafe(F.col("_point")) & (F.col("season") == F.col("_season"))

        def among(test) -> Column:
            return F.filter(F.coalesce("day", F.array()), test)

        more = F.size(among(lambda d: d["value"].isNotNull()))
        old = counted.join(listed, same_group, "left").select(
            *GROUP, "value", F.concat("ts", F.transform(among(lambda d: d["value"].eqNullSafe(F.col("value"))), lambda d: d["t"])).alias("ts"),
            (F.col("before") + F.size(among(lambda d: d["value"] < F.col("value")))).alias("before"), (F.col("total") + more).alias("total"),
        )
        # balances that are new: what is smaller is added up, group by group
        each = day.groupBy(*GROUP, "value").agg(F.array_sort(F.collect_list("t")).alias("ts"))
        each = each.join(listed, same_group).select(*GROUP, "value", "ts", F.size(F.filter("day", lambda d: d["value"] < F.col("value"))).alias("day_before"), F.size(F.filter("day", lambda d: d["value"].isNotNull())).alias("more"))
        asked = each.withColumnsRenamed({"point": "_point", "season": "_season", "value": "x", "ts": "new_ts"})
        n = F.when(F.col("value").isNotNull(), F.size("ts")).otherwise(0)
        sums = [F.coalesce(F.sum(F.when(F.col("value") < F.col("x"), n)), F.lit(0)).alias("smaller"), F.coalesce(F.max("total"), F.lit(0)).alias("total"), F.max(F.col("season").isNotNull() & F.col("value").eqNullSafe(F.col("x"))).alias("there")]
        found = asked.join(counted, same_group, "left").groupBy("_point", "_season", "x", "new_ts", "day_before", "more").agg(*sums).filter("NOT there")
        new = found.select(
            F.col("_point").alias("point"), F.col("_season").alias("season"), F.col("x").alias("value"), F.col("new_ts").alias("ts"), (F.col("smaller") + F.col("day_before")).alias("before"), (F.col("total") + F.col("more")).alias("total")
        )
        return old.unionByName(new)

    def merge(self, new: DataFrame) -> None:
        """Add rows (point, t, precip, et0) that come after all known ones of their points."""
        version = self.version()
        if not version:
            return self.create(new)
        scratch = Scratch(self.spark, "spei")
        tail = self.spark.read.parquet(f"{self.path}/tail-{version}")
        fresh = self._water(new).withColumn("fresh", F.lit(True))
        rows = scratch.write(self._balances(tail.withColumn("fresh", F.lit(False)).unionByName(fresh)), "rows")  # the day, and a few rows a point
        with place_is_enough(self.spark):
            self._write(self.merged(rows.filter("fresh").select(*GROUP, "value", "t")).repartition(self.buckets, "point"), self._tail(rows), version + 1)
        scratch.drop()

    def values(self) -> DataFrame:
        """point, t, balance, p and spei of all rows."""
        n = F.col("total")
        p = F.when(F.col("value").isNotNull() & (n >= MIN_SAMPLE), (F.col("before") + 1 + (F.size("ts") - 1) / 2 - 0.35) / n)
        rows = self.counted().select("point", F.explode("ts").alias("t"), F.col("value").alias("balance"), p.alias("p"))
        return rows.withColumn("spei", clip(norm_ppf(F.col("p")), -CLIP, CLIP))
