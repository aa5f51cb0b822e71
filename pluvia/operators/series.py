"""Orderings, windows and reshaping of time series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvia.functions.et0 import known
from pluvia.functions.text import white_fields
from pluvia.operators.writes import with_ids


def recent(df: DataFrame, key: str, k: int = 50) -> DataFrame:
    """The k rows of the largest keys; a top-k, not a sort."""
    return df.orderBy(F.col(key).desc_nulls_last()).limit(k)


def head(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    return df.orderBy(F.col(key).asc_nulls_last()).limit(k)


def first_point_series(df: DataFrame, key: str, point: list[str], ts: str, k: int = 100) -> DataFrame:
    """The first k rows by time of the point that the row of the least key has (one scalar subquery for all columns)."""
    first = df.agg(F.min(F.struct(key, *point)).alias("first"))
    same = [df[c] == F.col(f"first.{c}") for c in point]
    joined = df.crossJoin(F.broadcast(first))  # one row
    for s in same:
        joined = joined.filter(s)
    return joined.drop("first").orderBy(ts, key).limit(k)


def chunks(df: DataFrame, order: list[str], size: int = 10, start: int = 0) -> DataFrame:
    """``df`` with its position and chunk number in the given order, from position ``start`` on.

    Positions are numbered part by part of a range sort, so no task has all rows.
    """
    numbered = with_ids(df, -1, order).withColumnRenamed("id", "seq")
    return numbered.filter(F.col("seq") >= start).withColumn("chunk", F.floor(F.col("seq") / size))


def time_axis(spark: SparkSession, start: str, end: str, step: str) -> DataFrame:
    """Instants from ``start`` on, ``end`` left out."""
    low, high = f"timestamp_ntz'{start}'", f"timestamp_ntz'{end}'"
    last = f"greatest({low}, {high} - interval {step})"  # a sequence must not run backwards
    return spark.range(1).selectExpr(f"explode(sequence({low}, {last}, interval {step})) AS ts").filter(f"ts < {high}")


def daily_mean(df: DataFrame, ts: str, value: str, by: list[str]) -> DataFrame:
    """Mean of the known values of each day; days without any are null."""
    return df.groupBy(*by, F.to_date(ts).alias("date")).agg(F.avg(known(F.col(value).cast("double"))).alias(value))


def monthly_sum(df: DataFrame, ts: str, values: list[str], by: list[str]) -> DataFrame:
    return df.groupBy(*by, F.date_trunc("month", ts).cast("timestamp_ntz").alias("month")).agg(*[F.sum(v).alias(v) for v in values])


def ecdf(value: Column, by: list[Column | str]) -> Column:
    """Share of the group's known values up to this one; null for missing values."""
    return F.when(value.isNotNull(), F.cume_dist().over(Window.partitionBy(*by, value.isNull()).orderBy(value)))


def zip_explode(df: DataFrame, arrays: list[str], keep: list[str] = ()) -> DataFrame:
    """A row per position of parallel arrays; a missing array counts as empty, shorter ones are padded by nulls."""
    zipped = F.arrays_zip(*[F.coalesce(F.col(a), F.array()).alias(a) for a in arrays])
    return df.select(*keep, F.posexplode(zipped).alias("pos", "_row")).select(*keep, "pos", *[F.col(f"_row.{a}").alias(a) for a in arrays])


def lags(df: DataFrame, value: str, by: list[str], order: str, upto: int = 12) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.select("*", *[F.lag(value, k).over(w).alias(f"{value}_lag{k}") for k in range(1, upto + 1)])


def rolling_stats(df: DataFrame, value: str, by: list[str], order: str, widths: tuple[int, ...] = (3, 6)) -> DataFrame:
    """Mean, population variance and maximum over full trailing windows."""
    w = Window.partitionBy(*by).orderBy(order)
    made = []
    for k in widths:
        frame = w.rowsBetween(-(k - 1), 0)
        full = F.count(value).over(frame) == k
        for name, f in (("mean", F.avg), ("var", F.var_pop), ("max", F.max)):
            made.append(F.when(full, f(value).over(frame)).alias(f"{value}_{name}{k}"))
    return df.select("*", *made)


def cyclical_month(ts: Column) -> tuple[Column, Column]:
    angle = F.month(ts) * (2 * math.pi / 12)
    return F.sin(angle), F.cos(angle)


def one_hot_month(ts: Column) -> list[Column]:
    """Twelve columns, 1 for the month of ``ts`` and 0 for the others; null for a missing time."""
    return [(F.month(ts) == k).cast("int").alias(f"month_{k}") for k in range(1, 13)]


def what_if(df: DataFrame, precip: str, temp: str, precip_change: float, warming: float) -> DataFrame:
    """Perturbed copies of the drivers: precipitation times (1 + change), temperature plus warming."""
    return df.withColumn(precip, F.col(precip) * (1 + precip_change)).withColumn(temp, F.col(temp) + warming)


def point_year_matrix(df: DataFrame, point: str, ts: str, years: list[int]) -> DataFrame:
    """Rows per point and year as a matrix; 0 where there are none."""
    counted = df.groupBy(point).pivot("_year", years) if "_year" in df.columns else df.withColumn("_year", F.year(ts)).groupBy(point).pivot("_year", years)
    table = counted.agg(F.count(F.lit(1)))
    return table.select(point, *[F.coalesce(F.col(str(y)), F.lit(0)).alias(f"y{y}") for y in years])


def tokens(df: DataFrame, line: str, names: list[str]) -> DataFrame:
    """The first fields of white-space separated lines under the given names."""
    fields = white_fields(F.col(line))
    return df.select("*", *[F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(names)])
