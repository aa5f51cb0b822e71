"""Coverage, completeness and data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.text import share_percent
from pluvia.operators.ranks import quantiles
from pluvia.operators.skew import skewed_left
from pluvia.session import Scratch

COMPLETE_ABOVE = 8000


def grid_stats(obs: DataFrame, ts: str = "timestamp", point: tuple[str, str] = ("latitude", "longitude")) -> DataFrame:
    """total_records, min_date, max_date and grid_points in one pass; a point counts even if a coordinate is null."""
    return obs.agg(
        F.count("*").alias("total_records"), F.min(ts).alias("min_date"), F.max(ts).alias("max_date"), F.count_distinct(F.struct(*point)).alias("grid_points")
    )


def year_coverage(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.year(ts).alias("year")).agg(F.count("*").alias("count")).orderBy("year")


def in_year(df: DataFrame, year: int, ts: str) -> DataFrame:
    """Rows of a year: by the partition column ``obs_year`` where there is one, which prunes files, else by a range."""
    if "obs_year" in df.columns:
        return df.filter(F.col("obs_year") == year)
    return df.filter((F.col(ts) >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (F.col(ts) < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))


def rows_per_location(df: DataFrame, year: int, ts: str, point: list[str]) -> DataFrame:
    found = in_year(df, year, ts).agg(F.count_distinct(F.struct(*point)).alias("locations"), F.count("*").alias("total_rows"))
    return found.withColumn("rows_per_location", F.try_divide(F.col("total_rows").cast("double"), F.col("locations").cast("double")))


def point_year_detail(df: DataFrame, year: int, ts: str, point: list[str], most: int = 5) -> DataFrame:
    """First, last and count of each point's rows in a year, for the first ``most`` points."""
    found = in_year(df, year, ts).groupBy(*point).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("cnt"))
    return found.orderBy(*point).limit(most)


def summary(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Counts of the rows that meet each check, and the total, in one pass."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(check).alias(name) for name, check in checks.items()])


def percents(counts: DataFrame, names: list[str]) -> DataFrame:
    return counts.select(*[share_percent(F.col(n), F.col("total")).alias(f"{n}_pct") for n in names])


def nulls_by_year(df: DataFrame, ts: str, column: str) -> DataFrame:
    return df.groupBy(F.year(ts).alias("year")).agg(
        F.count("*").alias("total"), F.count(column).alias("known"), F.count_if(F.col(column).isNull()).alias("missing")
    )


def completeness(count: Column, complete_above: int = COMPLETE_ABOVE) -> Column:
    return F.when(count > complete_above, "complete").when(count > 0, "partial").otherwise("missing")


def point_year_completeness(df: DataFrame, points: DataFrame, years: list[int], ts: str, point: list[str], complete_above: int = COMPLETE_ABOVE) -> DataFrame:
    """Rows and class of every expected point and year, those without rows too."""
    expected = points.select(*point).distinct().withColumn("year", F.explode(F.array(*map(F.lit, years))))
    counted = df.groupBy(*point, F.year(ts).alias("year")).agg(F.count("*").alias("n"))
    joined = expected.join(counted, [*point, "year"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("status", completeness(F.col("n"), complete_above))


def missing_point_years(df: DataFrame, points: DataFrame, years: list[int], ts: str, point: list[str]) -> DataFrame:
    """Expected points and years without any row."""
    expected = points.select(*point).distinct().withColumn("year", F.explode(F.array(*map(F.lit, years))))
    return expected.join(df.select(*point, F.year(ts).alias("year")), [*point, "year"], "left_anti")


def physical_range(value: Column, low: float, high: float) -> Column:
    """Null outside a closed range."""
    return F.when(value.between(low, high), value)


def iqr_outliers(df: DataFrame, value: str, by: list[str], factor: float = 1.5) -> DataFrame:
    """``df`` with ``is_outlier``: beyond ``factor`` interquartile ranges of the group's quartiles."""
    bounds = Scratch(df.sparkSession, "quartiles").write(quantiles(df, by, value, [0.25, 0.75], "__total", "__q"), "bounds")  # read more than once
    joined = skewed_left(df, bounds, by, "__total", bounds.agg(F.sum("__total")).first()[0] or 0)
    low, high = F.get("__q", F.lit(0)), F.get("__q", F.lit(1))
    width = (high - low) * factor
    return joined.withColumn("is_outlier", (F.col(value) < low - width) | (F.col(value) > high + width)).drop("__q", "__total")


def fill_gaps(df: DataFrame, value: str, by: list[str], order: str, most: int = 3) -> DataFrame:
    """``df`` with gaps of fewer than ``most`` rows between known values filled by a straight line over row positions."""
    w = Window.partitionBy(*by).orderBy(order)
    frame = df.withColumn("__at", F.row_number().over(w))
    frame = frame.withColumn("__known", F.when(F.col(value).isNotNull(), F.struct(F.col("__at").alias("at"), F.col(value).alias("v"))))
    before = F.last("__known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__known", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    frame = frame.withColumn("__b", before).withColumn("__a", after)
    gap = F.col("__a.at") - F.col("__b.at")
    line = F.col("__b.v") + (F.col("__a.v") - F.col("__b.v")) * (F.col("__at") - F.col("__b.at")) / gap
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when((gap > 0) & (gap - 1 < most), line)
    return frame.withColumn(f"{value}_filled", filled).drop("__at", "__known", "__b", "__a")


def neighbour_fill(df: DataFrame, neighbours: DataFrame, point: str, ts: str, value: str) -> DataFrame:
    """``df`` with missing values estimated by linear regression on the neighbour's values of the same time.

    ``neighbours`` has a row per point: ``point`` and ``neighbour``. The line is fitted per point over the times that both
    have; without a neighbour, a value of it or a line the value stays missing. Filled values are in ``<value>_filled``.
    """
    other = df.select(F.col(point).alias("__neighbour"), F.col(ts).alias("__ts"), F.col(value).alias("__other"))
    pairs = df.join(neighbours.select(F.col(point), F.col("neighbour").alias("__neighbour")), point, "left")
    pairs = pairs.join(other, (pairs["__neighbour"] == other["__neighbour"]) & (F.col(ts) == F.col("__ts")), "left").drop(other["__neighbour"]).drop("__neighbour", "__ts")
    lines = pairs.groupBy(point).agg(F.count("*").alias("__n"), F.regr_slope(value, "__other").alias("__slope"), F.regr_intercept(value, "__other").alias("__base"))
    total = lines.agg(F.sum("__n")).first()[0] or 0
    filled = skewed_left(pairs, lines, [point], "__n", total)
    return filled.withColumn(f"{value}_filled", F.coalesce(F.col(value), F.col("__base") + F.col("__slope") * F.col("__other"))).drop("__n", "__slope", "__base", "__other")
