"""Standardised precipitation-evapotranspiration index and drought classes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.et0 import known
from pluvia.functions.normal import norm_ppf

MIN_SAMPLE, CLIP = 30, 3.0
# Fixed classes: upper bound (inclusive but for the last) and name.
CLASSES = ((-2.0, "Extreme Drought"), (-1.5, "Severe Drought"), (-1.0, "Moderate Drought"), (-0.5, "Mild Drought"))


def rolling_sum(value: Column, order: Window, scale: int) -> Column:
    """Sum over ``scale`` rows up to this one; null unless all of them are there and known."""
    frame = order.rowsBetween(-(scale - 1), 0)
    return F.when(F.count(value).over(frame) == scale, F.sum(value).over(frame))


def average_rank(value: Column, by: list[Column | str]) -> Column:
    """Rank among the known values of the group, ties sharing their mean rank; null for missing values."""
    below = F.rank().over(Window.partitionBy(*by, value.isNull()).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.when(value.isNotNull(), below + (ties - 1) / 2)


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def spei(series: DataFrame, by: list[str], order: str, precip: str, et0: str, scale: int = 3, by_month: bool = False) -> DataFrame:
    """``series`` with ``balance`` (the rolling water balance), ``p`` and ``spei``.

    Ranks are taken over the whole series of a group (over the same calendar month of ``order`` with ``by_month``);
    fewer than ``MIN_SAMPLE`` known balances give null. Every window is partitioned by the group.
    """
    water = known(F.col(precip).cast("double")) - known(F.col(et0).cast("double"))
    frame = series.withColumn("balance", rolling_sum(water, Window.partitionBy(*by).orderBy(order), scale))
    group = [*by, F.month(order)] if by_month else list(by)
    n = F.count("balance").over(Window.partitionBy(*group))
    frame = frame.withColumn("p", F.when(n >= MIN_SAMPLE, (average_rank(F.col("balance"), group) - 0.35) / n))
    return frame.withColumn("spei", clip(norm_ppf(F.col("p")), -CLIP, CLIP))


def spei_log_logistic(series: DataFrame, by: list[str], order: str, precip: str, et0: str, scale: int = 3, by_month: bool = False) -> DataFrame:
    """Like :func:`spei`, but ``p`` is that of a three-parameter log-logistic distribution fitted to each group.

    The parameters come from probability-weighted moments (Vicente-Serrano et al. 2010); both gamma functions of the
    published formula stand in a product that the reflection formula gives as (pi / b) / sin(pi / b).
    """
    water = known(F.col(precip).cast("double")) - known(F.col(et0).cast("double"))
    frame = series.withColumn("balance", rolling_sum(water, Window.partitionBy(*by).orderBy(order), scale))
    group = [*by, F.month(order)] if by_month else list(by)
    whole = Window.partitionBy(*group)
    n = F.count("balance").over(whole)
    frame = frame.withColumn("_n", n).withColumn("_above", 1 - (average_rank(F.col("balance"), group) - 0.35) / n)
    for s in range(3):
        frame = frame.withColumn(f"_w{s}", F.avg(F.pow("_above", F.lit(float(s))) * F.col("balance")).over(whole))
    w0, w1, w2 = (F.col(f"_w{s}") for s in range(3))
    frame = frame.withColumn("_b", F.try_divide(2 * w1 - w0, 6 * w1 - w0 - 6 * w2))
    gammas = (math.pi / F.col("_b")) / F.sin(math.pi / F.col("_b"))
    frame = frame.withColumn("_a", (w0 - 2 * w1) * F.col("_b") / gammas).withColumn("_c", w0 - F.col("_a") * gammas)
    over = F.when(F.col("balance") > F.col("_c"), F.pow(F.col("_a") / (F.col("balance") - F.col("_c")), F.col("_b")))
    p = F.when(F.col("_n") >= MIN_SAMPLE, F.when(F.col("balance").isNotNull(), F.coalesce(1 / (1 + over), F.lit(0.0))))
    frame = frame.withColumn("p", clip(p, 1e-9, 1 - 1e-9))
    return frame.withColumn("spei", clip(norm_ppf(F.col("p")), -CLIP, CLIP)).drop("_n", "_above", "_w0", "_w1", "_w2", "_a", "_b", "_c")


def drought_level(index: Column) -> Column:
    """Class of an index value; missing is tested first, as a comparison with null would fall through."""
    level = F.when(index.isNull() | F.isnan(index), "Unknown")
    for bound, name in CLASSES:
        level = level.when(index <= bound, name)
    return level.when(index < 0.5, "Normal").otherwise("Wet")
