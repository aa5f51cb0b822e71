"""Bias correction by quantile mapping, per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.functions.et0 import known
from pluvia.operators.ranks import BEFORE, N, TOTAL, quantiles, with_ranks
from pluvia.operators.skew import skewed_left
from pluvia.session import Scratch

KNOTS, MIN_PAIRS = 100, 100


def levels(knots: int = KNOTS) -> list[float]:
    return [i / (knots - 1) for i in range(knots)]


def complete(pairs: DataFrame, obs: str, sim: str) -> DataFrame:
    """Rows in which both values are known (neither null nor NaN)."""
    return pairs.filter(known(F.col(obs)).isNotNull() & known(F.col(sim)).isNotNull())


def fit(pairs: DataFrame, obs: str, sim: str, by: list[str], knots: int = KNOTS, period: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """Per group ``xp`` and ``fp``: exact linear quantiles of sim and obs; null below ``MIN_PAIRS`` complete pairs.

    ``period`` (a time, its first and its last value) names the base period that the quantiles are taken over.
    """
    if period is not None:
        pairs = pairs.filter(period[0].between(period[1], period[2]))
    both = complete(pairs, obs, sim).select(*by, F.col(sim).alias("__sim"), F.col(obs).alias("__obs"))
    both = Scratch(pairs.sparkSession, "qm-pairs").write(both, "both")  # what made the pairs runs once
    return _joined(quantiles(both, by, "__sim", knots, "n_pairs", "xp"), quantiles(both, by, "__obs", knots, "__same", "fp"), by, MIN_PAIRS)


def _joined(xp: DataFrame, fp: DataFrame, by: list[str], least: int) -> DataFrame:
    """A row per group with both lists of quantiles, null below ``least`` pairs; without groups always one row."""
    enough = F.col("n_pairs") >= least
    if by:
        same = [xp[c].eqNullSafe(fp[c]) for c in by]
        joined = xp.join(fp.drop("__same"), same).select(*[xp[c] for c in by], "n_pairs", "xp", "fp")
    else:
        joined = xp.crossJoin(fp.drop("__same"))  # one row each, or none
        none = xp.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_pairs"), *[F.lit(None).cast("array<double>").alias(c) for c in ("xp", "fp")])
        joined = joined.unionByName(none).orderBy(F.col("n_pairs").desc()).limit(1)
    return joined.select(*by, "n_pairs", *[F.when(enough, F.col(c)).alias(c) for c in ("xp", "fp")])


def apply(pairs: DataFrame, fitted: DataFrame, sim: str, by: list[str], out: str = "corrected", knots: int = KNOTS) -> DataFrame:
    """All rows of ``pairs`` with the corrected value (null where the group's fit is missing).

    Piecewise linear through (xp, fp) and constant beyond the ends; the place among the knots is found once a row, by
    halving. ``fitted`` has a row per group; without groups it is one row and is broadcast, else groups of many rows are.
    """
    x = known(F.col(sim).cast("double"))
    fits = fitted.select(*by, F.col("n_pairs").alias("__n"), F.col("xp").alias("__xp"), F.col("fp").alias("__fp"))
    fits = Scratch(pairs.sparkSession, "qm-fit").write(fits, "fits")  # the fit runs once
    total = (fits.agg(F.sum("__n")).first()[0] or 0) if by else 0
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(knots.bit_length()))])
    before = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get("__xp", at + step - 1) <= x, at + step).otherwise(at))  # knots at or below x
    joined = skewed_left(pairs, fits, by, "__n", total).withColumn("__j", before)
    at = F.col("__j")
    ends = F.array(F.get("__xp", at - 1), F.get("__xp", at), F.get("__fp", at - 1), F.get("__fp", at))
    joined = joined.withColumn("__k", F.when(at.between(1, knots - 1), ends))
    left, right, low, high = (F.get("__k", F.lit(i)) for i in range(4))
    inside = low + (high - low) / (right - left) * (x - left)
    value = F.when(at == 0, F.get("__fp", F.lit(0))).when(at >= knots, F.get("__fp", F.lit(knots - 1))).otherwise(inside)
    return joined.withColumn(out, F.when(x.isNotNull() & F.col("__xp").isNotNull(), value)).drop("__xp", "__fp", "__n", "__j", "__k")


def wet_days(pairs: DataFrame, obs: str, sim: str, by: list[str], order: str, least: float = 0.0) -> DataFrame:
    """``pairs`` with ``wet``: as many simulated days of each group as were observed above ``least`` in its complete pairs.

    Those of the largest simulated values are wet; of days with equal values at the edge, the first by ``order``, which
    should be unique in a group. Null where a value or the group is missing. No group is gathered: ranks come from range sorts.
    """
    full = known(F.col(obs)).isNotNull() & known(F.col(sim)).isNotNull()
    scratch = Scratch(pairs.sparkSession, "wet-days")
    rows = pairs.withColumn("__x", F.when(full, F.col(sim).cast("double")))
    ranked = scratch.write(with_ranks(rows, by, "__x"), "ranked")
    counts = ranked.filter("__x IS NOT NULL").groupBy(*by).agg(F.count_if(F.col(obs) > least).alias("__wet"), F.count("*").alias("__rows"))
    counts = scratch.write(counts, "counts")
    total = counts.agg(F.sum("__rows")).first()[0] or 0
    rows = skewed_left(ranked, counts, by, "__rows", total)
    above = F.col(TOTAL) - F.col(BEFORE) - F.col(N)
    rows = rows.withColumn("__room", F.col("__wet") - above)
    edge = (F.col("__room") > 0) & (F.col("__room") < F.col(N))
    rows = scratch.write(rows.withColumn("__edge", F.when(edge, F.col(order))).drop(N, BEFORE, TOTAL, "__rows"), "rows")
    rows = with_ranks(rows, by, "__edge")
    wet = F.when(F.col("__edge").isNotNull(), F.col(BEFORE) < F.col("__room")).otherwise(F.col("__room") > 0)
    return rows.withColumn("wet", F.when(F.col("__x").isNotNull(), wet)).drop("__x", "__wet", "__room", "__edge", N, BEFORE, TOTAL)


def precipitation(
    pairs: DataFrame, obs: str, sim: str, by: list[str], order: str, least: float = 0.0, out: str = "corrected", knots: int = KNOTS, enough: int = MIN_PAIRS
) -> DataFrame:
    """``pairs`` with the corrected precipitation ``out``: a mass at zero, then quantiles of the wet days.

    First the share of wet days is matched (:func:`wet_days`); dry days become 0. Wet days are mapped from the quantiles of
    the simulated to those of the observed wet days, where a group has ``enough`` of them; else the result is null.
    """
    scratch = Scratch(pairs.sparkSession, "precipitation")
    rows = scratch.write(wet_days(pairs, obs, sim, by, order, least).withColumnRenamed("wet", "__is_wet"), "rows")
    wet_sim = rows.filter("__is_wet").select(*by, F.col(sim).cast("double").alias("__sim"))
    wet_obs = rows.filter(F.col("__is_wet").isNotNull() & (F.col(obs) > least)).select(*by, F.col(obs).cast("double").alias("__obs"))
    fitted = _joined(quantiles(wet_sim, by, "__sim", knots, "n_pairs", "xp"), quantiles(wet_obs, by, "__obs", knots, "__same", "fp"), by, enough)
    mapped = apply(rows, fitted, sim, by, out, knots)
    return mapped.withColumn(out, F.when(F.col("__is_wet"), F.col(out)).when(~F.col("__is_wet"), F.when(F.col(out).isNotNull(), F.lit(0.0)))).drop("__is_wet")


def metrics(pairs: DataFrame, obs: str, before: str, after: str, by: list[str]) -> DataFrame:
    """Bias, RMSE, mean absolute error and coefficient of determination of both columns against ``obs``; missing pairs
    are skipped."""
    found = []
    for name, column in (("before", before), ("after", after)):
        gap = known(F.col(column) - F.col(obs))
        spread = F.var_pop(F.when(gap.isNotNull(), F.col(obs)))
        found += [
            F.avg(gap).alias(f"bias_{name}"), F.sqrt(F.avg(gap * gap)).alias(f"rmse_{name}"), F.avg(F.abs(gap)).alias(f"mae_{name}"),
            (1 - F.try_divide(F.avg(gap * gap), spread)).alias(f"r2_{name}"),
        ]
    return pairs.groupBy(*by).agg(*found)


def scaled(pairs: DataFrame, obs: str, sim: str, by: list[str], variance: bool = False, out: str = "corrected") -> DataFrame:
    """Linear scaling (shift to the observed mean), with ``variance`` also to the observed standard deviation."""
    moments = complete(pairs, obs, sim).groupBy(*by).agg(
        F.count("*").alias("__n_pairs"), F.avg(obs).alias("__m_obs"), F.avg(sim).alias("__m_sim"), F.stddev_pop(obs).alias("__s_obs"), F.stddev_pop(sim).alias("__s_sim")
    )
    joined = skewed_left(pairs, moments, by, "__n_pairs", moments.agg(F.sum("__n_pairs")).first()[0] or 0) if by else pairs.crossJoin(F.broadcast(moments))
    gain = F.try_divide("__s_obs", "__s_sim") if variance else F.lit(1.0)
    return joined.withColumn(out, F.col("__m_obs") + (F.col(sim) - F.col("__m_sim")) * gain).drop("__n_pairs", "__m_obs", "__m_sim", "__s_obs", "__s_sim")
