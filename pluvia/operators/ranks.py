"""Ranks and exact quantiles of groups of any size, by a range sort and prefix counts.

A group is never gathered in one task: equal values are counted first, the distinct ones are sorted by range, each part
counts its own, and the parts' sums (a row per part and group in it) give what stands before a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.operators.skew import skewed_left
from pluvia.session import Scratch


# Inner columns begin with two underscores, so that they don't clash with those of a caller; results hand over these three.
N, BEFORE, TOTAL = "__n", "__before", "__total"


def value_ranks(df: DataFrame, by: list[str], value: str, label: str = "ranks") -> DataFrame:
    """A row per group and known value: ``__n`` rows have it, ``__before`` have a smaller one, ``__total`` have any."""
    spark = df.sparkSession
    scratch = Scratch(spark, label)
    keys = [*by, value]
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias(N))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, so that a row's part is the same for all that follows
    dealt = scratch.write(counted.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()), "dealt")
    sums = dealt.groupBy(*by, "__part").agg(F.sum(N).alias("__sum"))
    order = Window.partitionBy(*by)
    earlier = F.coalesce(F.sum("__sum").over(order.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__of"), earlier.alias("__earlier"), F.sum("__sum").over(order).alias(TOTAL))
    inside = F.sum(N).over(Window.partitionBy(*by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranked = dealt.withColumn("__inside", F.coalesce(inside, F.lit(0)))
    same = F.col("__part") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return ranked.join(offsets, same).select(*keys, N, (F.col("__earlier") + F.col("__inside")).alias(BEFORE), TOTAL)


def with_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``df`` with the columns of :func:`value_ranks` of each row's value; null for missing values. Hot values are split."""
    ranks = Scratch(df.sparkSession, "value-ranks").write(value_ranks(df, by, value), "ranks")
    return skewed_left(df, ranks, [*by, value], N, ranks.agg(F.sum(N)).first()[0] or 0)


def average_rank() -> Column:
    """Rank over the columns of :func:`with_ranks`, ties sharing their mean rank."""
    return F.col(BEFORE) + 1 + (F.col(N) - 1) / 2


def ecdf() -> Column:
    """Share of the group's known values up to this one, over the columns of :func:`with_ranks`."""
    return (F.col(BEFORE) + F.col(N)) / F.col(TOTAL)


def quantiles(df: DataFrame, by: list[str], value: str, levels: int | list[float], total: str = "total", q: str = "q") -> DataFrame:
    """Per group ``total`` and ``q``, the exact quantiles at ``levels``, linear between neighbouring values.

    A number asks for so many evenly spaced levels from 0 to 1; which of them a value is a neighbour of follows from its
    rank by arithmetic.
    """
    first, last, most = F.col(BEFORE), F.col(BEFORE) + F.col(N) - 1, F.col(TOTAL) - 1
    place = lambda i, level: F.struct(i.cast("int").alias("i"), (level * most).alias("pos"))
    if isinstance(levels, int):
        steps = float(levels - 1)
        low = F.greatest(F.floor((first - 1) * steps / F.greatest(most, F.lit(1))), F.lit(0))
        high = F.least(F.ceil((last + 1) * steps / F.greatest(most, F.lit(1))), F.lit(levels - 1))
        low, high = F.when(most > 0, low).otherwise(0), F.when(most > 0, high).otherwise(levels - 1)
        at = F.when(low <= high, F.transform(F.sequence(low.cast("int"), high.cast("int")), lambda i: place(i, i / steps)))
    else:
        at = F.transform(F.array(*map(F.lit, levels)), lambda level, i: place(i, level))
    # the levels of which a row's value is the lower or the upper neighbour
    near = F.filter(at, lambda s: (F.floor(s.pos) <= last) & (F.ceil(s.pos) >= first))
    hit = value_ranks(df, by, value, "quantiles").select(*by, F.col(value).cast("double").alias("__v"), TOTAL, first.alias("__a"), last.alias("__b"), F.explode(near).alias("__s"))
    low, high = (F.max(F.when(f("__s.pos").between(F.col("__a"), F.col("__b")), F.col("__v"))) for f in (F.floor, F.ceil))
    ends = hit.groupBy(*by, TOTAL, F.col("__s.i").alias("__i"), F.col("__s.pos").alias("__pos")).agg(low.alias("__low"), high.alias("__high"))
    share = F.col("__pos") - F.floor("__pos")
    line = F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise((1 - share) * F.col("__low") + share * F.col("__high"))
    found = ends.groupBy(*by, TOTAL).agg(F.array_sort(F.collect_list(F.struct("__i", line.alias("__v")))).alias(q))  # a row per level
    return found.withColumn(q, F.transform(q, lambda s: s["__v"])).withColumnRenamed(TOTAL, total)
