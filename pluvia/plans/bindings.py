"""How the driver's tables stand in for weather data, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.sources import table

OBS_SQL = """(SELECT event_id AS id, (32 + (user_id % 21) * 0.5)::DOUBLE AS latitude, (110 + (user_id % 27) * 0.5)::DOUBLE AS longitude, ts AS "timestamp",
    value / 20::DOUBLE AS temperature, 20::DOUBLE + value / 10::DOUBLE AS relative_humidity, value / 50::DOUBLE AS wind_speed,
    CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN 0::DOUBLE ELSE value * 2::DOUBLE END AS shortwave_radiation FROM events)"""
MONTHLY_SQL = """(SELECT 1 AS point, date_trunc('month', o_orderdate)::TIMESTAMP AS month, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS precip,
    sum(((CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 1 END) * o_totalprice)::DECIMAL(18, 2))::DOUBLE AS et0 FROM orders GROUP BY 2)"""
PAIRS_SQL = """(SELECT o.date, o.obs, l.l_extendedprice AS sim FROM
    (SELECT o_orderdate::DATE AS date, (sum(o_totalprice::DECIMAL(18, 2))::DOUBLE / count(*))::DOUBLE AS obs FROM orders GROUP BY 1) o JOIN lineitem l ON l.l_shipdate::DATE = o.date)"""


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    radiation = F.when(F.col("event_type") == "signup", F.lit(None)).when(F.col("event_type") == "error", 0.0).otherwise(F.col("value") * 2)
    return e.select(
        F.col("event_id").alias("id"), (32 + (F.col("user_id") % 21) * 0.5).alias("latitude"), (110 + (F.col("user_id") % 27) * 0.5).alias("longitude"),
        F.col("ts").alias("timestamp"), (F.col("value") / 20).alias("temperature"), (20 + F.col("value") / 10).alias("relative_humidity"),
        (F.col("value") / 50).alias("wind_speed"), radiation.alias("shortwave_radiation"),
    )


def money(column: str) -> Column:
    """Exact sums, whatever the order of the rows."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    o = o.withColumn("demand", F.when(F.col("o_orderpriority").like("1%"), 2).otherwise(1) * F.col("o_totalprice"))
    return o.groupBy(F.lit(1).alias("point"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(
        money("o_totalprice").alias("precip"), money("demand").alias("et0")
    )


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg((money("o_totalprice") / F.count("*")).alias("obs"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sim = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("sim"))
    return sim.join(daily_orders(spark, sf_dir), "date").select("date", "obs", "sim")


def places(spark: SparkSession, sf_dir: str, name: str, **more: Column) -> DataFrame:
    """Suppliers or customers as points, with columns ``more`` of their table."""
    letter = {"supplier": "s_supp", "customer": "c_cust"}[name]
    t = table(spark, sf_dir, name)
    return t.select(F.col(f"{letter}key").alias("key"), (F.col(f"{letter[:2]}nationkey") / 50).alias("lat"), (F.col(f"{letter[:2]}acctbal") / 10000).alias("lon"), *[c.alias(k) for k, c in more.items()])
