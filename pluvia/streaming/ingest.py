"""Streaming ingestion from landing folders; replays change nothing, as writes are keyed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pluvia.sinks import append_new_observations, upsert_samples
from pluvia.sources.archive import stream_archive
from pluvia.sources.weather import forecast

OBSERVATIONS = (
    "latitude double, longitude double, timestamp timestamp_ntz, temperature double, precipitation double, et0_fao_evapotranspiration double,"
    " soil_moisture_0_to_7cm double, relative_humidity_2m double, wind_speed_10m double, shortwave_radiation double"
)


def ingest_observations(spark: SparkSession, landing: str, target: str, checkpoint: str) -> StreamingQuery:
    """All Parquet files that have landed since the last run are inserted, known keys ignored.

    Of several new rows of a key the one that landed first stays: by file time, file and place in the file.
    """
    arrived = spark.readStream.schema(OBSERVATIONS).parquet(landing)
    landed = F.struct(*(f"_metadata.{c}" for c in ("file_modification_time", "file_path", "row_index")))
    arrived = arrived.withColumn("_landed", landed)

    def write(batch: DataFrame, _: int) -> None:
        append_new_observations(batch.sparkSession, batch, target, ["_landed"])

    return arrived.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_archive(spark: SparkSession, landing: str, target: str, checkpoint: str, chunks: int, years: tuple[int, int]) -> StreamingQuery:
    """Units of the archive that have landed, in fetching order and behind those that the checkpoint has; known keys ignored.

    A batch that a crash cut short is read again from the same units, and what it had written is known by then.
    """
    arrived = stream_archive(spark, landing, chunks, years)

    def write(batch: DataFrame, _: int) -> None:
        append_new_observations(batch.sparkSession, batch, target, ["chunk", "year"])

    return arrived.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_forecasts(spark: SparkSession, landing: str, target: str, checkpoint: str) -> StreamingQuery:
    """Hourly rows of the forecasts that have landed replace older ones of the same hour; later files win."""
    arrived = spark.readStream.option("wholetext", True).text(landing)
    arrived = arrived.select("value", F.unix_micros("_metadata.file_modification_time").alias("seq"))

    def write(batch: DataFrame, _: int) -> None:
        upsert_samples(batch.sparkSession, forecast(batch, keep=["seq"]), target, ["seq"])

    return arrived.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_stream(observations: DataFrame, delay: str = "2 days") -> DataFrame:
    """Daily means per point of a stream with event time ``timestamp``; later rows than ``delay`` are dropped."""
    timed = observations.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", delay)
    return timed.groupBy("latitude", "longitude", F.window("event_time", "1 day")).agg(F.avg("temperature").alias("temperature"), F.count("*").alias("n"))
