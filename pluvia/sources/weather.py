"""Station lists, hourly station files and provider payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions.text import sentinel_to_null, white_fields
from pluvia.operators.series import zip_explode
from pluvia.session import exists

# Fixed schemas and formats of the files.
STATIONS = "`USAF` string, `WBAN` string, `STATION NAME` string, `CTRY` string, `LAT` double, `LON` double, `ELEV(M)` double, `BEGIN` string, `END` string"
MAPPING = "station_id string, station_name string, station_lat double, station_lon double, grid_lat double, grid_lon double, distance_deg double"
ISD_FIELDS = ("Year", "Month", "Day", "Hour", "AirTemp", "DewPoint", "Pressure", "WindDir", "WindSpeed", "SkyCond", "Precip1h", "Precip6h")
FORECAST = "hourly struct<time: array<string>, temperature_2m: array<double>, relative_humidity_2m: array<double>, wind_speed_10m: array<double>>"
ARCHIVE_VALUES = (
    "temperature", "precipitation", "et0_fao_evapotranspiration", "soil_moisture_0_to_7cm", "relative_humidity_2m", "wind_speed_10m", "shortwave_radiation",
)


def unquoted_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace('"', "").strip() for c in df.columns])


def stations(spark: SparkSession, path: str) -> DataFrame:
    """Station list; ids stay strings, so that leading zeros survive."""
    return unquoted_header(spark.read.csv(path, header=True, schema=STATIONS))


def station_mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=MAPPING)


def study_stations(listed: DataFrame, lat: tuple[float, float] = (32, 42), lon: tuple[float, float] = (110, 123), first: int = 1991, last: int = 2022) -> DataFrame:
    """Stations of the box that reported from ``first`` or before to ``last`` or after."""
    year = lambda c: F.substring(F.col(c).cast("string"), 1, 4).cast("int")
    inside = F.col("LAT").between(*lat) & F.col("LON").between(*lon)
    return listed.filter(inside & (year("BEGIN") <= first) & (year("END") >= last)).select("USAF", "WBAN", "STATION NAME", "CTRY", "LAT", "LON", "ELEV(M)", "BEGIN", "END")


def isd_lite(spark: SparkSession, paths: str | list[str], year: int | None = None, named: bool = False) -> DataFrame:
    """Hourly observations of ISD-Lite files (plain or gzip): -9999 is missing, temperatures are in tenths.

    Files that can't be read are skipped (Spark logs a warning for each), and paths that don't exist too; without any
    file the frame is empty and has its columns. One gzip file is one task, so files are the unit of work; ``year`` is
    tested on the data. Where files are ``named`` as they are published (station-WBAN-year), those of other years aren't
    opened at all.
    """
    there = [p for p in ([paths] if isinstance(paths, str) else paths) if any(c in p for c in "*?[{") or exists(spark, p)]
    reader = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    if named and year is not None:
        reader = reader.option("pathGlobFilter", f"*-{year:04d}{{,.gz,.txt,.op.gz}}")
    if there:
        lines = reader.text(there).select("value", F.col("_metadata.file_path").alias("file"))
    else:
        lines = spark.createDataFrame([], "value string, file string")
    lines = lines.filter(F.trim("value") != "").select("file", white_fields(F.col("value")).alias("f"))
    values = lines.select("file", *[sentinel_to_null(F.get("f", F.lit(i)).cast("double")).alias(n) for i, n in enumerate(ISD_FIELDS)])
    if year is not None:
        values = values.filter(F.col("Year") == year)
    stamp = F.make_timestamp_ntz(*[F.col(c).cast("int") for c in ISD_FIELDS[:4]], F.lit(0), F.lit(0).cast("decimal(16,6)"))
    return values.withColumn("AirTemp", F.col("AirTemp") / 10).withColumn("timestamp", stamp)


def forecast(payloads: DataFrame, column: str = "value", keep: list[str] = ()) -> DataFrame:
    """timestamp, temperature, humidity and wind_speed rows of hourly forecast JSON; missing arrays count as empty."""
    hourly = payloads.select(*keep, F.from_json(column, FORECAST).hourly.alias("h")).select(*keep, "h.*")
    rows = zip_explode(hourly, ["time", "temperature_2m", "relative_humidity_2m", "wind_speed_10m"], list(keep))
    return rows.filter(F.col("time").isNotNull()).select(
        *keep,
        F.to_timestamp_ntz("time", F.lit("yyyy-MM-dd'T'HH:mm[:ss]")).alias("timestamp"),
        F.col("temperature_2m").alias("temperature"), F.col("relative_humidity_2m").alias("humidity"), F.col("wind_speed_10m").alias("wind_speed"),
    )


def utc(seconds: Column) -> Column:
    """Epoch seconds as a zone-less UTC timestamp, whatever the session's zone."""
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def archive(blocks: DataFrame) -> DataFrame:
    """Observation rows of archive blocks: lat, lon, start, end, interval_s (epoch seconds, end left out) and an array a variable."""
    return zip_explode(blocks, list(ARCHIVE_VALUES), ["lat", "lon", "start", "end", "interval_s"]).filter(
        F.col("start") + F.col("pos") * F.col("interval_s") < F.col("end")
    ).select(
        F.col("lat").cast("double").alias("latitude"), F.col("lon").cast("double").alias("longitude"),
        utc(F.col("start") + F.col("pos") * F.col("interval_s")).alias("timestamp"), *[F.col(c).cast("double").alias(c) for c in ARCHIVE_VALUES],
    )
