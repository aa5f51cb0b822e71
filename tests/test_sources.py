import datetime as dt
import gzip
import json
import os

from pyspark.sql import functions as F

from pluvia import sinks
from pluvia.sources import weather
from pluvia.streaming import ingest


def test_station_files(spark, tmp_path):
    path = tmp_path / "stations.csv"
    path.write_text(
        '"USAF","WBAN","STATION NAME","CTRY","LAT","LON","ELEV(M)","BEGIN","END"\n'
        "053000,99999,A,CH,35.0,115.0,10,19560101,20240824\n053001,99999,B,CH,35.0,115.0,10,19950101,20240824\n053002,99999,C,CH,50.0,115.0,10,19560101,20240824\n"
    )
    found = weather.study_stations(weather.stations(spark, str(path))).collect()
    assert [r.USAF for r in found] == ["053000"]


def test_isd_lite(spark, tmp_path):
    path = tmp_path / "053000-99999-1990.gz"
    with gzip.open(path, "wt") as out:
        out.write("1990 01 01 00   -50   -80 10250   270    20     4     0 -9999\n1990 01 01 01 -9999 -9999 -9999 -9999 -9999 -9999 -9999 -9999\n\n")
    rows = weather.isd_lite(spark, str(path)).orderBy("Hour").collect()
    assert rows[0].AirTemp == -5.0 and rows[0].Precip6h is None and rows[0].timestamp == dt.datetime(1990, 1, 1)
    assert rows[1].AirTemp is None and len(rows) == 2
    assert weather.isd_lite(spark, str(path), 1991).count() == 0


def test_isd_lite_opens_only_files_of_the_year(spark, tmp_path):
    line = "{} 01 01 00   -50   -80 10250   270    20     4     0 -9999\n"
    for name, year in (("053000-99999-1990.gz", 1990), ("053000-99999-1991.gz", 1991), ("054000-99999-1991", 1991), ("199100-99999-1992.gz", 1992)):
        with (gzip.open if name.endswith("gz") else open)(tmp_path / name, "wt") as out:
            out.write(line.format(year))
    some = weather.isd_lite(spark, str(tmp_path), 1991, named=True)
    assert some.count() == 2 and sorted(f.rsplit("/", 1)[1] for f in some.inputFiles()) == ["053000-99999-1991.gz", "054000-99999-1991"]
    assert weather.isd_lite(spark, str(tmp_path), 1991).count() == 2 and weather.isd_lite(spark, str(tmp_path), named=True).count() == 4
    assert weather.isd_lite(spark, str(tmp_path), 1950, named=True).count() == 0


def test_forecast_and_archive(spark):
    body = json.dumps({"hourly": {"time": ["2026-01-01T00:00", "2026-01-01T01:00"], "temperature_2m": [1.5, 2.5], "relative_humidity_2m": [50], "wind_speed_10m": []}})
    rows = weather.forecast(spark.createDataFrame([(body,), ("{}",)], "value string")).orderBy("timestamp").collect()
    assert [(r.timestamp.hour, r.temperature, r.humidity, r.wind_speed) for r in rows] == [(0, 1.5, 50.0, None), (1, 2.5, None, None)]
    blocks = spark.createDataFrame(
        [(32.0, 110.0, 0, 7200, 3600, *[[float(i), float(i + 1), 99.0] for i in range(7)])],
        "lat double, lon double, start long, end long, interval_s int, " + ", ".join(f"{c} array<double>" for c in weather.ARCHIVE_VALUES),
    )
    got = weather.archive(blocks).orderBy("timestamp").collect()
    assert [(r.timestamp, r.temperature) for r in got] == [(dt.datetime(1970, 1, 1), 0.0), (dt.datetime(1970, 1, 1, 1), 1.0)]


def test_unreadable_and_missing_station_files(spark, tmp_path):
    with gzip.open(tmp_path / "good.gz", "wt") as out:
        out.write("1990 01 01 00   -50   -80 10250   270    20     4     0 -9999\n")
    (tmp_path / "bad.gz").write_bytes(b"\x1f\x8b\x08 not a gzip file at all")
    paths = [str(tmp_path / n) for n in ("good.gz", "bad.gz", "absent.gz")]
    assert [r.AirTemp for r in weather.isd_lite(spark, paths).collect()] == [-5.0]
    none = weather.isd_lite(spark, paths[2])
    assert none.count() == 0 and none.columns == weather.isd_lite(spark, paths).columns


def observation_rows(spark, hours, temperature):
    names = [f.split()[0] for f in ingest.OBSERVATIONS.split(", ")]
    rows = [(32.0, 110.0, dt.datetime(2020, 1, 1, h), temperature, *[None] * (len(names) - 4)) for h in hours]
    return spark.createDataFrame(rows, ingest.OBSERVATIONS)


def test_streaming_replays_change_nothing(spark, tmp_path):
    landing, target, mark = (str(tmp_path / n) for n in ("landing", "target", "mark"))
    observation_rows(spark, range(5), 1.0).write.parquet(landing)
    ingest.ingest_observations(spark, landing, target, mark).awaitTermination()
    assert spark.read.parquet(target).count() == 5
    observation_rows(spark, range(3, 8), 2.0).write.mode("append").parquet(landing)
    ingest.ingest_observations(spark, landing, target, mark).awaitTermination()
    ingest.ingest_observations(spark, landing, target, str(tmp_path / "other")).awaitTermination()
    rows = spark.read.parquet(target).collect()
    assert len(rows) == 8 and sum(r.temperature == 2.0 for r in rows) == 3


def test_forecast_stream_upserts(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()

    def land(name, temperature, at):
        (landing / name).write_text(json.dumps({"hourly": {"time": ["2026-01-01T00:00"], "temperature_2m": [temperature], "relative_humidity_2m": [5], "wind_speed_10m": [1]}}))
        os.utime(landing / name, (at, at))

    land("a.json", 1.0, 1000)
    ingest.ingest_forecasts(spark, str(landing), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    land("b.json", 3.0, 3000)
    land("c.json", 2.0, 2000)
    ingest.ingest_forecasts(spark, str(landing), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "t")).collect()
    assert [r.temperature for r in rows] == [3.0]


def test_small_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    sinks.snapshot(df, str(tmp_path / "p"))
    sinks.truncate(spark, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["k", "s"] and spark.read.parquet(str(tmp_path / "p")).count() == 0
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1
    assert sinks.health_row(spark, "ok").first().status == "ok"


def test_upserts_rewrite_the_days_of_the_batch_only(spark, tmp_path):
    path = str(tmp_path / "samples")
    at = lambda day, hour: dt.datetime(2026, 1, day, hour)
    make = lambda rows: spark.createDataFrame(rows, "seq long, timestamp timestamp_ntz, temperature double")
    sinks.upsert_samples(spark, make([(1, at(1, 0), 1.0), (1, at(2, 0), 2.0)]), path, ["seq"])
    first = {f.name for f in (tmp_path / "samples" / "sample_date=2026-01-01").glob("*.parquet")}
    sinks.upsert_samples(spark, make([(2, at(2, 0), 5.0), (2, at(2, 1), 6.0)]).withColumn("humidity", F.lit(3.0)), path, ["seq"])
    assert {f.name for f in (tmp_path / "samples" / "sample_date=2026-01-01").glob("*.parquet")} == first
    got = sorted((r.timestamp.day, r.timestamp.hour, r.temperature) for r in spark.read.option("mergeSchema", True).parquet(path).collect())
    assert got == [(1, 0, 1.0), (2, 0, 5.0), (2, 1, 6.0)]


def test_daily_stream(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    observation_rows(spark, range(4), 2.0).write.parquet(landing)
    late = [f.split()[0] for f in ingest.OBSERVATIONS.split(", ")]
    rows = [(32.0, 110.0, dt.datetime(2020, 1, 9), 8.0, *[None] * (len(late) - 4))]
    spark.createDataFrame(rows, ingest.OBSERVATIONS).write.mode("append").parquet(landing)
    stream = ingest.daily_stream(spark.readStream.schema(ingest.OBSERVATIONS).parquet(landing))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).collect()
    assert [(r.temperature, r.n, r.window.start.day) for r in got] == [(2.0, 4, 1)]  # the second day is still open


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    import pytest

    from pluvia import session

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError):
        session.shared_root(fake)


def test_health_probe_without_rows(spark):
    assert sinks.health_probe(spark, sinks.health_row(spark, "ok"), "status").first().status == "ok"
    row = sinks.health_probe(spark, sinks.health_row(spark, "ok").limit(0), "status").first()
    assert row.alive and row.status is None
