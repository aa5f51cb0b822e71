import datetime as dt

import pytest
from pyspark.sql import functions as F

from pluvia.sinks import ObservationTable, append_new_observations, place_is_enough
from pluvia.sources import archive
from pluvia.streaming.ingest import ingest_archive

YEARS = (2020, 2022)


@pytest.fixture
def seen(spark):
    """Three chunks of two points, three years, a few hours each; two rows in one hour, an hour without any."""
    rows = [
        (float(lat), 110.0 + lat / 4, dt.datetime(year, 3, 1, hour, minute), float(lat + hour), 1.0 if hour else None)
        for lat in range(32, 38) for year in range(2020, 2023) for hour, minute in ((0, 0), (1, 5), (1, 25), (4, 0))
    ]
    return spark.createDataFrame(rows, "latitude double, longitude double, timestamp timestamp_ntz, temperature double, precipitation double")


@pytest.fixture
def units(seen):
    return archive.blocks(seen, archive.numbered_points(seen, 2))


def hours(df):
    return sorted((r.latitude, r.timestamp, r.temperature) for r in df.collect() if r.temperature is not None)


@pytest.fixture
def wanted(seen):
    found = seen.groupBy("latitude", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("timestamp")).agg(F.avg("temperature").alias("temperature"))
    return hours(found)


def test_scan_gives_all_hours_and_prunes_units(spark, units, wanted, tmp_path):
    archive.land(units, f"file://{tmp_path}/landing")
    found = archive.read_archive(spark, f"file://{tmp_path}/landing")
    assert hours(found) == wanted
    assert found.count() == 6 * 3 * 5 and found.rdd.getNumPartitions() == 9
    some = found.filter("chunk = 1 AND year > 2020")
    assert some.rdd.getNumPartitions() == 2 and hours(some) == [r for r in wanted if r[0] in (34, 35) and r[1].year > 2020]
    late = found.filter(F.col("timestamp") > F.lit("2021-03-01 01:00:00").cast("timestamp_ntz"))
    assert late.rdd.getNumPartitions() == 6 and hours(late) == [r for r in wanted if r[1] > dt.datetime(2021, 3, 1, 1)]
    assert found.filter("chunk IN (0, 2) AND latitude > 36").rdd.getNumPartitions() == 6
    assert found.filter("year = 1999").count() == 0


def test_blocks_with_short_missing_and_cut_arrays(spark):
    kind = "lat double, lon double, start long, end long, interval_s int, " + ", ".join(f"{v} array<double>" for v in archive.ARCHIVE_VALUES)
    rows = [(1.0, 2.0, 0, 7200, 3600, [1.0, 2.0, 3.0], [4.0], None, [], [None, 5.0], [], []), (1.0, 3.0, 0, 0, 3600, [1.0], *[None] * 6)]
    blocks = spark.createDataFrame(rows, kind).toArrow().to_batches()[0]
    got = archive.unfolded(blocks, archive.Unit(4, 1970)).to_pylist()
    assert [(r["timestamp"].hour, r["temperature"], r["precipitation"], r["soil_moisture_0_to_7cm"], r["relative_humidity_2m"]) for r in got] == [(0, 1.0, 4.0, None, None), (1, 2.0, None, None, 5.0)]
    assert {(r["chunk"], r["year"]) for r in got} == {(4, 1970)}


def test_stream_waits_at_a_gap_and_goes_on_from_its_offset(spark, units, wanted, tmp_path):
    landing, target, check = (f"file://{tmp_path}/{x}" for x in ("landing", "target", "check"))
    run = lambda: ingest_archive(spark, landing, target, check, 3, YEARS).awaitTermination()
    reader = archive.ArchiveStream(landing, 3, *YEARS)
    assert reader.latestOffset() == reader.initialOffset()
    archive.land(units.filter("chunk = 0 OR (chunk = 1 AND year = 2021)"), landing)
    run()
    assert hours(spark.read.parquet(target)) == [r for r in wanted if r[0] in (32, 33)]  # chunk 1 has a gap at 2020
    archive.land(units.filter("chunk = 1 AND year <> 2021"), landing)
    run()
    run()
    archive.land(units.filter("chunk = 2"), landing)
    run()
    got = spark.read.parquet(target)
    assert hours(got) == wanted and got.count() == 6 * 3 * 5
    assert [(u.chunk, u.year) for u in reader.partitions({"chunk": 0, "year": 2022}, {"chunk": 1, "year": 2021})] == [(1, 2020), (1, 2021)]


def test_a_batch_that_failed_after_its_write_is_neither_lost_nor_doubled(spark, units, wanted, tmp_path):
    landing, target, check = (f"file://{tmp_path}/{x}" for x in ("landing", "target", "check"))
    archive.land(units.filter("chunk = 0"), landing)
    ingest_archive(spark, landing, target, check, 3, YEARS).awaitTermination()
    archive.land(units.filter("chunk > 0"), landing)

    def dies(batch, _):
        append_new_observations(batch.sparkSession, batch.filter("latitude < 36"), target, ["chunk", "year"])
        raise RuntimeError("killed")

    stream = archive.stream_archive(spark, landing, 3, YEARS).writeStream.foreachBatch(dies).option("checkpointLocation", check).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        stream.awaitTermination()
    ingest_archive(spark, landing, target, check, 3, YEARS).awaitTermination()
    got = spark.read.parquet(target)
    assert hours(got) == wanted and got.count() == 6 * 3 * 5


def test_bucketed_insert_leaves_history_unshuffled(spark, seen, tmp_path):
    whole = ObservationTable(spark, "obs_bucketed", f"file://{tmp_path}/obs", 4)
    whole.insert(seen.filter("latitude < 35"), ["temperature"], ["temperature"])
    again = seen.withColumn("temperature", F.col("temperature") + 100).unionByName(seen.withColumn("temperature", F.col("temperature") + 50))
    with place_is_enough(spark):
        plan = whole.fresh(again, ["temperature"])._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan
    assert plan.count("Exchange") == 1  # the batch's own
    whole.insert(again, ["temperature"])
    got = {(r.latitude, r.timestamp): r.temperature for r in whole.table().collect()}
    assert len(got) == whole.table().count() == seen.count()
    assert all(v == lat + t.hour + (0 if lat < 35 else 50) for (lat, t), v in got.items())
    spark.sql("DROP TABLE obs_bucketed")
    back = ObservationTable(spark, "obs_bucketed", f"file://{tmp_path}/obs", 4)
    back.insert(again, ["temperature"])
    assert back.table().count() == seen.count()
    spark.sql("DROP TABLE obs_bucketed")
