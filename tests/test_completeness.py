import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pluvia.operators import quality
from pluvia.streaming import completeness

KIND = "latitude double, longitude double, timestamp timestamp_ntz, seen boolean"


def land(spark, path, rows, parts=1):
    spark.createDataFrame(rows, KIND).repartition(parts).write.mode("append").parquet(path)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_ends_in_the_same_classes(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows = [(lat, 110.0, dt.datetime(year, 1, 1) + dt.timedelta(hours=h), True) for lat, year, hours in ((32.0, 2020, 13), (32.0, 2021, 4), (33.0, 2020, 10), (34.0, 2021, 11)) for h in draw.sample(range(8760), hours)]
    more = rows + rows[::3]  # replays
    draw.shuffle(more)
    landing, changes, check = (f"file://{tmp_path}/{x}" for x in ("landing", "changes", "check"))
    points = spark.createDataFrame([(lat, 110.0) for lat in (32.0, 33.0, 34.0, 35.0)], "latitude double, longitude double")
    completeness.expected_rows(points, [2020, 2021]).write.parquet(landing)
    for i in range(2):
        land(spark, landing, more[i::2], 2)
        completeness.follow(spark, landing, changes, check, 2, complete_above=10).awaitTermination()
    whole = spark.createDataFrame(rows, KIND)
    want = quality.point_year_completeness(whole, points, [2020, 2021], "timestamp", ["latitude", "longitude"], 10)
    got = completeness.latest(spark.read.parquet(changes))
    # a change is given with the count at which it happened, so counts are compared by class alone
    assert sorted(tuple(r) for r in got.select("latitude", "longitude", "year", "status").collect()) == sorted(tuple(r) for r in want.select("latitude", "longitude", "year", "status").collect())
    assert spark.read.parquet(changes).groupBy("latitude", "longitude", "year", "status").count().filter("count > 1").count() == 0


def test_a_year_closes_by_timer_and_its_late_rows_are_dropped(spark, tmp_path):
    landing, changes, check = (f"file://{tmp_path}/{x}" for x in ("landing", "changes", "check"))
    run = lambda: completeness.follow(spark, landing, changes, check, open_for="400 days", complete_above=2).awaitTermination()
    at = lambda year, hour: (32.0, 110.0, dt.datetime(year, 5, 1, hour), True)
    land(spark, landing, [at(2020, 1), at(2020, 1), at(2021, 1)])
    run()
    land(spark, landing, [at(2020, 2), (None, 1.0, dt.datetime(2020, 1, 1), True), (1.0, 1.0, None, True)])  # late, but its year is open
    run()
    land(spark, landing, [at(2023, 1)])
    run()
    land(spark, landing, [at(2020, 7), at(2020, 8), at(2023, 2)])
    run()
    got = sorted((r.year, r.n, r.status, r.closed) for r in spark.read.parquet(changes).collect())
    assert got == [(2020, 1, "partial", False), (2020, 2, "partial", True), (2021, 1, "partial", False), (2021, 1, "partial", True), (2023, 1, "partial", False)]
