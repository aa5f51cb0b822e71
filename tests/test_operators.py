import datetime as dt

import pytest
from pyspark.sql import functions as F

from pluvia.operators import quality, ranks, series, spatial, writes
from pluvia.operators.components import components
from pluvia.operators.skew import skewed_lookup
from pluvia.plans import registry
from pluvia.session import Scratch


def test_grid_sizes(spark):
    assert spatial.grid(spark).count() == 567
    assert spatial.grid(spark, step=0.25).count() == 2173
    assert spatial.grid(spark).orderBy("seq").tail(1)[0][1:] == (42.0, 123.0)


def points(spark, rows):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rows)], "key long, lat double, lon double")


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_against_all_pairs(spark, seed):
    import random

    draw = random.Random(seed)
    left = [(draw.uniform(0, 5), draw.uniform(0, 5)) for _ in range(40)] + [(50, 50)]
    right = [(draw.uniform(0, 5), draw.uniform(0, 5)) for _ in range(200)] + [(1, 1), (1, 1)]
    got = {r.a_key: (r.b_key, r.distance) for r in spatial.nearest(points(spark, left), points(spark, right)).collect()}
    band = {r.a_key: r.b_key for r in spatial.nearest_in_band(points(spark, left), points(spark, right), 0.2).collect()}
    for i, (y, x) in enumerate(left):
        best = min((((y - v) ** 2 + (x - u) ** 2) ** 0.5, v, u, j) for j, (v, u) in enumerate(right))
        assert got[i][0] == best[3] and abs(got[i][1] - best[0]) < 1e-12
        assert (i in band) == (best[0] < 0.2) and band.get(i, best[3]) == best[3]


def test_nearest_without_points(spark):
    some, none = points(spark, [(1, 1)]), points(spark, [])
    assert spatial.nearest(some, none).count() == 0 and spatial.nearest(none, some).count() == 0


def test_band_join_has_no_nested_loop(spark):
    plan = spatial.band_join(points(spark, [(1, 1)]), points(spark, [(1, 1)]), 0.2)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_dedup_first_is_idempotent(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (2, 9, "c")], "k int, seq int, v string")
    once = spatial.dedup_first(df, ["k"], ["seq"])
    assert sorted(map(tuple, once.collect())) == [(1, 2, "a"), (2, 9, "c")]
    assert sorted(spatial.dedup_first(once, ["k"], ["seq"]).collect()) == sorted(once.collect())


def test_completeness_bounds(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 8000, 8001)], "n long").select(quality.completeness(F.col("n"))).collect()
    assert [r[0] for r in got] == ["missing", "partial", "partial", "complete"]


def test_grid_stats_counts_null_coordinates(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None), (None, None)], "latitude double, longitude double").withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    assert quality.grid_stats(df).first().grid_points == 3


def test_fill_gaps_and_outliers(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, None, 3.0, None, None, None, 7.0, None])], "p int, t int, v double")
    got = [r.v_filled for r in quality.fill_gaps(df, "v", ["p"], "t").orderBy("t").collect()]
    assert got == [1.0, 2.0, 3.0, None, None, None, 7.0, None]
    marked = quality.iqr_outliers(spark.createDataFrame([(1, float(v)) for v in [*range(20), 500]], "p int, v double"), "v", ["p"])
    assert [r.v for r in marked.filter("is_outlier").collect()] == [500.0]


def test_bilinear_and_inverse_distance(spark):
    nodes = spark.createDataFrame([(float(y), float(x), float(10 * y + x)) for y in (0, 1) for x in (0, 1)], "lat double, lon double, v double")
    got = {r.key: r.v for r in spatial.bilinear(points(spark, [(0.25, 0.5), (1, 1), (1.5, 0)]), nodes, "v", 1.0).collect()}
    assert got == {0: 3.0, 1: 11.0, 2: None}
    pairs = spark.createDataFrame([(1, 0.0, 5.0), (1, 1.0, 9.0), (2, 1.0, 1.0), (2, 2.0, 6.0)], "a_key int, distance double, v double")
    assert {r.a_key: r.v for r in spatial.inverse_distance(pairs, "v").collect()} == {1: 5.0, 2: 2.0}


def test_inverse_distance_within_equals_its_pairs(spark, sf_dir):
    rows = [(1, 0.0, 0.0, 5.0), (2, 0.0, 0.1, 9.0), (3, 0.1, 0.1, None), (4, 0.1, 0.0, 2.0), (5, 0.0, 0.0, 7.0), (6, 3.0, 3.0, None), (7, None, 0.0, 1.0), (8, 0.05, 0.21, 4.0)]
    right = spark.createDataFrame(rows, "key long, lat double, lon double, value double")
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.04, 0.07), (3, 3.0, 3.0), (4, 7.0, 7.0), (5, None, 0.0), (6, 0.1, 0.1)], "key long, lat double, lon double")
    pairs = spatial.band_join(left, right, 0.12).join(right.select(F.col("key").alias("b_key"), "value"), "b_key")
    rounded = lambda df: {r.a_key: None if r.value is None else round(r.value, 9) for r in df.collect()}
    got = rounded(spatial.inverse_distance_within(left, right, 0.12))
    assert got == rounded(spatial.inverse_distance(pairs, "value")) and got[1] == 6.0 and got[3] is None and 4 not in got
    assert "b_key" not in registry.queries()["inverse_distance"](spark, sf_dir)._jdf.queryExecution().toString()


def test_zip_explode_pads_and_defaults(spark):
    df = spark.createDataFrame([(1, [1, 2], [3.0]), (2, None, None), (3, [], [])], "k int, a array<int>, b array<double>")
    assert sorted(map(tuple, series.zip_explode(df, ["a", "b"], ["k"]).collect())) == [(1, 0, 1, 3.0), (1, 1, 2, None)]


def test_rolling_and_empty_series(spark):
    df = spark.createDataFrame([], "p int, t int, v double")
    assert series.lags(df, "v", ["p"], "t", 2).count() == 0 and series.rolling_stats(df, "v", ["p"], "t").count() == 0
    assert series.time_axis(spark, "2024-01-01", "2024-01-01", "1 hour").count() == 0


def test_writes_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    new = spark.createDataFrame([(2, "x", 9.0, 1), (2, "y", 8.0, 2), (3, "z", 7.0, 1)], "k int, s string, v double, seq int")
    fresh = writes.insert_ignore(old, new, ["k"], ["seq"])
    assert [r.k for r in fresh.collect()] == [3]
    grown = old.unionByName(fresh.drop("seq"))
    assert writes.insert_ignore(grown, new, ["k"], ["seq"]).count() == 0
    merged = writes.upsert(old, new, ["k"], ["seq"], ["v"])
    assert sorted(map(tuple, merged.collect())) == [(1, "a", 1.0), (2, "b", 8.0), (3, "z", 7.0)]
    assert sorted(map(tuple, writes.upsert(merged, new, ["k"], ["seq"], ["v"]).collect())) == sorted(map(tuple, merged.collect()))


def test_ids_follow_the_order(spark):
    df = spark.createDataFrame([(i,) for i in (5, 3, 9, 1)], "v int")
    assert [(r.v, r.id) for r in writes.with_ids(df, 10, ["v"]).orderBy("id").collect()] == [(1, 11), (3, 12), (5, 13), (9, 14)]
    assert writes.with_ids(df.limit(0), 10, ["v"]).count() == 0


def test_year_filter_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, dt.datetime(y, 5, 1)) for y in (1990, 1991)], "latitude double, longitude double, timestamp timestamp_ntz")
    writes.write_observations(df, str(tmp_path / "obs"))
    found = quality.in_year(spark.read.parquet(str(tmp_path / "obs")), 1991, "timestamp")
    assert found.count() == 1 and "obs_year" in found._jdf.queryExecution().toString().split("PartitionFilters: [")[-1].split("]")[0]


def test_skewed_lookup_equals_join(spark):
    left = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(3000)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    got = skewed_lookup(left, right, "k", "n", 3000)
    assert sorted(got.collect()) == sorted(left.join(right, "k").select(*got.columns).collect())


def test_components(spark):
    import random

    draw = random.Random(4)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    scratch = Scratch(spark, "test")
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "none")).count() == 0


def test_nearest_of_clustered_points(spark):
    import random

    draw = random.Random(9)
    right = [(draw.gauss(0, 1e-3), draw.gauss(0, 1e-3)) for _ in range(600)] + [(90.0, 90.0), (90.0, 90.0), (40.0, -3.0)]
    left = [(draw.gauss(0, 1e-3), draw.gauss(0, 1e-3)) for _ in range(60)] + [(draw.uniform(-90, 90), draw.uniform(-90, 90)) for _ in range(25)] + [(90.0, 90.0)]
    got = {r.a_key: (r.b_key, r.distance) for r in spatial.nearest(points(spark, left), points(spark, right)).collect()}
    for i, (y, x) in enumerate(left):
        best = min((((y - v) ** 2 + (x - u) ** 2) ** 0.5, v, u, j) for j, (v, u) in enumerate(right))
        assert got[i][0] == best[3] and abs(got[i][1] - best[0]) < 1e-12


def test_first_match_is_by_list_order(spark):
    near = spark.createDataFrame([(2, 7, 0.001), (5, 8, 0.15)], "a_key long, b_key long, distance double")
    listed = spark.createDataFrame([(5, 0), (2, 1), (9, 2)], "key long, nth int")
    assert tuple(spatial.first_match(near, listed, "nth").first()) == (5, 8, 0.15)
    assert spatial.first_match(near.limit(0), listed, "nth").count() == 0


def test_merged_points_round_half_to_even(spark):
    import numpy as np

    core = spark.createDataFrame([(0, 2.375, 1.0), (1, 2.381, 1.0)], "seq int, latitude double, longitude double")
    base = spark.createDataFrame([(0, 2.38, 1.0), (1, 0.125, 0.375)], "seq int, latitude double, longitude double")
    got = sorted((r.src, r.seq, r.latitude, r.longitude) for r in spatial.merged_points([core, base]).collect())
    assert got == [(0, 0, 2.38, 1.0), (1, 1, 0.12, 0.38)]
    values = [*(i / 1000 + 32 for i in range(200)), 2.345, 2.675, 1.005]
    one = spatial.merged_points([spark.createDataFrame(list(enumerate(values)), "seq int, latitude double").withColumn("longitude", F.col("seq").cast("double"))])
    assert {r.seq: r.latitude for r in one.collect()} == {i: float(np.round(v, 2)) for i, v in enumerate(values)}


def test_ranks_of_groups(spark):
    import numpy as np

    draw = np.random.default_rng(2)
    rows = [(int(g), float(v)) for g, v in zip(draw.integers(0, 3, 900), draw.integers(0, 40, 900) / 7)] + [(1, None), (2, None)] + [(0, 3.0)] * 700
    df = spark.createDataFrame(rows, "g int, v double")
    got = ranks.with_ranks(df, ["g"], "v").select("g", "v", ranks.average_rank().alias("rank"), ranks.ecdf().alias("share")).collect()
    assert len(got) == len(rows)
    for g in range(3):
        values = np.array([v for k, v in rows if k == g and v is not None])
        for r in [r for r in got if r.g == g]:
            if r.v is None:
                assert r["rank"] is None and r.share is None
            else:
                assert r["rank"] == (values < r.v).sum() + ((values == r.v).sum() + 1) / 2 and abs(r.share - (values <= r.v).mean()) < 1e-12
        q = ranks.quantiles(df, ["g"], "v", [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]).filter(F.col("g") == g).first()
        assert q.total == len(values) and np.allclose(q.q, np.quantile(values, [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]))
    assert ranks.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0 and ranks.with_ranks(df.limit(0), ["g"], "v").count() == 0


def test_neighbour_fill(spark):
    rows = [("a", t, float(2 * t + 1) if t != 3 else None) for t in range(6)] + [("b", t, float(t)) for t in range(6)] + [("c", 0, None)]
    near = spark.createDataFrame([("a", "b"), ("b", "a")], "p string, neighbour string")
    got = {(r.p, r.t): r.v_filled for r in quality.neighbour_fill(spark.createDataFrame(rows, "p string, t int, v double"), near, "p", "t", "v").collect()}
    assert len(got) == 13 and abs(got["a", 3] - 7.0) < 1e-9 and got["b", 3] == 3.0 and got["c", 0] is None


def test_replace_table_survives_a_crash(spark, tmp_path):
    path = str(tmp_path / "t")
    writes.replace_table(spark, spark.range(3), path)
    writes.replace_table(spark, spark.read.parquet(path).filter("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    (tmp_path / "t").rename(tmp_path / "t-replaced")  # a call that ended between its two moves
    writes.put_back(spark, path)
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "t-replaced").exists()


def test_years_are_written_by_several_tasks(spark, tmp_path):
    df = spark.range(400).selectExpr("CAST(id AS DOUBLE) AS latitude", "0.5D AS longitude", "timestamp_ntz'1990-05-01' AS timestamp")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")  # small parts would be one task
    writes.write_observations(df, str(tmp_path / "obs"), files_a_year=4)
    spark.conf.unset(merging)
    assert 1 < len(list((tmp_path / "obs" / "obs_year=1990").glob("*.parquet"))) <= 4 and spark.read.parquet(str(tmp_path / "obs")).count() == 400


def test_forecast_learns_the_season(spark):
    import math
    import random

    from pluvia.functions import qm
    from pluvia.operators import forecast

    draw = random.Random(3)
    rows = [(p, dt.datetime(1990 + m // 12, m % 12 + 1, 1), 10 * math.sin(m * math.pi / 6) + p + draw.gauss(0, 0.3)) for p in (1, 2) for m in range(240)]
    df = spark.createDataFrame(rows, "p int, month timestamp_ntz, v double")
    split = F.lit("2006-01-01").cast("timestamp_ntz")
    for model, parameters in (("boosted", {"maxIter": 10}), ("forest", {"numTrees": 10})):
        got = forecast.forecast(df, "v", ["p"], "month", split, model, **parameters)
        assert got.count() == 2 * 48 and got.agg(F.min("month")).first()[0] == dt.datetime(2006, 1, 1)
        assert qm.metrics(got.withColumn("mean", F.lit(1.5)), "v", "mean", "predicted", []).first().r2_after > 0.9


def test_planned_tables(spark):
    from pluvia import sinks

    spark.sql("CREATE DATABASE IF NOT EXISTS planned")
    sinks.create_planned(spark, "planned")
    sinks.create_planned(spark, "planned")
    assert {t.name for t in spark.catalog.listTables("planned")} == set(sinks.PLANNED)
    assert [c.name for c in spark.catalog.listColumns("planned.spei_results")] == ["station_id", "date", "spei_1", "spei_3", "spei_12", "drought_level", "is_predicted"]
    spark.sql("DROP DATABASE planned CASCADE")
