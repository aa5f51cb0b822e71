"""Named queries over the driver's tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvia import sinks
from pluvia.functions import qm, text
from pluvia.functions.et0 import et0_fao56, et0_sql
from pluvia.functions.normal import norm_ppf_sql
from pluvia.functions.spei import drought_level, rolling_sum, spei, spei_log_logistic
from pluvia.operators import boosted, forecast, kriging, quality, ranks, refresh, series, spatial, writes
from pluvia.plans.bindings import MONTHLY_SQL, OBS_SQL, PAIRS_SQL, daily_orders, monthly, obs, pairs, places
from pluvia.session import Scratch
from pluvia.sources import archive, table
from pluvia.streaming import completeness
from pluvia.streaming.ingest import ingest_archive

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}
YEARS = list(range(1995, 2002))
NAMES = {"krige": "kriging", "rolling_sum_3": "rolling_sum", "spei_3": "spei", "drought_level_monthly": "drought_level"}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        name = NAMES.get(f.__name__, f.__name__)
        _queries[name] = f
        if sql:
            _oracle[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)


def f4(x: Column | str, places: int = 4) -> Column:
    """Rounded in the one way that both engines agree on at decimal ties."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * float(10**places) + 0.5) / float(10**places)


def q4(x: str, places: int = 4) -> str:
    return f"floor(({x}) * 1e{places} + 0.5::DOUBLE) / 1e{places}"


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.col("date").cast("timestamp_ntz"))


# --- scans, projections, filters ---------------------------------------------------------------------------------------


@query(f"SELECT * FROM {OBS_SQL}")
def scan_all(spark, sf_dir):
    return obs(spark, sf_dir)


@query(f'SELECT id, temperature AS temp, "timestamp" AS observed_at, latitude AS lat, longitude AS lon FROM {OBS_SQL}')
def project_alias(spark, sf_dir):
    return obs(spark, sf_dir).select(
        "id", F.col("temperature").alias("temp"), F.col("timestamp").alias("observed_at"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")
    )


@query(f'SELECT id, temperature FROM {OBS_SQL} WHERE latitude = 35.5 AND temperature >= 4.0')
def param_scan(spark, sf_dir):
    return spark.sql(
        "SELECT id, temperature FROM {obs} WHERE latitude = :lat AND temperature >= :least", args={"lat": 35.5, "least": 4.0}, obs=obs(spark, sf_dir)
    )


@query(f"SELECT id, temperature FROM {OBS_SQL} ORDER BY id LIMIT 10")
def head_n(spark, sf_dir):
    return series.head(obs(spark, sf_dir).select("id", "temperature"), "id", 10)


@query(f'SELECT id, "timestamp", temperature FROM {OBS_SQL}')
def samples_ordered(spark, sf_dir):
    return obs(spark, sf_dir).select("id", "timestamp", "temperature").orderBy(F.col("timestamp").asc_nulls_last(), "id")


@query(f"SELECT id, latitude, longitude, temperature FROM {OBS_SQL} ORDER BY id DESC LIMIT 50")
def recent_topk(spark, sf_dir):
    return series.recent(obs(spark, sf_dir).select("id", "latitude", "longitude", "temperature"), "id")


@query(f'SELECT id, "timestamp" FROM {OBS_SQL} ORDER BY id DESC LIMIT 50')
def recent_topk_resorted(spark, sf_dir):
    return series.recent(obs(spark, sf_dir).select("id", "timestamp"), "id").orderBy("timestamp", "id")


@query("SELECT line_no, line FROM (SELECT doc_id AS line_no, text AS line FROM documents ORDER BY doc_id DESC LIMIT 20)")
def tail_n(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), F.col("text").alias("line"))
    return series.recent(lines, "line_no", 20).orderBy("line_no")


@query(f"""SELECT id, latitude, longitude, "timestamp" FROM {OBS_SQL} WHERE latitude BETWEEN 34.9 AND 35.1 AND longitude BETWEEN 113.4 AND 116.6
    AND "timestamp" BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-12-31 23:59:59'""")
def box_filter(spark, sf_dir):
    found = spatial.in_box(obs(spark, sf_dir), (34.9, 35.1), (113.4, 116.6)).select("id", "latitude", "longitude", "timestamp")
    return found.filter(F.expr("timestamp BETWEEN timestamp_ntz'2024-01-05 00:00:00' AND timestamp_ntz'2024-12-31 23:59:59'"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem WHERE year(l_shipdate) = 1997")
def year_filter(spark, sf_dir):
    return quality.in_year(table(spark, sf_dir, "lineitem"), 1997, "l_shipdate").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")


@query(f"""WITH o AS {OBS_SQL}, f AS (SELECT latitude, longitude FROM o ORDER BY id LIMIT 1)
    SELECT o.id, o."timestamp", o.temperature FROM o JOIN f USING (latitude, longitude) ORDER BY o."timestamp", o.id LIMIT 100""")
def first_point_series(spark, sf_dir):
    found = series.first_point_series(obs(spark, sf_dir), "id", ["latitude", "longitude"], "timestamp")
    return found.select("id", "timestamp", "temperature")


@query(f"""SELECT DISTINCT latitude, longitude FROM {OBS_SQL} WHERE "timestamp" >= TIMESTAMP '2024-01-20'""")
def distinct_points_since(spark, sf_dir):
    return obs(spark, sf_dir).filter(F.expr("timestamp >= timestamp_ntz'2024-01-20'")).select("latitude", "longitude").distinct()


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey BETWEEN 5 AND 15 AND c_acctbal BETWEEN 0 AND 5000")
def station_box(spark, sf_dir):
    found = spatial.in_box(table(spark, sf_dir, "customer"), (5, 15), (0, 5000), "c_nationkey", "c_acctbal")
    return found.select("c_custkey", "c_nationkey", "c_acctbal")


@query("""WITH p AS (SELECT o_custkey AS station, strftime(min(o_orderdate), '%Y%m%d') AS first_day, strftime(max(o_orderdate), '%Y%m%d') AS last_day
    FROM orders GROUP BY 1) SELECT * FROM p WHERE substr(first_day, 1, 4)::INT <= 1995 AND substr(last_day, 1, 4)::INT >= 2000""")
def station_period(spark, sf_dir):
    day = lambda f: F.date_format(f("o_orderdate"), "yyyyMMdd")
    period = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("station")).agg(day(F.min).alias("first_day"), day(F.max).alias("last_day"))
    year = lambda c: F.substring(c, 1, 4).cast("int")
    return period.filter((year("first_day") <= 1995) & (year("last_day") >= 2000))


@query("""SELECT doc_id, w[1] AS w1, w[2] AS w2, w[3] AS w3 FROM
    (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+') AS w FROM documents)""")
def ws_parse(spark, sf_dir):
    return series.tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["w1", "w2", "w3"]).drop("text")


@query("SELECT l_orderkey, l_linenumber, nullif(l_tax, 0) AS l_tax, nullif(l_discount, 0) AS l_discount FROM lineitem")
def sentinel_null(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", *[text.sentinel_to_null(F.col(c), 0).alias(c) for c in ("l_tax", "l_discount")])


@query("SELECT event_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS json FROM events")
def to_json_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "event_type", "user_id")).alias("json"))


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k BIGINT").k.alias("k"))


@query("""SELECT s_suppkey, CASE WHEN length(s_suppkey::VARCHAR) < 6 THEN lpad(s_suppkey::VARCHAR, 6, '0') ELSE s_suppkey::VARCHAR END || '-' ||
    CASE WHEN length(s_nationkey::VARCHAR) < 5 THEN lpad(s_nationkey::VARCHAR, 5, '0') ELSE s_nationkey::VARCHAR END AS station FROM supplier""")
def station_keys(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.station_key(F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")).alias("station"))


@query("""SELECT o_orderkey, format('{:.2f}', o_totalprice) AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, format('{:,}', o_custkey) AS customer FROM orders""")
def format_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.shown(F.col("o_totalprice"), 2).alias("price"), text.iso_date(F.col("o_orderdate")).alias("day"), text.shown_count(F.col("o_custkey")).alias("customer")
    )


@query("SELECT p_partkey, p_type FROM part WHERE contains(p_name, '1') AND ends_with(p_type, 'L')")
def name_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.filter(F.contains("p_name", F.lit("1")) & F.endswith("p_type", F.lit("L"))).select("p_partkey", "p_type")


@query("SELECT version() IS NOT NULL AS alive, r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 1")
def health_probe(spark, sf_dir):
    return sinks.health_probe(spark, table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_regionkey")


# --- aggregates and data quality ---------------------------------------------------------------------------------------


@query(f"SELECT count(*) AS total_count FROM {OBS_SQL}")
def total_count(spark, sf_dir):
    return obs(spark, sf_dir).agg(F.count("*").alias("total_count"))


@query(f"""SELECT count(*) AS total_records, min("timestamp") AS min_date, max("timestamp") AS max_date, count(DISTINCT (latitude, longitude)) AS grid_points
    FROM {OBS_SQL}""")
def grid_stats(spark, sf_dir):
    return quality.grid_stats(obs(spark, sf_dir))


@query("SELECT year(l_shipdate)::INT AS year, count(*) AS count FROM lineitem GROUP BY 1")
def year_coverage(spark, sf_dir):
    return quality.year_coverage(table(spark, sf_dir, "lineitem"), "l_shipdate")


@query("""SELECT count(DISTINCT l_suppkey) AS locations, count(*) AS total_rows, count(*)::DOUBLE / count(DISTINCT l_suppkey) AS rows_per_location
    FROM lineitem WHERE year(l_shipdate) = 1996""")
def rows_per_location(spark, sf_dir):
    return quality.rows_per_location(table(spark, sf_dir, "lineitem"), 1996, "l_shipdate", ["l_suppkey"])


@query("""SELECT l_suppkey, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts, count(*) AS cnt FROM lineitem WHERE year(l_shipdate) = 1996
    GROUP BY 1 ORDER BY 1 LIMIT 5""")
def point_year_detail(spark, sf_dir):
    return quality.point_year_detail(table(spark, sf_dir, "lineitem"), 1996, "l_shipdate", ["l_suppkey"])


def _checks() -> dict[str, Column]:
    radiation = F.col("shortwave_radiation")
    daytime = F.hour("timestamp").between(10, 14)
    return {"radiation_null": radiation.isNull(), "radiation_zero": radiation == 0, "daytime_zero": (radiation == 0) & daytime}


CHECKS_SQL = """count(*) AS total, count(*) FILTER (shortwave_radiation IS NULL) AS radiation_null, count(*) FILTER (shortwave_radiation = 0) AS radiation_zero,
    count(*) FILTER (shortwave_radiation = 0 AND hour("timestamp") BETWEEN 10 AND 14) AS daytime_zero"""


@query(f"SELECT {CHECKS_SQL} FROM {OBS_SQL}")
def dq_summary(spark, sf_dir):
    return quality.summary(obs(spark, sf_dir), _checks())


@query(f"SELECT id FROM {OBS_SQL} WHERE shortwave_radiation IS NULL")
def dq_null(spark, sf_dir):
    return obs(spark, sf_dir).filter(_checks()["radiation_null"]).select("id")


@query(f"SELECT id FROM {OBS_SQL} WHERE shortwave_radiation = 0")
def dq_zero(spark, sf_dir):
    return obs(spark, sf_dir).filter(_checks()["radiation_zero"]).select("id")


@query(f'SELECT id FROM {OBS_SQL} WHERE shortwave_radiation = 0 AND hour("timestamp") BETWEEN 10 AND 14')
def dq_daytime_zero(spark, sf_dir):
    return obs(spark, sf_dir).filter(_checks()["daytime_zero"]).select("id")


@query(f"""WITH c AS (SELECT {CHECKS_SQL} FROM {OBS_SQL})
    SELECT {', '.join(q4(f"{n}::DOUBLE * 100 / total::DOUBLE", 2) + f" AS {n}_pct" for n in ("radiation_null", "radiation_zero", "daytime_zero"))} FROM c""")
def dq_percent(spark, sf_dir):
    found = quality.percents(quality.summary(obs(spark, sf_dir), _checks()), list(_checks()))
    return found.select(*[f4(c, 2).alias(c) for c in found.columns])


@query("""SELECT year(l_shipdate)::INT AS year, count(*) AS total, count(nullif(l_tax, 0)) AS known, count(*) FILTER (nullif(l_tax, 0) IS NULL) AS missing
    FROM lineitem GROUP BY 1""")
def dq_null_by_year(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("tax", text.sentinel_to_null(F.col("l_tax"), 0))  # noqa: E741
    return quality.nulls_by_year(l, "l_shipdate", "tax")


@query(f"""WITH e AS (SELECT s_suppkey AS l_suppkey, unnest({YEARS})::INT AS year FROM supplier),
    c AS (SELECT l_suppkey, year(l_shipdate)::INT AS year, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, year, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) > 80 THEN 'complete' WHEN coalesce(n, 0) > 0 THEN 'partial' ELSE 'missing' END AS status
    FROM e LEFT JOIN c USING (l_suppkey, year)""")
def completeness_class(spark, sf_dir):
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    return quality.point_year_completeness(table(spark, sf_dir, "lineitem"), points, YEARS, "l_shipdate", ["l_suppkey"], 80)


@query(f"""SELECT c_custkey AS o_custkey, year FROM customer, (SELECT unnest({YEARS})::INT AS year) y
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = year)""")
def missing_point_years(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return quality.missing_point_years(table(spark, sf_dir, "orders"), points, YEARS, "o_orderdate", ["o_custkey"])


@query("""SELECT l_returnflag, """ + ", ".join(f"count(*) FILTER (year(l_shipdate) = {y}) AS y{y}" for y in YEARS) + """ FROM lineitem GROUP BY 1""")
def point_year_matrix(spark, sf_dir):
    return series.point_year_matrix(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate"), "l_returnflag", "l_shipdate", YEARS)


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 2 AND 49 THEN l_quantity END AS quantity, l_extendedprice FROM lineitem)
    SELECT count(*) AS total, count(quantity) AS in_range FROM v""")
def range_check(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("quantity", quality.physical_range(F.col("l_quantity"), 2, 49))  # noqa: E741
    return l.agg(F.count("*").alias("total"), F.count("quantity").alias("in_range"))


@query("""WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders GROUP BY 1)
    SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_totalprice < a - (b - a) * 0.5 OR o_totalprice > b + (b - a) * 0.5) AS outliers
    FROM orders JOIN q USING (o_orderpriority) GROUP BY 1""")
def iqr_outliers(spark, sf_dir):
    marked = quality.iqr_outliers(table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice"), "o_totalprice", ["o_orderpriority"], 0.5)
    return marked.groupBy("o_orderpriority").agg(F.count("*").alias("total"), F.count_if("is_outlier").alias("outliers"))


# --- grids, neighbours ---------------------------------------------------------------------------------------------------


def _grid_sql(rows: int, columns: int, step: float) -> str:
    return f"""SELECT r.i * {columns} + c.i AS seq, (32 + r.i * {step})::DOUBLE AS latitude, (110 + c.i * {step})::DOUBLE AS longitude
        FROM range({rows}) r(i), range({columns}) c(i)"""


@query(_grid_sql(21, 27, 0.5))
def grid_gen(spark, sf_dir):
    return spatial.grid(spark)


@query(_grid_sql(41, 53, 0.25))
def grid_gen_025(spark, sf_dir):
    return spatial.grid(spark, step=0.25)


@query("SELECT unnest(generate_series(TIMESTAMP '2023-01-01', TIMESTAMP '2023-12-31 23:00:00', INTERVAL 1 HOUR)) AS ts")
def time_axis(spark, sf_dir):
    return series.time_axis(spark, "2023-01-01", "2024-01-01", "1 hour")


@query("""WITH u AS (SELECT 0 AS src, s_suppkey AS seq, s_nationkey AS cell, floor(s_acctbal / 1000)::BIGINT AS band FROM supplier
    UNION ALL SELECT 1, c_custkey, c_nationkey, floor(c_acctbal / 1000)::BIGINT FROM customer)
    SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY cell, band ORDER BY src, seq) = 1""")
def dedup_first(spark, sf_dir):
    def cells(name: str, source: int, key: str) -> DataFrame:
        p = key[:2]
        t = table(spark, sf_dir, name)
        return t.select(F.lit(source).alias("src"), F.col(key).alias("seq"), F.col(f"{p}nationkey").alias("cell"), F.floor(F.col(f"{p}acctbal") / 1000).alias("band"))

    both = cells("supplier", 0, "s_suppkey").unionByName(cells("customer", 1, "c_custkey"))
    return spatial.dedup_first(both, ["cell", "band"], ["src", "seq"])


@query(f"""WITH p AS (SELECT DISTINCT latitude, longitude FROM {OBS_SQL})
    SELECT latitude, longitude, seq, floor(seq / 10)::BIGINT AS chunk FROM (SELECT *, row_number() OVER (ORDER BY latitude, longitude) - 1 AS seq FROM p) WHERE seq >= 20""")
def chunking(spark, sf_dir):
    points = obs(spark, sf_dir).select("latitude", "longitude").distinct()
    return series.chunks(points, ["latitude", "longitude"], 10, 20).select("latitude", "longitude", F.col("seq").cast("long").alias("seq"), "chunk")


NEAR_SQL = """WITH a AS (SELECT s_suppkey AS a_key, s_nationkey / 50::DOUBLE AS y, s_acctbal / 10000::DOUBLE AS x FROM supplier),
    b AS (SELECT c_custkey AS b_key, c_nationkey / 50::DOUBLE AS v, c_acctbal / 10000::DOUBLE AS u FROM customer),
    d AS (SELECT a_key, b_key, v, u, sqrt((y - v) * (y - v) + (x - u) * (x - u)) AS distance FROM a, b WHERE {where})
    SELECT a_key, b_key, {out} AS distance FROM d {filter} QUALIFY row_number() OVER (PARTITION BY a_key ORDER BY distance, v, u, b_key) = 1"""


@query(NEAR_SQL.format(where="abs(y - v) <= 0.02 AND abs(x - u) <= 0.02", out=q4("distance", 9), filter="WHERE distance < 0.02"))
def nearest_in_band(spark, sf_dir):
    found = spatial.nearest_in_band(places(spark, sf_dir, "supplier"), places(spark, sf_dir, "customer"), 0.02)
    return found.withColumn("distance", f4("distance", 9))


@query(NEAR_SQL.format(where="true", out=q4("distance", 9), filter=""))
def nearest_cross(spark, sf_dir):
    return spatial.nearest(places(spark, sf_dir, "supplier"), places(spark, sf_dir, "customer")).withColumn("distance", f4("distance", 9))


MATCH_SQL = "(" + NEAR_SQL.format(where="abs(y - v) <= 0.02 AND abs(x - u) <= 0.02", out="distance", filter="WHERE distance < 0.02") + ")"
LINE_SQL = "rpad(s_name, 20, ' ') || ' | ' || rpad(a_key::VARCHAR, 10, ' ') || ' | ' || rpad(b_key::VARCHAR, 20, ' ') || ' | ' || format('{:.4f}', distance)"


def _matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stations = places(spark, sf_dir, "supplier")
    return spatial.nearest_in_band(stations, places(spark, sf_dir, "customer"), 0.02), stations


@query(f"SELECT a_key, b_key, {q4('distance', 9)} AS distance FROM {MATCH_SQL} ORDER BY a_key DESC LIMIT 1")
def first_match(spark, sf_dir):
    near, stations = _matches(spark, sf_dir)
    return spatial.first_match(near, stations.withColumn("nth", -F.col("key")), "nth").withColumn("distance", f4("distance", 9))


@query(f"SELECT a_key, {LINE_SQL} AS line FROM {MATCH_SQL} m JOIN supplier ON s_suppkey = a_key")
def match_lines(spark, sf_dir):
    near, _ = _matches(spark, sf_dir)
    named = near.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a_key"), "s_name"), "a_key")
    line = text.aligned_line([(F.col("s_name"), 20), (F.col("a_key"), 10), (F.col("b_key"), 20)], text.shown(F.col("distance"), 4))
    return named.select("a_key", line.alias("line"))


MERGED_SQL = "round_even({0}acctbal / 1000 * 100, 0) / 100 AS latitude, round_even({0}nationkey / 7::DOUBLE * 100, 0) / 100 AS longitude"


@query(f"""WITH u AS (SELECT 0 AS src, s_suppkey AS seq, {MERGED_SQL.format('s_')} FROM supplier UNION ALL SELECT 1, c_custkey, {MERGED_SQL.format('c_')} FROM customer)
    SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY latitude, longitude ORDER BY src, seq) = 1""")
def merged_points(spark, sf_dir):
    def of(name: str, key: str) -> DataFrame:
        t = table(spark, sf_dir, name)
        return t.select(F.col(key).alias("seq"), (F.col(f"{key[:2]}acctbal") / 1000).alias("latitude"), (F.col(f"{key[:2]}nationkey") / 7).alias("longitude"))

    return spatial.merged_points([of("supplier", "s_suppkey"), of("customer", "c_custkey")])


@query("""WITH a AS (SELECT s_suppkey AS a_key, s_nationkey / 50::DOUBLE AS y, s_acctbal / 10000::DOUBLE AS x FROM supplier),
    b AS (SELECT c_nationkey / 50::DOUBLE AS v, c_acctbal / 10000::DOUBLE AS u, c_acctbal AS val FROM customer),
    d AS (SELECT a_key, val, sqrt((y - v) * (y - v) + (x - u) * (x - u)) AS d FROM a, b WHERE abs(y - v) <= 0.02 AND abs(x - u) <= 0.02)
    SELECT a_key, floor(coalesce(avg(val) FILTER (d = 0), sum(val / (d * d)) FILTER (d > 0) / sum(1 / (d * d)) FILTER (d > 0)) * 100 + 0.5) / 100 AS value FROM d GROUP BY 1""")
def inverse_distance(spark, sf_dir):
    known = places(spark, sf_dir, "customer", value=F.col("c_acctbal"))
    return spatial.inverse_distance_within(places(spark, sf_dir, "supplier"), known, 0.02).withColumn("value", f4("value", 2))


FACTORS_SQL = "(SELECT c_custkey AS key, c_nationkey / 50::DOUBLE AS lat, c_acctbal / 10000::DOUBLE AS lon, 1 + c_acctbal / 20000 + (c_custkey % 7) / 100::DOUBLE AS value FROM customer)"


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correction factors at the customers' places."""
    return places(spark, sf_dir, "customer", value=1 + F.col("c_acctbal") / 20000 + (F.col("c_custkey") % 7) / 100)


@query(f"""WITH p AS (SELECT min(key) AS key, lat, lon, avg(value) AS value FROM {FACTORS_SQL} GROUP BY lat, lon),
    d AS (SELECT sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)) AS distance, a.value - b.value AS gap FROM p a JOIN p b ON a.key < b.key
    AND abs(a.lat - b.lat) <= 0.05 AND abs(a.lon - b.lon) <= 0.05)
    SELECT least(floor(distance / (0.05 / 15)), 14)::INT AS bin, count(*) AS n, {q4('avg(distance)', 8)} AS distance, {q4('avg(gap * gap) / 2', 8)} AS gamma FROM d WHERE distance <= 0.05 GROUP BY 1""")
def variogram(spark, sf_dir):
    points = Scratch(spark, "factors").write(kriging.known_points(_factors(spark, sf_dir)), "points")
    return kriging.variogram(points, 0.05).select("bin", "n", f4("distance", 8).alias("distance"), f4("gamma", 8).alias("gamma"))


@query(None)
def krige(spark, sf_dir):
    return kriging.krige(places(spark, sf_dir, "supplier"), _factors(spark, sf_dir), 0.05).select("a_key", "n", "value")


# --- series -------------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderdate::DATE::TIMESTAMP AS date, floor(sum(o_totalprice::DECIMAL(18, 2))::DOUBLE / count(*) * 1e4 + 0.5) / 1e4 AS obs FROM orders GROUP BY 1""")
def daily_mean(spark, sf_dir):
    return _stamped(daily_orders(spark, sf_dir).withColumn("obs", f4("obs")))


@query(f"SELECT date::TIMESTAMP AS date, {q4('obs')} AS obs, sim FROM {PAIRS_SQL}")
def join_daily(spark, sf_dir):
    return _stamped(pairs(spark, sf_dir).withColumn("obs", f4("obs")))


def _roll_sql(scale: int) -> str:
    return f"""(SELECT *, CASE WHEN count(*) OVER w = {scale} THEN sum(precip - et0) OVER w END AS balance FROM {MONTHLY_SQL}
    WINDOW w AS (ORDER BY month ROWS BETWEEN {scale - 1} PRECEDING AND CURRENT ROW))"""


def _rank_sql(scale: int) -> str:
    return f"""(SELECT *, CASE WHEN balance IS NOT NULL THEN rank() OVER (PARTITION BY balance IS NULL ORDER BY balance)
    + (count(*) OVER (PARTITION BY balance) - 1) / 2::DOUBLE END AS rank, count(balance) OVER () AS n FROM {_roll_sql(scale)})"""


def _clipped_sql(scale: int) -> str:
    z = f"(SELECT month, balance, {norm_ppf_sql('p')} AS z FROM (SELECT month, balance, CASE WHEN n >= 30 THEN (rank - 0.35::DOUBLE) / n END AS p FROM {_rank_sql(scale)}))"
    return f"(SELECT month, balance, CASE WHEN z IS NOT NULL THEN least(greatest(z, -3::DOUBLE), 3::DOUBLE) END AS spei FROM {z})"


ROLL_SQL, CLIPPED_SQL = _roll_sql(3), _clipped_sql(3)
LOGISTIC_SQL = f"""(WITH w AS (SELECT month, balance, n, 1 - (rank - 0.35::DOUBLE) / n AS above FROM {_rank_sql(3)}),
    m AS (SELECT avg(balance) AS w0, avg(above * balance) AS w1, avg(pow(above, 2) * balance) AS w2 FROM w WHERE balance IS NOT NULL),
    b AS (SELECT *, (2 * w1 - w0) / (6 * w1 - w0 - 6 * w2) AS b FROM m), g AS (SELECT *, (pi() / b) / sin(pi() / b) AS g FROM b),
    a AS (SELECT *, (w0 - 2 * w1) * b / g AS a FROM g), f AS (SELECT *, w0 - a * g AS c FROM a),
    p AS (SELECT month, CASE WHEN n < 30 OR balance IS NULL THEN NULL WHEN balance > c THEN least(greatest(1 / (1 + pow(a / (balance - c), b)), 1e-9), 1 - 1e-9::DOUBLE)
          ELSE 1e-9 END AS p FROM w, f)
    SELECT month, {norm_ppf_sql('p')} AS z FROM p)"""


@query(f"SELECT month, {q4('balance', 2)} AS balance FROM {ROLL_SQL}")
def rolling_sum_3(spark, sf_dir):
    m = monthly(spark, sf_dir)
    return m.select("month", f4(rolling_sum(F.col("precip") - F.col("et0"), Window.partitionBy("point").orderBy("month"), 3), 2).alias("balance"))


@query("""SELECT o_orderkey, o_orderpriority, rank() OVER (PARTITION BY o_orderpriority ORDER BY floor(o_totalprice / 1000))
    + (count(*) OVER (PARTITION BY o_orderpriority, floor(o_totalprice / 1000)) - 1) / 2::DOUBLE AS rank FROM orders""")
def rank_average(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.floor(F.col("o_totalprice") / 1000).alias("v"))
    return ranks.with_ranks(o, ["o_orderpriority"], "v").select("o_orderkey", "o_orderpriority", ranks.average_rank().alias("rank"))


@query(f"SELECT o_orderkey, {q4('cume_dist() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice)', 9)} AS share FROM orders")
def ecdf(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ranks.with_ranks(o, ["o_orderpriority"], "o_totalprice").select("o_orderkey", f4(ranks.ecdf(), 9).alias("share"))


ET0_SQL = f"(SELECT *, {et0_sql('temperature', 'relative_humidity', 'wind_speed', 'shortwave_radiation')} AS et0 FROM {OBS_SQL})"


def _with_et0(df: DataFrame) -> DataFrame:
    return df.withColumn("et0", et0_fao56(*map(F.col, ("temperature", "relative_humidity", "wind_speed", "shortwave_radiation"))))


@query(f"SELECT id, {q4('et0', 6)} AS et0 FROM {ET0_SQL}")
def et0(spark, sf_dir):
    return _with_et0(obs(spark, sf_dir)).select("id", f4("et0", 6).alias("et0"))


@query(f"SELECT {q4('corr(et0, temperature)', 8)} AS r, count(et0) AS n FROM {ET0_SQL}")
def et0_corr(spark, sf_dir):
    return _with_et0(obs(spark, sf_dir)).agg(f4(F.corr("et0", "temperature"), 8).alias("r"), F.count("et0").alias("n"))


def _spei(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spei(monthly(spark, sf_dir), ["point"], "month", "precip", "et0")


@query(f"SELECT month, {q4('balance', 2)} AS balance, {q4('spei', 8)} AS spei FROM {CLIPPED_SQL}")
def spei_3(spark, sf_dir):
    return _spei(spark, sf_dir).select("month", f4("balance", 2).alias("balance"), f4("spei", 8).alias("spei"))


@query(f"SELECT month, {q4('balance', 2)} AS balance, {q4('spei', 8)} AS spei FROM {_clipped_sql(12)}")
def spei_12(spark, sf_dir):
    found = spei(monthly(spark, sf_dir), ["point"], "month", "precip", "et0", 12)
    return found.select("month", f4("balance", 2).alias("balance"), f4("spei", 8).alias("spei"))


@query(f"SELECT month, {q4('least(greatest(z, -3::DOUBLE), 3::DOUBLE)', 5)} AS spei FROM {LOGISTIC_SQL} WHERE z IS NOT NULL")
def spei_logistic(spark, sf_dir):
    found = spei_log_logistic(monthly(spark, sf_dir), ["point"], "month", "precip", "et0")
    return found.filter("spei IS NOT NULL").select("month", f4("spei", 5).alias("spei"))


@query(f"SELECT count(*) AS months, count(spei) AS known, {q4('avg(spei)', 8)} AS mean, {q4('stddev_pop(spei)', 8)} AS deviation FROM {CLIPPED_SQL}")
def spei_summary(spark, sf_dir):
    return _spei(spark, sf_dir).agg(
        F.count("*").alias("months"), F.count("spei").alias("known"), f4(F.avg("spei"), 8).alias("mean"), f4(F.stddev_pop("spei"), 8).alias("deviation")
    )


@query(f"""SELECT month, {q4('spei', 8)} AS spei, CASE WHEN spei IS NULL THEN 'Unknown' WHEN spei <= -2 THEN 'Extreme Drought' WHEN spei <= -1.5 THEN 'Severe Drought'
    WHEN spei <= -1 THEN 'Moderate Drought' WHEN spei <= -0.5 THEN 'Mild Drought' WHEN spei < 0.5 THEN 'Normal' ELSE 'Wet' END AS level FROM {CLIPPED_SQL}""")
def drought_level_monthly(spark, sf_dir):
    return _spei(spark, sf_dir).select("month", f4("spei", 8).alias("spei"), drought_level(F.col("spei")).alias("level"))


NATION_SQL = """(SELECT c_nationkey AS point, date_trunc('month', o_orderdate)::TIMESTAMP AS month, sum(o_totalprice::DECIMAL(18, 2)) FILTER (o_orderkey % 3 > 0)::DOUBLE AS precip,
    sum(o_totalprice::DECIMAL(18, 2)) FILTER (o_orderkey % 3 = 0)::DOUBLE AS et0 FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


@query(f"""WITH b AS (SELECT point, month, CASE WHEN count(precip - et0) OVER w = 3 THEN sum(precip - et0) OVER w END AS balance FROM {NATION_SQL}
    WINDOW w AS (PARTITION BY point ORDER BY month ROWS 2 PRECEDING)),
    r AS (SELECT *, CASE WHEN balance IS NOT NULL AND count(balance) OVER (PARTITION BY point) >= 30 THEN (rank() OVER (PARTITION BY point, balance IS NULL ORDER BY balance)
    + (count(*) OVER (PARTITION BY point, balance) - 1) / 2::DOUBLE - 0.35::DOUBLE) / count(balance) OVER (PARTITION BY point) END AS p FROM b),
    z AS (SELECT *, {norm_ppf_sql('p')} AS z FROM r)
    SELECT point, month, {q4('balance', 2)} AS balance, CASE WHEN z IS NOT NULL THEN {q4('least(greatest(z, -3::DOUBLE), 3::DOUBLE)', 8)} END AS spei FROM z""")
def spei_refresh(spark, sf_dir):
    """The index of each nation by a first run and two merges of later months."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    third = F.col("o_orderkey") % 3
    months = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("point"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("t")).agg(
        F.sum(F.when(third > 0, price)).cast("double").alias("precip"), F.sum(F.when(third == 0, price)).cast("double").alias("et0")
    )
    scratch = Scratch(spark, "refresh")
    months = scratch.write(months, "months")
    kept = refresh.SpeiTable(spark, scratch.uri("kept"))
    for low, high in ((1900, 1998), (1998, 2000), (2000, 2100)):
        kept.merge(months.filter((F.year("t") >= low) & (F.year("t") < high)))
    return kept.values().select("point", F.col("t").alias("month"), f4("balance", 2).alias("balance"), f4("spei", 8).alias("spei"))


# --- quantile mapping -----------------------------------------------------------------------------------------------------

FIT_SQL = f"(SELECT quantile_cont(sim, {qm.levels()}) AS xp, quantile_cont(obs, {qm.levels()}) AS fp, count(*) AS n_pairs FROM {PAIRS_SQL})"
APPLY_SQL = f"""(SELECT date, obs, sim, CASE WHEN j = 0 THEN fp[1] WHEN j >= 100 THEN fp[100]
    ELSE fp[j] + (fp[j + 1] - fp[j]) / (xp[j + 1] - xp[j]) * (sim - xp[j]) END AS corrected
    FROM (SELECT p.*, xp, fp, len(list_filter(xp, lambda v: v <= sim)) AS j FROM {PAIRS_SQL} p, {FIT_SQL} f))"""


@query(f"SELECT generate_subscripts(xp, 1)::INT - 1 AS knot, {q4('unnest(xp)')} AS xp, {q4('unnest(fp)')} AS fp FROM {FIT_SQL}")
def qm_knots(spark, sf_dir):
    fitted = qm.fit(pairs(spark, sf_dir), "obs", "sim", [])
    return fitted.select(F.posexplode(F.arrays_zip("xp", "fp")).alias("knot", "k")).select("knot", f4("k.xp").alias("xp"), f4("k.fp").alias("fp"))


@query(f"SELECT n_pairs, len(xp)::INT AS knots FROM {FIT_SQL}")
def qm_fit(spark, sf_dir):
    return qm.fit(pairs(spark, sf_dir), "obs", "sim", []).select("n_pairs", F.size("xp").alias("knots"))


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pairs(spark, sf_dir)
    return qm.apply(both, qm.fit(both, "obs", "sim", []), "sim", [])


@query(f"SELECT date::TIMESTAMP AS date, sim, {q4('corrected', 2)} AS corrected FROM {APPLY_SQL}")
def qm_apply(spark, sf_dir):
    return _stamped(_applied(spark, sf_dir)).select("date", "sim", f4("corrected", 2).alias("corrected"))


def _metrics_sql(name: str, column: str) -> str:
    gap = f"({column} - obs)"
    return f"""{q4(f'avg({gap})', 2)} AS bias_{name}, {q4(f'sqrt(avg(pow({gap}, 2)))', 2)} AS rmse_{name}, {q4(f'avg(abs({gap}))', 2)} AS mae_{name},
    {q4(f'1 - avg(pow({gap}, 2)) / var_pop(obs)', 2)} AS r2_{name}"""


@query(f"SELECT {_metrics_sql('before', 'sim')}, {_metrics_sql('after', 'corrected')} FROM {APPLY_SQL}")
def qm_metrics(spark, sf_dir):
    found = qm.metrics(_applied(spark, sf_dir), "obs", "sim", "corrected", [])
    return found.select(*[f4(c, 2).alias(c) for c in found.columns])


BASE_SQL = f"""(SELECT l_returnflag, quantile_cont(l_extendedprice, {qm.levels()}) AS xp, quantile_cont(l_quantity * 1000, {qm.levels()}) AS fp FROM lineitem
    WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-12-31' GROUP BY 1)"""


@query(f"""SELECT l_returnflag, generate_subscripts(xp, 1)::INT - 1 AS knot, {q4('unnest(xp)')} AS xp, {q4('unnest(fp)')} AS fp FROM {BASE_SQL}""")
def qm_base_period(spark, sf_dir):
    both = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_extendedprice", (F.col("l_quantity") * 1000).alias("obs"))
    period = tuple(map(F.expr, ("l_shipdate", "timestamp_ntz'1995-01-01'", "timestamp_ntz'1998-12-31'")))
    fitted = qm.fit(both, "obs", "l_extendedprice", ["l_returnflag"], period=period)
    return fitted.select("l_returnflag", F.posexplode(F.arrays_zip("xp", "fp")).alias("knot", "k")).select("l_returnflag", "knot", f4("k.xp").alias("xp"), f4("k.fp").alias("fp"))


@query(f"""SELECT p.date::TIMESTAMP AS date, p.sim, {q4('m.o + (p.sim - m.s) * m.so / m.ss', 2)} AS corrected FROM {PAIRS_SQL} p,
    (SELECT avg(obs) AS o, avg(sim) AS s, stddev_pop(obs) AS so, stddev_pop(sim) AS ss FROM {PAIRS_SQL}) m""")
def variance_scaling(spark, sf_dir):
    found = qm.scaled(pairs(spark, sf_dir), "obs", "sim", [], variance=True)
    return _stamped(found).select("date", "sim", f4("corrected", 2).alias("corrected"))


#: Daily precipitation of a station and of a model by line status; the model drizzles on other days than the station.
RAIN_SQL = """(SELECT l_linestatus AS station, l_orderkey * 10 + l_linenumber AS day, greatest(l_quantity - 20, 0) AS obs,
    greatest(floor(l_extendedprice / 1000) - 12, 0)::DOUBLE AS sim FROM lineitem)"""
RAIN_FIT_SQL = f"""(SELECT station, quantile_cont(sim, {qm.levels()}) FILTER (wet) AS xp, quantile_cont(obs, {qm.levels()}) FILTER (obs > 0) AS fp FROM
    (SELECT *, row_number() OVER (PARTITION BY station ORDER BY sim DESC, day) <= count(*) FILTER (obs > 0) OVER (PARTITION BY station) AS wet FROM {RAIN_SQL}) GROUP BY 1)"""


@query(f"""SELECT station, day, {q4('CASE WHEN NOT wet THEN 0 WHEN j = 0 THEN fp[1] WHEN j >= 100 THEN fp[100] ELSE fp[j] + (fp[j + 1] - fp[j]) / (xp[j + 1] - xp[j]) * (sim - xp[j]) END', 3)} AS corrected
    FROM (SELECT r.*, xp, fp, len(list_filter(xp, lambda v: v <= sim)) AS j FROM
    (SELECT *, row_number() OVER (PARTITION BY station ORDER BY sim DESC, day) <= count(*) FILTER (obs > 0) OVER (PARTITION BY station) AS wet FROM {RAIN_SQL}) r JOIN {RAIN_FIT_SQL} f USING (station))""")
def qm_precipitation(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    rain = l.select(
        F.col("l_linestatus").alias("station"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("day"), F.greatest(F.col("l_quantity") - 20, F.lit(0)).alias("obs"),
        F.greatest(F.floor(F.col("l_extendedprice") / 1000) - 12, F.lit(0)).cast("double").alias("sim"),
    )
    found = qm.precipitation(rain, "obs", "sim", ["station"], "day")
    return found.select("station", "day", f4("corrected", 3).alias("corrected"))


# --- nested data, writes ----------------------------------------------------------------------------------------------------


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_id, value FROM events")
def zip_explode(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    block = F.floor(F.col("event_id") / 1000).alias("block")  # so that no array grows with a user's rows
    rows = e.groupBy("user_id", block).agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("rows"))
    before = F.sum(F.size("rows")).over(Window.partitionBy("user_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    payload = rows.select("user_id", F.coalesce(before, F.lit(0)).alias("before"), F.col("rows.event_id").alias("event_id"), F.col("rows.value").alias("value"))
    found = series.zip_explode(payload, ["event_id", "value"], ["user_id", "before"])
    return found.select("user_id", (F.col("before") + F.col("pos")).alias("pos"), "event_id", "value")


@query("SELECT * FROM orders WHERE o_orderkey % 3 = 1")
def insert_ignore(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old, new = o.filter("o_orderkey % 3 <> 1"), o.filter("o_orderkey % 3 <> 2")
    return writes.insert_ignore(old, new.union(new), ["o_orderkey"], ["o_totalprice"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders""")
def upsert_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    old = o.filter("o_orderkey % 3 <> 1")
    new = o.filter("o_orderkey % 3 <> 2").withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("o_totalprice", F.col("o_totalprice") + F.col("seq"))
    merged = writes.upsert(old, new, ["o_orderkey"], ["seq"], ["o_totalprice"])
    return merged.select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("SELECT o_orderkey, o_totalprice, NULL::DOUBLE AS soil_moisture FROM orders")
def schema_evolve(spark, sf_dir):
    from pyspark.sql.types import DoubleType, StructField, StructType

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return writes.add_missing_columns(o, StructType([StructField("o_totalprice", DoubleType()), StructField("soil_moisture", DoubleType())]))


FLAGS_SQL = """(SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS month, l_returnflag AS flag, CASE WHEN month(l_shipdate) % 5 <> ascii(l_returnflag) % 5
    THEN sum(l_quantity::DECIMAL(18, 2))::DOUBLE END AS quantity FROM lineitem GROUP BY 1, 2, month(l_shipdate))"""


@query(f"""WITH v AS (SELECT month, flag, quantity, CASE flag WHEN 'A' THEN 'N' WHEN 'N' THEN 'R' ELSE 'A' END AS near FROM {FLAGS_SQL}),
    p AS (SELECT v.month, v.flag, v.quantity, o.quantity AS other FROM v LEFT JOIN v o ON o.month = v.month AND o.flag = v.near),
    l AS (SELECT flag, regr_slope(quantity, other) AS slope, regr_intercept(quantity, other) AS base FROM p GROUP BY 1)
    SELECT month, flag, quantity, {q4('coalesce(quantity, base + slope * other)', 3)} AS quantity_filled FROM p JOIN l USING (flag)""")
def neighbour_fill(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("decimal(18,2)"))  # noqa: E741
    sums = series.monthly_sum(l, "l_shipdate", ["l_quantity"], ["l_returnflag"])
    gone = F.month("month") % 5 == F.ascii("l_returnflag") % 5
    sums = sums.select("month", F.col("l_returnflag").alias("flag"), F.when(~gone, F.col("l_quantity").cast("double")).alias("quantity"))
    near = spark.createDataFrame([("A", "N"), ("N", "R"), ("R", "A")], "flag string, neighbour string")
    found = quality.neighbour_fill(sums, near, "flag", "month", "quantity")
    return found.withColumn("quantity_filled", f4("quantity_filled", 3)).select("month", "flag", "quantity", "quantity_filled")


# --- the archive: landed units, resumed streams, bucketed history -----------------------------------------------------------

#: Observations of four years, so that there are units to prune.
YEARLY_SQL = f"""(SELECT latitude, longitude, "timestamp" - to_years((id % 4)::INT) AS ts, temperature FROM {OBS_SQL})"""
LANDED_SQL = f"""(SELECT h.latitude, h.longitude, hour AS "timestamp", {q4('temperature', 6)} AS temperature, chunk, year(hour)::INT AS year FROM
    (SELECT latitude, longitude, date_trunc('hour', ts)::TIMESTAMP AS hour, avg(temperature) AS temperature FROM {YEARLY_SQL} GROUP BY ALL) h JOIN
    (SELECT latitude, longitude, ((row_number() OVER (ORDER BY latitude, longitude) - 1) // 10)::INT AS chunk FROM (SELECT DISTINCT latitude, longitude FROM {OBS_SQL})) p USING (latitude, longitude))"""


def _units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Archive blocks of the observations, and the number of chunks."""
    moved = F.col("timestamp") - F.make_ym_interval((F.col("id") % 4).cast("int"))
    seen = obs(spark, sf_dir).select("latitude", "longitude", moved.alias("timestamp"), "temperature")
    points = Scratch(spark, "points").write(archive.numbered_points(seen), "points")
    return archive.blocks(seen, points), points.agg(F.max("chunk")).first()[0] + 1


def _seen(rows: DataFrame) -> DataFrame:
    return rows.filter("temperature IS NOT NULL").select("latitude", "longitude", "timestamp", f4("temperature", 6).alias("temperature"), "chunk", "year")


@query(f"""SELECT * FROM {LANDED_SQL} WHERE year = 2022 AND chunk BETWEEN 2 AND 8""")
def archive_scan(spark, sf_dir):
    landing = Scratch(spark, "landing").uri("units")
    archive.land(_units(spark, sf_dir)[0], landing)
    return _seen(archive.read_archive(spark, landing).filter("year = 2022 AND chunk BETWEEN 2 AND 8"))


@query(f"""SELECT latitude, longitude, "timestamp", temperature FROM {LANDED_SQL}""")
def archive_resume(spark, sf_dir):
    scratch = Scratch(spark, "resume")
    landing, target, check = scratch.uri("landing"), scratch.uri("target"), scratch.uri("checkpoint")
    units, chunks = _units(spark, sf_dir)
    half = F.lit(chunks // 2)
    for part in (F.col("chunk") < half, F.col("chunk") >= half):  # the second run goes on where the first one's checkpoint ends
        archive.land(units.filter(part), landing)
        ingest_archive(spark, landing, target, check, chunks, (2021, 2024)).awaitTermination()
    return _seen(spark.read.parquet(target).withColumns({"chunk": F.lit(0), "year": F.lit(0)})).drop("chunk", "year")


@query(f"""WITH h AS (SELECT latitude, longitude, year(ts)::INT AS year, date_trunc('hour', ts) AS hour FROM {YEARLY_SQL}),
    p AS (SELECT latitude, longitude, unnest([2020, 2021, 2022, 2023, 2024])::INT AS year FROM (SELECT DISTINCT latitude, longitude FROM h))
    SELECT latitude, longitude, year, CASE WHEN count(DISTINCT hour) > 10 THEN 'complete' WHEN count(hour) > 0 THEN 'partial' ELSE 'missing' END AS status
    FROM p LEFT JOIN h USING (latitude, longitude, year) GROUP BY 1, 2, 3""")
def running_completeness(spark, sf_dir):
    scratch = Scratch(spark, "completeness")
    moved = F.col("timestamp") - F.make_ym_interval((F.col("id") % 4).cast("int"))
    seen = obs(spark, sf_dir).select("latitude", "longitude", moved.alias("timestamp"), F.lit(True).alias("seen"), "id")
    completeness.expected_rows(seen, list(range(2020, 2025))).write.parquet(scratch.uri("landing"))
    for late in (False, True):  # each run goes on from the state of the one before
        seen.filter((F.col("id") % 3 == 0) == F.lit(late)).drop("id").write.mode("append").parquet(scratch.uri("landing"))
        completeness.follow(spark, scratch.uri("landing"), scratch.uri("changes"), scratch.uri("checkpoint"), complete_above=10).awaitTermination()
    return completeness.latest(spark.read.parquet(scratch.uri("changes"))).select("latitude", "longitude", "year", "status")


@query(f"""SELECT latitude, longitude, "timestamp", temperature FROM {OBS_SQL} QUALIFY row_number() OVER (PARTITION BY latitude, longitude, "timestamp" ORDER BY id % 3 = 1, id) = 1""")
def insert_bucketed(spark, sf_dir):
    rows = obs(spark, sf_dir).select("id", "latitude", "longitude", "timestamp", "temperature")
    kept = sinks.ObservationTable(spark, f"observations_{uuid.uuid4().hex[:12]}", Scratch(spark, "bucketed").uri("observations"))
    kept.insert(rows.filter("id % 3 <> 1"), ["id"])
    kept.insert(rows.filter("id % 3 <> 2"), ["id"])
    return kept.table().select("latitude", "longitude", "timestamp", "temperature")


# --- features ---------------------------------------------------------------------------------------------------------------


@query(f"SELECT month, {', '.join(f'lag(precip, {k}) OVER (ORDER BY month) AS precip_lag{k}' for k in range(1, 13))} FROM {MONTHLY_SQL}")
def lag_features(spark, sf_dir):
    return series.lags(monthly(spark, sf_dir), "precip", ["point"], "month").drop("point", "precip", "et0")


@query("SELECT month, " + ", ".join(
    f"CASE WHEN count(*) OVER w{k} = {k} THEN {q4(f'{f}(precip) OVER w{k} / {d}', 2)} END AS precip_{n}{k}" for k in (3, 6) for n, f, d in (("mean", "avg", "1"), ("var", "var_pop", "1e12"), ("max", "max", "1"))
) + f" FROM {MONTHLY_SQL} WINDOW w3 AS (ORDER BY month ROWS 2 PRECEDING), w6 AS (ORDER BY month ROWS 5 PRECEDING)")
def rolling_stats(spark, sf_dir):
    found = series.rolling_stats(monthly(spark, sf_dir), "precip", ["point"], "month")
    return found.select("month", *[f4(F.col(c) / (1e12 if "_var" in c else 1), 2).alias(c) for c in found.columns if c.startswith("precip_")])


@query(None)
def forecast_shapley(spark, sf_dir):
    """Daily order value of each priority from its lags and the season: the best of two settings by folds in time, and what each feature adds."""
    o = table(spark, sf_dir, "orders")
    daily = o.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("date")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    frame, names = forecast.lag_features(daily, "total", ["o_orderpriority"], "date", 4)
    frame = Scratch(spark, "forecast").write(frame, "frame")
    cuts = [F.lit(f"{year}-01-01").cast("date") for year in (1997, 1998, 1999)]
    model, _ = boosted.search(frame, "total", names, "date", cuts, [boosted.Setting(4, 2), boosted.Setting(4, 3)], 16)
    return boosted.explain(frame, model, ["o_orderpriority", "date"])


@query(f"SELECT month, {', '.join(f'(month(month) = {k})::INT AS month_{k}' for k in range(1, 13))} FROM {MONTHLY_SQL}")
def month_one_hot(spark, sf_dir):
    return monthly(spark, sf_dir).select("month", *series.one_hot_month(F.col("month")))


@query(f"SELECT month, {q4('sin(month(month) * 2 * pi() / 12)', 9)} AS month_sin, {q4('cos(month(month) * 2 * pi() / 12)', 9)} AS month_cos FROM {MONTHLY_SQL}")
def cyclical_time(spark, sf_dir):
    sine, cosine = series.cyclical_month(F.col("month"))
    return monthly(spark, sf_dir).select("month", f4(sine, 9).alias("month_sin"), f4(cosine, 9).alias("month_cos"))


@query(f"SELECT id, {q4(et0_sql('(temperature + 2)', 'relative_humidity', 'wind_speed', 'shortwave_radiation'), 6)} AS et0 FROM {OBS_SQL}")
def what_if(spark, sf_dir):
    changed = series.what_if(obs(spark, sf_dir).withColumn("precipitation", F.lit(1.0)), "precipitation", "temperature", -0.2, 2.0)
    return _with_et0(changed).select("id", f4("et0", 6).alias("et0"))


@query("""SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS month, l_returnflag, sum(l_quantity::DECIMAL(18, 2))::DOUBLE AS l_quantity FROM lineitem GROUP BY 1, 2""")
def monthly_resample(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("decimal(18,2)"))  # noqa: E741
    return series.monthly_sum(l, "l_shipdate", ["l_quantity"], ["l_returnflag"]).withColumn("l_quantity", F.col("l_quantity").cast("double"))
