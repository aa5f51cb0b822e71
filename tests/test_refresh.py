import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pluvia.functions.spei import spei
from pluvia.operators import refresh

KIND = "point long, t timestamp_ntz, precip double, et0 double"


def made(months, seed=2):
    draw = random.Random(seed)
    rows = []
    for m in range(months):
        at = dt.datetime(1990 + m // 12, m % 12 + 1, 1)
        for p in (1, 2, None, 3):
            if p != 3 or m > 40:  # a point that comes later
                rows.append((p, at, None if draw.random() < 0.03 else float(draw.randrange(6 if p == 2 else 900)), float(draw.randrange(3)) if m % 17 else float("nan")))
    return rows


def close(got, want):
    key = lambda r: (r.point is not None, r.point or 0, r.t)
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert [key(r) for r in got] == [key(r) for r in want]
    for g, w in zip(got, want):
        for c in ("balance", "p", "spei"):
            assert (g[c] is None) == (w[c] is None) and (g[c] is None or abs(g[c] - w[c]) < 1e-12), (g, w)


@pytest.mark.parametrize("by_month", [False, True])
def test_merges_equal_a_full_run(spark, tmp_path, by_month):
    rows = made(40 if not by_month else 400)
    start = 34 if not by_month else 396
    at = lambda m: dt.datetime(1990 + m // 12, m % 12 + 1, 1)
    kept = refresh.SpeiTable(spark, f"file://{tmp_path}/kept", 3, by_month, 4)
    kept.merge(spark.createDataFrame([r for r in rows if r[1] < at(start)], KIND))
    for m in range(start, start + (6 if not by_month else 3), 1 if not by_month else 2):
        kept.merge(spark.createDataFrame([r for r in rows if at(m) <= r[1] < at(m + (1 if not by_month else 2))], KIND))
    upto = [r for r in rows if r[1] < at(start + (6 if not by_month else 4))]
    close(kept.values(), spei(spark.createDataFrame(upto, KIND), ["point"], "t", "precip", "et0", 3, by_month))


def test_a_point_that_comes_later_and_a_merge_that_died(spark, tmp_path, monkeypatch):
    rows = made(80, 5)
    cut = dt.datetime(1993, 6, 1)
    kept = refresh.SpeiTable(spark, f"file://{tmp_path}/kept", 2, False, 4)
    kept.create(spark.createDataFrame([r for r in rows if r[1] < cut], KIND))
    more = spark.createDataFrame([r for r in rows if r[1] >= cut], KIND)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(refresh.SpeiTable, "_tail", lambda self, rows: rows.select(F.raise_error(F.lit("killed")).cast("long").alias("point"), "t", "water"))
        with pytest.raises(Exception, match="killed"):
            kept.merge(more)
    assert kept.version() == 1
    kept.merge(more)
    kept.merge(more.limit(0))
    close(kept.values(), spei(spark.createDataFrame(rows, KIND), ["point"], "t", "precip", "et0", 2))
    plan = kept.merged(spark.createDataFrame([(1, 0, 2.0, cut)], "point long, season int, value double, t timestamp_ntz"))._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
