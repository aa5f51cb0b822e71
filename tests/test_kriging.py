import numpy as np

from pluvia.operators import blocks, kriging
from pluvia.plans import registry
from pluvia.session import Scratch


def made(seed, n):
    draw = np.random.default_rng(seed)
    at = draw.random((n, 2)) * 4
    return at, np.sin(at[:, 0]) + np.cos(2 * at[:, 1]) + draw.normal(0, 0.05, n)


def frames(spark, at, values, targets):
    points = spark.createDataFrame([(i, float(y), float(x), float(v)) for i, ((y, x), v) in enumerate(zip(at, values))], "key long, lat double, lon double, value double")
    return spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(targets)], "key long, lat double, lon double"), points


def test_variogram_and_estimates_equal_a_direct_solve(spark):
    at, values = made(1, 50)
    targets = np.vstack([np.random.default_rng(2).random((40, 2)) * 4, at[:5]])
    asked, points = frames(spark, at, values, targets)
    reach = 1.5
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    bins = {}
    for i in range(50):
        for j in range(i + 1, 50):
            if d[i, j] <= reach:
                bins.setdefault(min(int(d[i, j] / (reach / kriging.BINS)), kriging.BINS - 1), []).append((d[i, j], (values[i] - values[j]) ** 2 / 2))
    got = {r.bin: (r.n, r.distance, r.gamma) for r in kriging.variogram(points, reach).collect()}
    assert got.keys() == bins.keys()
    assert all(np.allclose(got[b], (len(p), *np.mean(p, axis=0))) for b, p in bins.items())
    curve = kriging.Curve(0.02, 1.3, 2.0)
    found = {r.a_key: r for r in kriging.krige(asked, points, reach, 50, curve).collect()}
    gamma = lambda h: np.where(h > 0, 0.02 + 1.3 * (1 - np.exp(-3 * h / 2.0)), 0)
    for k, t in enumerate(targets):
        h = np.sqrt(((at - t) ** 2).sum(1))
        near = np.flatnonzero(h <= reach)
        a = np.block([[gamma(d[np.ix_(near, near)]), np.ones((len(near), 1))], [np.ones((1, len(near))), np.zeros((1, 1))]])
        w = np.linalg.inv(a) @ np.append(gamma(h[near]), 1)
        assert found[k].n == len(near) and abs(found[k].value - w[:-1] @ values[near]) < 1e-9
        assert abs(found[k].variance - max(0, w @ np.append(gamma(h[near]), 1))) < 1e-9
    few = kriging.krige(asked, points, reach, 4, curve).collect()
    assert max(r.n for r in few) == 4


def test_fitted_kriging_beats_the_mean_on_held_out_points(spark):
    at, values = made(3, 400)
    asked, points = frames(spark, at[:300], values[:300], at[300:])
    found = {r.a_key: r.value for r in kriging.krige(asked, points, 1.0).collect()}
    error = np.sqrt(np.mean([(found[i] - values[300 + i]) ** 2 for i in range(100)]))
    assert error < 0.15 < np.std(values[300:])


def test_missing_doubled_constant_and_lone_points(spark):
    nan = float("nan")
    rows = [(1, 0.0, 0.0, 5.0), (2, 0.0, 0.0, 7.0), (3, 1.0, 0.0, 6.0), (4, None, 0.0, 9.0), (5, 0.0, nan, 9.0), (6, 0.5, 0.5, None), (7, 0.5, 0.5, nan)]
    points = spark.createDataFrame(rows, "key long, lat double, lon double, value double")
    asked = spark.createDataFrame([(1, 0.5, 0.0), (1, 0.5, 0.0), (2, 50.0, 0.0), (3, None, 1.0), (4, 0.0, 0.0)], "key long, lat double, lon double")
    got = sorted(((r.a_key, r.n, None if r.value is None else round(r.value, 9)) for r in kriging.krige(asked, points, 2.0).collect()), key=repr)
    assert got == [(1, 2, 6.0), (1, 2, 6.0), (2, 0, None), (3, 0, None), (4, 2, 6.0)]
    assert kriging.krige(asked, points.limit(0), 2.0).filter("value IS NOT NULL").count() == 0
    assert kriging.krige(asked.limit(0), points, 2.0).count() == 0
    flat = kriging.Curve.fit(np.array([0.1, 0.2]), np.zeros(2), np.array([5.0, 5.0]), 1.0)
    assert flat.nugget + flat.sill > 0


def test_query(spark, sf_dir):
    found = registry.queries()["kriging"](spark, sf_dir)
    assert found.columns == ["a_key", "n", "value"] and found.count() == spark.read.parquet(f"{sf_dir}/supplier.parquet").count()


def test_nearest_points_in_widening_bands_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kriging, "CROWD", 4)
    draw = np.random.default_rng(4)
    at = np.vstack([draw.integers(0, 40, (300, 2)) / 40, draw.random((200, 2)) / 100])  # ties, and a crowd in a corner
    at = np.unique(at, axis=0)
    asked, points = frames(spark, at, np.arange(len(at)), np.vstack([draw.random((50, 2)), at[:5], [[9.0, 9.0]]]))
    assert kriging._first_band(points, 0.5) > 1
    got = {r.row: [p.value for p in r.near] for r in kriging.nearest_points(asked, points, 0.5, 6, Scratch(spark, "near")).collect()}
    for r in asked.collect():
        d = np.sqrt((r.lat - at[:, 0]) ** 2 + (r.lon - at[:, 1]) ** 2)
        assert got[r.key] == [k for k in np.lexsort((np.arange(len(at)), d)).tolist() if d[k] <= 0.5][:6]
    assert len(got) == 56
    assert "Window" not in kriging.krige(asked, points, 0.5)._jdf.queryExecution().toString()  # which ranked all pairs in reach


def test_variogram_of_points_in_rows_shuffles_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PART", 500)
    draw = np.random.default_rng(5)
    at = np.unique(np.column_stack([draw.integers(0, 3, 6000) / 50, draw.integers(0, 60_000, 6000) / 1_000_000]), axis=0)
    values = 1 + at[:, 1] + draw.random(len(at)) / 10
    _, points = frames(spark, at, values, at[:1])
    looked, reach = [], 0.05
    found = kriging.variogram(points, reach)
    assert "b_key" not in found._jdf.queryExecution().toString()
    got = {r.bin: (r.n, r.distance, r.gamma) for r in found.collect()}
    y, x = (np.abs(at[:, None, i] - at[None, :, i]) for i in (0, 1))
    d = np.sqrt(y * y + x * x)
    far = np.triu((y <= reach) & (x <= reach) & (d <= reach), 1)
    place = np.minimum(np.floor(d[far] / (reach / kriging.BINS)), kriging.BINS - 1).astype(int)
    gap = ((values[:, None] - values[None]) ** 2)[far] / 2
    n = np.bincount(place, minlength=kriging.BINS)
    assert {b: v[0] for b, v in got.items()} == {b: k for b, k in enumerate(n.tolist()) if k}
    for b, (_, distance, gamma) in got.items():
        assert abs(distance - d[far][place == b].mean()) < 1e-13 and abs(gamma - gap[place == b].mean()) < 1e-13
    for own in (True, False):  # runs are summed up, and few pairs of points looked at
        one = kriging.Bins(blocks.Points(np.arange(len(at)), *at.T, values), reach, kriging.BINS)
        monkeypatch.setattr(one, "_count", lambda left, right, distance, close, own: looked.append(close.sum()))
        one.add(blocks.Points(np.arange(len(at)), *at.T, values), own)
    assert sum(looked) < 2 * far.sum()
