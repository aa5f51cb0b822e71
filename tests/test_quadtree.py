import numpy as np
import pytest

from pluvia.operators import quadtree, spatial


def brute(a, b, band):
    """All pairs, a block of seekers at a time."""
    found = {}
    order = np.lexsort((b[:, 0], b[:, 2], b[:, 1]))
    b = b[order]
    for i in range(0, len(a), 500):
        part = a[i : i + 500]
        d = np.sqrt((part[:, None, 1] - b[None, :, 1]) ** 2 + (part[:, None, 2] - b[None, :, 2]) ** 2)
        at = d.argmin(1)  # the first of equal ones, which are in order of lat, lon, key
        for k, j in enumerate(at):
            if d[k, j] < band:
                found[int(part[k, 0])] = (int(b[j, 0]), d[k, j])
    return found


def frame(spark, rows):
    return spark.createDataFrame([(int(k), float(y), float(x)) for k, y, x in rows], "key long, lat double, lon double")


def points(draw, n, kind):
    keys = np.arange(n)
    if kind == "crowd":
        at = 35.0 + draw.random((n, 2)) * 0.001
        at[: n // 2] = 35.0005 + draw.random((n // 2, 2)) * 1e-6
    elif kind == "ties":
        at = draw.integers(0, 6, (n, 2)) / 4
    else:
        at = draw.normal(0, 1, (n, 2))
    return np.column_stack([keys, at])


@pytest.mark.parametrize("kind", ["crowd", "ties", "spread"])
def test_nearest_equals_all_pairs(spark, kind):
    draw = np.random.default_rng(7)
    a, b = points(draw, 1500, kind), points(draw, 1500, kind)
    b[:, 0] = draw.permutation(len(b))
    for band in (0.3, 0.01):
        got = {r.a_key: (r.b_key, r.distance) for r in spatial.nearest_in_band(frame(spark, a), frame(spark, b), band).collect()}
        want = brute(a, b, band)
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_a_hundred_thousand_points_in_one_cell(spark):
    draw = np.random.default_rng(3)
    n = 100_000
    b = np.column_stack([np.arange(n), 40 + draw.random((n, 2)) * 0.01])
    a = np.column_stack([np.arange(n), 40 + draw.random((n, 2)) * 0.01])
    a[: n // 3, 1:] = a[0, 1:]  # a third at one place
    got = {r.a_key: r.b_key for r in spatial.nearest_in_band(frame(spark, a), frame(spark, b), 0.25).collect()}
    assert len(got) == n and len({got[i] for i in range(n // 3)}) == 1
    some = np.r_[0:5, n // 3 : n : 997]
    assert {int(a[i, 0]): got[int(a[i, 0])] for i in some} == {k: v[0] for k, v in brute(a[some], b, 0.25).items()}


def test_nulls_empty_sides_and_bounds(spark):
    none = spark.createDataFrame([(1, None, 2.0), (2, 1.0, float("nan")), (3, 0.0, 0.0), (3, 0.0, 0.0)], "key long, lat double, lon double")
    other = spark.createDataFrame([(9, 0.0, 0.5), (8, None, None), (7, 0.5, 0.0)], "key long, lat double, lon double")
    assert sorted(tuple(r) for r in quadtree.nearest_within(none, other, 1.0).collect()) == [(3, 9, 0.5), (3, 9, 0.5)]
    assert quadtree.nearest_within(none, other, 0.5).collect() == []  # nearer than the band, not at it
    assert quadtree.nearest_within(none, other.limit(0), 1.0).collect() == quadtree.nearest_within(none.limit(0), other, 1.0).collect() == []
