from itertools import combinations
from math import factorial

import numpy as np
from pyspark.sql import functions as F

from pluvia.operators import boosted
from pluvia.plans import registry

NAMES = [f"x{i}" for i in range(6)]


def made(n=2000, seed=4):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, 6)), 3)
    y = 3 * (x[:, 0] > 0.3) + x[:, 1] * x[:, 2] + np.where(x[:, 3] > 0, x[:, 4], -1) + draw.normal(0, 0.1, n)
    return x, y


def frame(spark, x, y, holes=()):
    rows = [(i, *(None if (i, j) in holes else float(v) for j, v in enumerate(r)), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "t int, " + ", ".join(f"{n} double" for n in NAMES) + ", y double")


def single(x, y, setting, bins):
    """The same trees in one process, level by level."""
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)).tolist()[1:-1])) for j in range(x.shape[1])]
    base, p, trees = y.mean(), np.full(len(y), y.mean()), []
    for _ in range(setting.trees):
        at, tree = np.zeros(len(y), int), {}
        for level in range(setting.depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = at == node
                if not mine.any() or (node and node not in tree.get("open", {0})):
                    continue
                r = (y - p)[mine]
                best = (r.sum() ** 2 / (len(r) + 1) * (1 + 1e-9) + 1e-9 * max(1, abs(r.sum())), None)
                for f, cuts in enumerate(edges):
                    for c in cuts:
                        left = x[mine, f] <= c
                        if min(left.sum(), (~left).sum()) >= setting.least:
                            gain = r[left].sum() ** 2 / (left.sum() + 1) + r[~left].sum() ** 2 / ((~left).sum() + 1)
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, (f, c))
                if best[1]:
                    f, c = best[1]
                    tree[node] = (f, c)
                    tree.setdefault("open", {0}).update((2 * node + 1, 2 * node + 2))
                    at[mine] = np.where(x[mine, f] <= c, 2 * node + 1, 2 * node + 2)
        step = np.zeros(len(y))
        for node in np.unique(at):
            step[at == node] = setting.rate * (y - p)[at == node].sum() / ((at == node).sum() + 1)
        p = p + step
        trees.append({k: v for k, v in tree.items() if k != "open"})
    return base, trees, p


def test_fit_equals_a_single_process(spark):
    x, y = made()
    setting = boosted.Setting(5, 3, 0.3, 10)
    model = boosted.fit(frame(spark, x, y), "y", NAMES, [setting], [F.lit(True)], 16)[0]
    base, trees, p = single(x, y, setting, 16)
    assert abs(model.base - base) < 1e-9
    assert [{k: (t.feature[k], round(t.cut[k], 9)) for k in t.feature} for t in model.trees] == [{k: (f, round(c, 9)) for k, (f, c) in t.items()} for t in trees]
    got = [r.p for r in frame(spark, x, y).select("t", model.predicted().alias("p")).orderBy("t").collect()]
    assert np.abs(np.array(got) - p).max() < 1e-9


def value_of(model, x, known):
    """Expected forecast when only the features ``known`` are, by the trees' covers."""
    total = model.base
    for t in model.trees:

        def walk(at):
            if at not in t.feature:
                return t.value.get(at, 0.0)
            f, left, right = t.feature[at], 2 * at + 1, 2 * at + 2
            if f in known:
                return walk(left if x[f] <= t.cut[at] else right)
            return (t.cover[left] * walk(left) + t.cover[right] * walk(right)) / t.cover[at]

        total += walk(0)
    return total


def test_search_and_shapley_values(spark):
    x, y = made(800)
    df = frame(spark, x, y, {(3, 0), (5, 4), (700, 1)})
    settings = [boosted.Setting(6, 3, 0.4), boosted.Setting(2, 1, 0.1)]
    model, scores = boosted.search(df, "y", NAMES, "t", [300, 500, 800], settings, 16)
    assert [s for s, _ in scores] == settings and scores[0][1] < scores[1][1] and model.setting == settings[0]
    # a fold's model must be the one that its rows alone give
    alone = boosted.fit(df.filter("t < 300"), "y", NAMES, settings[1:], [F.lit(True)], 16)[0]
    assert abs(alone.base - np.mean(y[:300])) < 1e-9
    some = df.filter("t < 12 OR t = 700")
    got = {r.t: r for r in boosted.explain(some, model, ["t"]).collect()}
    for r in some.collect():
        row = np.array([np.nan if r[n] is None else r[n] for n in NAMES])
        f = got[r.t]
        assert abs(f.mean + sum(f[f"shap_{n}"] for n in NAMES) - f.predicted) < 1e-9
        assert abs(f.mean - value_of(model, row, set())) < 1e-9 and abs(f.predicted - value_of(model, row, set(range(6)))) < 1e-9
        for i in range(6):
            rest, want = [j for j in range(6) if j != i], 0.0
            for k in range(6):
                for c in combinations(rest, k):
                    want += factorial(k) * factorial(5 - k) / factorial(6) * (value_of(model, row, {*c, i}) - value_of(model, row, set(c)))
            assert abs(f[f"shap_x{i}"] - want) < 1e-9


def test_no_rows_constant_and_missing_targets(spark):
    x, y = made(60)
    df = frame(spark, x, y)
    none = boosted.fit(df.limit(0), "y", NAMES, [boosted.Setting(2)], [F.lit(True)])[0]
    assert [r.p for r in df.limit(1).select(none.predicted().alias("p")).collect()] == [0.0]
    flat = boosted.fit(df.withColumn("y", F.when(F.col("t") % 2 == 0, 5.0)), "y", NAMES, [boosted.Setting(2)], [F.lit(True)])[0]
    assert {round(r.p, 9) for r in df.select(flat.predicted().alias("p")).collect()} == {5.0}


def test_queries(spark, sf_dir):
    found = registry.queries()["forecast_shapley"](spark, sf_dir)
    rows = found.collect()
    assert rows and all(abs(r.predicted - r["mean"] - sum(r[c] for c in found.columns if c.startswith("shap_"))) < 1e-6 * max(1, abs(r.predicted)) for r in rows)
