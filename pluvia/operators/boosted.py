"""Boosted regression trees as grouped sums, searched over folds by time, and Shapley values of their forecasts.

A level of a tree is one aggregation: sums of residuals over (model, node, feature, bin). All models of a search, a fold and
a setting each, grow in the same pass over the rows; the driver sees models * nodes * features * bins sums and picks the
splits. Forecasts are plain column expressions of the exported trees.

Defined results: rows without a target are left out of fitting; a missing feature goes to the right at every split, in
fitting and forecasting. Where no split gains, a node stays whole. Without rows the forecast is 0.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.functions.et0 import known
from pluvia.operators.ranks import quantiles
from pluvia.session import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS, RIDGE, KEEP_EVERY = 32, 1.0, 4


@dataclass(frozen=True)
class Setting:
    trees: int = 30
    depth: int = 3
    rate: float = 0.2
    least: int = 5  # rows of a leaf


@dataclass
class Tree:
    """Heap order: ``feature`` (-1 in a leaf), ``cut`` (left if at most), ``value`` of the leaves, and ``cover``, the training rows."""

    feature: dict[int, int] = field(default_factory=dict)
    bin: dict[int, int] = field(default_factory=dict)
    cut: dict[int, float] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)
    cover: dict[int, int] = field(default_factory=dict)


@dataclass
class Model:
    features: list[str]
    setting: Setting
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def predicted(self) -> Column:
        """The forecast over the feature columns."""

        def node(tree: Tree, at: int) -> Column:
            if at not in tree.feature:
                return F.lit(tree.value.get(at, 0.0))
            goes_left = known(F.col(self.features[tree.feature[at]]).cast("double")) <= tree.cut[at]
            return F.when(goes_left, node(tree, 2 * at + 1)).otherwise(node(tree, 2 * at + 2))

        return sum((node(t, 0) for t in self.trees), F.lit(self.base))


def bin_edges(frame: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Distinct inner quantiles of each feature, exact."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), known(F.col(c).cast("double")).alias("x")) for i, c in enumerate(features)])).alias("e")
    found = quantiles(frame.select(each).select("e.*"), ["i"], "x", bins + 1)
    edges = {r.i: sorted(set(r.q[1:-1])) for r in found.collect()}  # a row a feature
    return [edges.get(i, []) for i in range(len(features))]


def _binned(features: list[str], edges: list[list[float]]) -> Column:
    def of(name: str, cuts: list[float]) -> Column:
        x = known(F.col(name).cast("double"))
        below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < x)) if cuts else F.lit(0)
        return F.when(x.isNull(), len(cuts)).otherwise(below).cast("int")

    return F.array(*[of(c, e) for c, e in zip(features, edges)])


def _node(tree: Tree, depth: int, leaf, at: int = 0) -> Column:
    """An expression over the bins: ``leaf(at)`` of the node that a row comes to."""
    if at not in tree.feature or not depth:
        return leaf(at)
    goes_left = F.get("b", F.lit(tree.feature[at])) <= tree.bin[at]
    return F.when(goes_left, _node(tree, depth - 1, leaf, 2 * at + 1)).otherwise(_node(tree, depth - 1, leaf, 2 * at + 2))


def _split(tree: Tree, node: int, sums: np.ndarray, counts: np.ndarray, edges: list[list[float]], setting: Setting) -> None:
    """The best split of a node by (feature, bin) sums, if one gains; its children's values and covers, and its own."""
    total, n = sums[0].sum(), int(counts[0].sum())
    tree.cover[node], tree.value[node] = n, float(setting.rate * total / (n + RIDGE)) if n else 0.0
    best = (total**2 / (n + RIDGE) + 1e-9 * max(1.0, abs(total)), -1, -1)
    for f, cuts in enumerate(edges):
        left, below = np.cumsum(sums[f])[: len(cuts)], np.cumsum(counts[f])[: len(cuts)]
        gain = left**2 / (below + RIDGE) + (total - left) ** 2 / (n - below + RIDGE)
        gain[(below < setting.least) | (n - below < setting.least)] = -np.inf
        if len(gain) and gain.max() > best[0] * (1 + 1e-9):
            best = (gain.max(), f, int(gain.argmax()))
    if best[1] >= 0:
        f, k = best[1:]
        tree.feature[node], tree.bin[node], tree.cut[node] = f, k, float(edges[f][k])
        for child, g, m in ((2 * node + 1, sums[f][: k + 1].sum(), counts[f][: k + 1].sum()), (2 * node + 2, sums[f][k + 1 :].sum(), counts[f][k + 1 :].sum())):
            tree.cover[child], tree.value[child] = int(m), float(setting.rate * g / (m + RIDGE))


def fit(frame: DataFrame, target: str, features: list[str], settings: list[Setting], trained: list[Column], bins: int = BINS) -> list[Model]:
    """A model a pair of setting and condition, grown side by side; a model learns from the rows that meet its condition."""
    scratch = Scratch(frame.sparkSession, "boosted")
    y = known(F.col(target).cast("double"))
    rows = frame.filter(y.isNotNull())
    edges = bin_edges(rows, features, bins)
    wide = max((len(e) for e in edges), default=0) + 1
    rows = scratch.write(rows.select(y.alias("y"), _binned(features, edges).alias("b"), F.array(*[F.coalesce(c, F.lit(False)) for c in trained]).alias("in")), "rows")
    models = [Model(features, s) for s in settings]
    means = rows.agg(*[F.avg(F.when(F.get("in", F.lit(m)), F.col("y"))).alias(str(m)) for m in range(len(models))]).first()
    for m, model in enumerate(models):
        model.base = float(means[m] or 0.0)
    rows = rows.withColumns({f"p{m}": F.lit(model.base) for m, model in enumerate(models)})
    for k in range(max((s.trees for s in settings), default=0)):
        growing = [m for m, s in enumerate(settings) if k < s.trees]
        for m in growing:
            models[m].trees.append(Tree())
        for level in range(max(settings[m].depth for m in growing)):
            going = [m for m in growing if level < settings[m].depth]
            parts = []
            for m in going:
                tree = models[m].trees[-1]
                at = F.lit(0) if not level else _node(tree, level, lambda at, first=2**level - 1: F.lit(at if at >= first else -1))
                parts.append(F.when(F.get("in", F.lit(m)) & (at >= 0), F.struct(F.lit(m).alias("m"), at.alias("at"), (F.col("y") - F.col(f"p{m}")).alias("r"))))
            each = rows.select("b", F.explode(F.array_compact(F.array(*parts))).alias("e")).select("e.*", F.posexplode("b").alias("f", "bin"))
            got = each.groupBy("m", "at", "f", "bin").agg(F.sum("r").alias("r"), F.count("*").alias("n")).toArrow()  # models * nodes * features * bins at most
            m_, at_, f_, bin_, r_, n_ = (got.column(c).to_numpy() for c in ("m", "at", "f", "bin", "r", "n"))
            for m in going:
                for node in np.unique(at_[m_ == m]):
                    mine = (m_ == m) & (at_ == node)
                    sums, counts = np.zeros((len(features), wide)), np.zeros((len(features), wide))
                    sums[f_[mine], bin_[mine]], counts[f_[mine], bin_[mine]] = r_[mine], n_[mine]
                    _split(models[m].trees[-1], int(node), sums, counts, edges, settings[m])
        grown = {m: models[m].trees[-1] for m in growing}
        rows = rows.withColumns({f"p{m}": F.col(f"p{m}") + _node(t, settings[m].depth, lambda at, t=t: F.lit(t.value.get(at, 0.0))) for m, t in grown.items()})
        if k % KEEP_EVERY == KEEP_EVERY - 1:  # else expressions grow with the trees
            rows = scratch.write(rows, f"rows-{k}")
    scratch.drop()
    return models


def search(frame: DataFrame, target: str, features: list[str], order: str, cuts: list, settings: list[Setting], bins: int = BINS) -> tuple[Model, list[tuple[Setting, float]]]:
    """The model of the best setting, fitted on all rows, and each setting's root mean squared error over the folds.

    ``cuts`` are ascending instants: fold k learns from the rows before cut k and is measured on those from there to the
    next cut, so no row is judged by what came after it.
    """
    folds = [(F.col(order) < a, (F.col(order) >= a) & (F.col(order) < b)) for a, b in zip(cuts, cuts[1:])]
    pairs = [(s, f) for s in settings for f in folds]
    models = fit(frame, target, features, [s for s, _ in pairs], [f[0] for _, f in pairs], bins)
    errors = [F.avg(F.when(f[1], (known(F.col(target).cast("double")) - m.predicted()) ** 2)).alias(str(i)) for i, ((_, f), m) in enumerate(zip(pairs, models))]
    row = frame.agg(*errors).first()
    scores = []
    for i, s in enumerate(settings):
        of = [row[i * len(folds) + k] for k in range(len(folds))]
        scores.append((s, float(np.sqrt(np.mean([e for e in of if e is not None]))) if any(e is not None for e in of) else float("inf")))
    best = min(range(len(settings)), key=lambda i: scores[i][1])
    return fit(frame, target, features, [settings[best]], [F.lit(True)], bins)[0], scores


def _paths(tree: Tree, at: int = 0, path: tuple = ()) -> Iterator[tuple[float, tuple]]:
    """Each leaf's value and path: (feature, cut, goes left, share of the cover)."""
    if at not in tree.feature:
        yield tree.value.get(at, 0.0), path
        return
    for child, left in ((2 * at + 1, True), (2 * at + 2, False)):
        share = tree.cover.get(child, 0) / max(tree.cover[at], 1)
        yield from _paths(tree, child, (*path, (tree.feature[at], tree.cut[at], left, share)))


def shapley(model: Model, x: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean forecast, by the trees' covers, and each feature's Shapley value (row, feature).

    Path by path: of the features on a leaf's path, those in a coalition say whether the row goes there and the others
    count by their share of the cover. Coalitions of equal size come from the coefficients of a product over the features.
    """
    mean, values = model.base, np.zeros(x.shape)
    for tree in model.trees:
        for leaf, path in _paths(tree):
            on, share = {}, {}
            for f, cut, left, part in path:
                goes = x[:, f] <= cut  # a missing value compares as false and goes right
                on[f] = on.get(f, True) & (goes if left else ~goes)
                share[f] = share.get(f, 1.0) * part
            mean += leaf * float(np.prod(list(share.values())))
            size = len(on)
            for i in on:
                sums = np.zeros((len(x), size))
                sums[:, 0] = 1.0
                for j in on:
                    if j != i:
                        sums[:, 1:] = sums[:, 1:] * share[j] + sums[:, :-1] * on[j][:, None]
                        sums[:, 0] *= share[j]
                weight = np.array([factorial(k) * factorial(size - 1 - k) / factorial(size) for k in range(size)])
                values[:, i] += leaf * (on[i] - share[i]) * (sums @ weight)
    return mean, values


def explain(frame: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """keys, predicted, mean and a Shapley value for each feature (``shap_<feature>``); they add up to the forecast."""
    names = [f"shap_{f}" for f in model.features]
    kept = frame.select(*keys, model.predicted().alias("predicted"), *[known(F.col(f).cast("double")).alias(f"__{f}") for f in model.features])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keys) + 1
            x = np.column_stack([batch.column(n + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(names))])
            mean, values = shapley(model, x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(np.full(len(x), mean)), *(pa.array(v) for v in values.T)], [*keys, "predicted", "mean", *names])

    kinds = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in keys)
    return kept.mapInArrow(run, f"{kinds}, predicted double, mean double, " + ", ".join(f"`{n}` double" for n in names))
