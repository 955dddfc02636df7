"""Forests that grow side by side: each tree is a plain one of its own draws, and forests nest."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from logforge.functions.lineage import materialise
from logforge.operators import forests, models, sampling, trees


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 4)).round(1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.5, 300) > 0.6).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, x array<double>, label int")
    return materialise(sampling.folds(df.select("id", array_to_vector("x").alias("features"), "label"), "label", "id"))


def _plain(bins, y, times, weights, tree, depth, place=1):
    """{place: share of class 1} of every node."""
    n = np.array([times[y == c].sum() for c in (0, 1)])
    w = n * weights
    found = {place: w[1] / w.sum()}
    if place >= 1 << depth or n.sum() < 2 * tree.least or n.min() == 0:
        return found
    gini = lambda m: 2 * m[0] * m[1] / m.sum() if m.sum() else 0.0
    best = (1e-12, None)
    for f in forests.chosen(np.array([place]), tree.number, tree.seed, 4, 2)[0]:
        for c in range(trees.BINS - 1):
            left = np.array([times[(bins[:, f] <= c) & (y == k)].sum() for k in (0, 1)])
            if min(left.sum(), (n - left).sum()) >= tree.least:
                gain = (gini(w) - gini(left * weights) - gini((n - left) * weights)) / w.sum()
                if gain > best[0] + 1e-9:
                    best = gain, (f, c)
    if best[1] is not None:
        go = bins[:, best[1][0]] <= best[1][1]
        for side, at in ((go, 2 * place), (~go, 2 * place + 1)):
            found |= _plain(bins[side], y[side], times[side], weights, tree, depth, at)
    return found


@pytest.mark.parametrize("nodes", [65_536, 7])
def test_forests_are_plain_ones_and_nest(rows, monkeypatch, nodes):
    monkeypatch.setattr(forests, "NODES", nodes)
    bounds = trees.edges(rows, "features", 4)
    for least in (20_000, 100):  # one partition, and several
        held = trees.prepared(rows, bounds, 300, least)
        grown = [forests.Bagged(f, least, k) for least in (1, 5) for f in (0, 3) for k in range(3)]
        forests.grow(held, grown, 6, 2)
        parts = held.collect()
        bins, y, fold, key = (np.concatenate([p[n] for p in parts]) for n in ("bins", "y", "fold", "key"))
        for t in grown[::5]:
            keep = fold != t.out
            weights = keep.sum() / (2 * np.bincount(y[keep], minlength=2))
            times = forests.bag(key, t.number, t.seed) * keep
            want = _plain(bins[times > 0], y[times > 0], times[times > 0], weights, t, 6)
            assert dict(zip(t.place.tolist(), t.value.tolist())) == pytest.approx(want)
        short = [forests.Bagged(0, 1, k) for k in range(2)]
        forests.grow(held, short, 3, 2)
        same = forests.validated(held, [(short, 3), (grown[:2], 3), (grown[:3], 6)])
        assert same[0].tolist() == same[1].tolist() and same[2].sum() == (fold == 0).sum()
        held.unpersist()


def test_rows_are_drawn_as_poisson_numbers():
    times = forests.bag(np.arange(200_000), 3, 42)
    assert abs(times.mean() - 1) < 0.01 and abs((times == 0).mean() - np.exp(-1)) < 0.01 and abs(times.var() - 1) < 0.02


def test_search_of_forests_is_as_separate_fits(rows, monkeypatch):
    combinations = [{"numTrees": n, "maxDepth": d, "minInstancesPerNode": m} for n, d, m in ((10, 2, 1), (20, 8, 1), (20, 8, 5))]
    monkeypatch.setattr(models.CrossValidator, "fit", None)  # a fit for each combination and fold
    model, table = models.search_forests(rows, combinations)
    assert table.count() == 3 and model.stages[-1].getNumTrees in (10, 20)
    f1 = [r.f1 for r in table.collect()]
    assert f1[0] < max(f1) and max(f1) > 0.6
