"""Many models in shared passes: each equals what it would be by itself, by plain numpy or by Spark ML."""

import json

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from logforge.functions import passes, skew
from logforge.functions.lineage import materialise
from logforge.operators import aggregates, cluster, cluster_quality, features, linear, models, outliers, sampling, trees


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 4)).round(1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.5, 240) > 0.6).astype(int)
    x[:, 3] = 7.0
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, x array<double>, label int")
    return materialise(sampling.folds(df.select("id", array_to_vector("x").alias("features"), "label"), "label", "id")).repartition(3).persist()


def test_logistic_fits_are_sparks(spark, rows):
    """All penalties and folds together equal separate fits."""
    df = rows.withColumn("fold", F.col("fold").cast("int"))
    flat = df.select("features", "label", "fold")
    held = passes.blocks(flat.select(vector_to_array("features").alias("x"), F.col("label").alias("y"), "fold"), 240)
    fits = [linear.Fit(f, p, l1) for f in (-1, 0, 3) for p in (0.3, 0.02) for l1 in (0.0, 0.5, 1.0)]
    thetas, held_scales, n_passes = linear.fit_many(held, fits)
    assert n_passes < 40
    for k in (0, 1, 2, 4, 8, 11, 17):
        f = fits[k]
        train = models.weighted(df.where(F.col("fold") != f.out))
        scaler = models._scaler(train)
        lr = LogisticRegression(regParam=f.penalty, elasticNetParam=f.l1, standardization=False, weightCol="weight", featuresCol="scaled", labelCol="label", maxIter=500, tol=1e-10)
        fitted = lr.fit(scaler.transform(train))
        np.testing.assert_allclose(thetas[k, 1:], fitted.coefficients.toArray(), atol=1e-4)
        assert abs(thetas[k, 0] - fitted.intercept) < 1e-4
    held.unpersist()
    counts = linear.validated(passes.blocks(flat.select(vector_to_array("features").alias("x"), F.col("label").alias("y"), "fold"), 240), fits, thetas, held_scales)
    assert counts[6:].sum(axis=1).tolist() == [df.where(F.col("fold") == f.out).count() for f in fits[6:]]


def _blocks(rows):
    bounds = trees.edges(rows, "features", 4)
    return trees.prepared(rows, bounds, 240), bounds


def _plain_tree(bins, y, w, depth, least, kind):
    """A tree by recursion over the rows: {path: share of class 1}."""
    def impurity(w, w1):
        p = w1 / w if w else 0
        return 2 * p * (1 - p) if kind == "gini" else -sum(q * np.log2(q) for q in (p, 1 - p) if q > 0)

    out = {}

    def grow(at, path):
        total, one = w[at].sum(), w[at][y[at] == 1].sum()
        out[path] = one / total
        if len(path) == depth or len(at) < 2 * least or one in (0, total):
            return
        found = []
        for f in range(bins.shape[1]):
            for c in range(trees.BINS - 1):
                left = bins[at, f] <= c
                if least <= left.sum() <= len(at) - least:
                    l, r = at[left], at[~left]
                    gain = (total * impurity(total, one) - sum(w[s].sum() * impurity(w[s].sum(), w[s][y[s] == 1].sum()) for s in (l, r))) / total
                    found.append((gain, l, r))
        most = max((g for g, *_ in found), default=0)
        if most > 1e-12:
            _, l, r = next(x for x in found if x[0] >= most - 1e-9 * (1 + most))
            grow(l, path + "l")
            grow(r, path + "r")

    grow(np.arange(len(y)), "")
    return out


def _paths(tree):
    out, todo = {}, [(0, "")]
    while todo:
        node, path = todo.pop()
        out[path] = tree.value[node]
        if tree.feature[node] >= 0:
            todo += [(tree.left[node], path + "l"), (tree.left[node] + 1, path + "r")]
    return out


def test_trees_are_plain_ones_and_nest(spark, rows):
    held, _ = _blocks(rows)
    kinds = [(least, kind, f) for least in (1, 5) for kind in ("gini", "entropy") for f in (0, 2, -1)]
    runs = [trees.Run(f, 30, least, kind) for least, kind, f in kinds]
    trees.grow(held, runs)
    parts = held.collect()
    bins, y, fold = (np.concatenate([p[n] for p in parts]) for n in ("bins", "y", "fold"))
    for (least, kind, f), run in zip(kinds, runs):
        keep = fold != f
        w = np.where(y > 0, keep.sum() / 2 / (y[keep] == 1).sum(), keep.sum() / 2 / (y[keep] == 0).sum())
        want = _plain_tree(bins[keep], y[keep], w[keep], 30, least, kind)
        got = _paths(run.trees[0])
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    for depth in (1, 3, 5):  # a tree cut at a depth is the tree that is grown so deep
        short = trees.Run(0, depth, 1, "gini")
        trees.grow(held, [short])
        np.testing.assert_array_equal(trees.scores(short, bins), trees.scores(runs[0], bins, depth=depth))
    held.unpersist()


def test_boosting_runs_are_separate_fits_and_nest(spark, rows):
    held, bounds = _blocks(rows)
    kinds = [(depth, rate, share, f) for depth in (1, 3) for rate, share in ((0.1, 1.0), (0.3, 0.7)) for f in (1, -1)]
    runs = [trees.Boosting(20, d, r, s).run(f) for d, r, s, f in kinds]
    n_passes = trees.grow(held, runs)
    assert n_passes <= 1 + 20 * 3
    parts = held.collect()
    bins, y, fold, key = (np.concatenate([p[n] for p in parts]) for n in ("bins", "y", "fold", "key"))
    for (d, r, s, f), run in zip(kinds[::3], runs[::3]):
        alone = trees.Boosting(11, d, r, s).run(f)  # past one time that trees are added to the scores
        trees.grow(held, [alone])
        np.testing.assert_allclose(trees.scores(alone, bins), trees.scores(run, bins, rounds=11), atol=1e-12)
    # each tree's leaves follow from the rows' gradients there
    run = runs[2]
    keep, score = fold != 1, np.full(len(y), run.start)
    for k, tree in enumerate(run.trees):
        use = keep & (passes.uniform(key, run.seed * 1_000_003 + k) < run.share)
        p = 1 / (1 + np.exp(-score))
        node = trees.walk(tree.arrays(), bins)
        for leaf in set(node[use].tolist()):
            at = use & (node == leaf)
            assert abs(tree.value[leaf] - run.rate * (y - p)[at].sum() / ((p * (1 - p))[at].sum() + trees.RIDGE)) < 1e-9
        score = score + np.array(tree.value)[node]
    held.unpersist()
    model = trees.Boosting(20, 3, 0.3, 0.7).fit(rows.drop("fold"))
    assert models.measures(model.scores(rows), ("f1",))["f1"] > 0.9
    assert trees.binned(np.array([[np.nan] * 4, [7.0] * 4]), bounds)[0].tolist() == [len(b) for b in bounds]


def test_boosting_shares_runs_or_rows(spark, rows, monkeypatch):
    """A table of few cells takes two passes, however many rounds there are; the trees are those of passes over shared rows."""
    held, _ = _blocks(rows)
    parts = held.collect()
    bins = np.concatenate([p["bins"] for p in parts])
    asked = [(depth, share, f) for depth in (2, 5) for share in (0.7, 1.0) for f in (0, 3, -1)]
    make = lambda: [trees.Boosting(12, d, 0.2, s).run(f) for d, s, f in asked] + [trees.Run(1, 4)]
    alone, shared = make(), make()
    assert trees.grow(held, alone) <= 2 + 4
    monkeypatch.setattr(trees, "WHOLE", 0)
    assert trees.grow(held, shared) > 12
    for a, b in zip(alone, shared):
        assert a.done and a.start == b.start and [t.feature for t in a.trees] == [t.feature for t in b.trees] and [t.cut for t in a.trees] == [t.cut for t in b.trees]
        assert [t.depth for t in a.trees] == [t.depth for t in b.trees]
        np.testing.assert_allclose(trees.scores(a, bins), trees.scores(b, bins), atol=1e-12)
    held.unpersist()


def test_searches_choose_by_f1_of_folds(spark, rows):
    combos = [{"rounds": n, "depth": 2, "rate": 0.2, "share": 1.0} for n in (2, 12)]
    model, table, scored = models.search_boosting(rows, combos)
    f1 = {json.loads(r.parameters)["rounds"]: r.f1 for r in table.collect()}
    best = max(f1, key=f1.get)
    assert model.rounds == best and len(model.grown.trees) == best
    each = models.measures_by(materialise(scored), ["fold"], ("f1",)).agg(F.avg("f1")).first()[0]
    assert abs(each - f1[best]) < 1e-4 and scored.count() == 240
    model, table = models.search_trees(rows, [{"maxDepth": d, "minInstancesPerNode": 1, "impurity": "gini"} for d in (1, 4)])
    assert table.count() == 2 and models.measures(models.scores(model, rows), ("f1",))["f1"] > 0.7
    model, table = models.search_logistic(rows, [{"regParam": p, "elasticNetParam": e} for p in (1.0, 0.01) for e in (0.0, 1.0)])
    plain = models.search(rows, models.estimators()["logistic"], [{"regParam": p, "elasticNetParam": e} for p in (1.0, 0.01) for e in (0.0, 1.0)])[1]
    assert max(abs(a.f1 - b.f1) for a, b in zip(table.collect(), plain.collect())) < 0.02


def test_one_of_two_siblings_is_added_up(spark, rows, monkeypatch):
    """The other has the rest of its parent's rows; sums are half as many, and trees the same."""
    seen, summed = [], trees.summed

    def counted(held, f, state, *rest):
        if f is trees._histograms:
            seen.append(sum(int(r["slots"].max()) + 1 for r in state))
        return summed(held, f, state, *rest)

    monkeypatch.setattr(trees, "summed", counted)
    held = trees.prepared(rows, trees.edges(rows, "features", 4), 240)
    run = trees.Run(-1, 4)
    trees.grow(held, [run])
    tree = run.trees[0]
    inner = sum(f >= 0 for f in tree.feature)
    assert seen[:2] == [1, 1] and sum(seen) < len(tree.feature) - 1 and inner > 3
    block, = held.map(lambda b: {k: b[k] for k in ("bins", "y")}).coalesce(1).glom().map(lambda bs: {k: np.concatenate([b[k] for b in bs]) for k in bs[0]}).collect()
    node = trees.walk(tree.arrays(), block["bins"])
    for k in set(node.tolist()):
        y = block["y"][node == k]
        one, zero = run.weights[1] * (y == 1).sum(), run.weights[0] * (y == 0).sum()
        assert len(y) and abs(tree.value[k] - one / (one + zero)) < 1e-9


def test_models_of_every_family_are_saved(spark, rows, tmp_path):
    plain = rows.drop("fold")
    for name, estimator in (models.families() | {"boosting": models.Boosting(3)}).items():
        fitted = models.fit(estimator, plain)
        models.save(fitted, ["a", "b", "c", "d"], str(tmp_path / name), spark)
        loaded, names = models.load(str(tmp_path / name), spark)
        assert names == ["a", "b", "c", "d"] and type(loaded) is type(fitted)
        before, after = ({r.id: (r.score, r.predicted) for r in models.scores(m, plain).collect()} for m in (fitted, loaded))
        assert before == after and len(before) == 240, name


def _points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(4)


def test_kmeans_is_a_numpy_twins(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.5, (40, 3)) for c in (0, 3, 6)])
    df = _points(spark, x)
    table, labels = cluster.kmeans_sweep(df, range(2, 6), 3)
    got = {r.k: r for r in table.collect()}
    keys = np.array([r.key for r in df.select("id", F.xxhash64("id").alias("key")).orderBy("id").collect()])
    for k in range(2, 6):
        inertias = []
        for restart in range(3):
            c = np.empty((0, 3))
            for step in range(k):
                far = ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1) if len(c) else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    race = -np.log1p(-passes.uniform(keys, (42 + restart) * 1_009 + step)) / far
                c = np.vstack([c, x[race.argmin()]])
            for _ in range(50):
                near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
                new = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
                if np.sqrt(((new - c) ** 2).sum(axis=1)).max() <= 1e-4:
                    break
                c = new
            inertias.append(((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum())
        assert abs(got[k].inertia - min(inertias)) < 1e-6
    assert max(got.values(), key=lambda r: r.silhouette).k == 3
    judged = df.withColumn("features", array_to_vector("x")).join(labels, "id").withColumn("cluster", F.col("cluster").cast("double"))
    assert abs(ClusteringEvaluator(predictionCol="cluster").evaluate(judged) - got[3].silhouette) < 1e-9
    # fewer different rows than clusters, and rows that are all alike
    few, _ = cluster.kmeans_sweep(_points(spark, [[0.0, 0.0]] * 5 + [[1.0, 1.0]] * 5), range(2, 5), 2)
    assert [r.inertia for r in few.collect()] == [0.0, 0.0, 0.0]
    same, labels = cluster.kmeans_sweep(_points(spark, [[2.0]] * 6), range(2, 4), 2)
    assert [r.silhouette for r in same.collect()] == [None, None] and {r.cluster for r in labels.collect()} == {0}


def test_mixtures_are_a_numpy_twins(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(0, 1, (60, 2)), rng.normal(5, 0.5, (60, 2))])
    df = _points(spark, x)
    table, labels = cluster.gmm_sweep(df, range(2, 4), 2, final=3)
    got = {r.k: r for r in table.collect()}
    rows, n = cluster._blocks(df)
    runs = [(k, 42 + r) for k in (2, 3) for r in range(2)]
    starts, _ = cluster._kmeans(rows, cluster._seeds(rows, runs), most=10)
    best = {}
    for (k, _), c in zip(runs, starts):
        share = np.eye(k)[((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)]
        last = -np.inf
        for _ in range(101):
            w = share.sum(axis=0)
            mu = share.T @ x / w[:, None]
            cov = [np.cov(x.T, aweights=share[:, j] + 1e-300, bias=True) + 1e-6 * np.eye(2) for j in range(k)]
            log = np.stack([np.log(w[j] / n) - 0.5 * np.einsum("ni,ij,nj->n", x - mu[j], np.linalg.inv(cov[j]), x - mu[j])
                            - 0.5 * np.linalg.slogdet(2 * np.pi * cov[j])[1] for j in range(k)], axis=1)
            total = np.log(np.exp(log).sum(axis=1))
            share = np.exp(log - total[:, None])
            gain, last = (total.sum() - last) / n, total.sum()
            if gain < 1e-3:
                break
        best[k] = max(best.get(k, -np.inf), last)
    for k in (2, 3):
        assert abs(got[k].log_likelihood - best[k]) < 1e-3
        free = k * 3 + k * 2 + k - 1
        assert abs(got[k].bic - (-2 * got[k].log_likelihood + free * np.log(n))) < 1e-6
    sides = {(r.id < 60, r.cluster) for r in labels.collect()}
    assert min(got.values(), key=lambda r: r.bic).k == 2 and len(sides) == 2


def test_correlations_of_pairs_with_gaps(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(1e6, 1, (300, 5))
    x[:, 1] = x[:, 0] + rng.normal(0, 0.1, 300)
    x[:, 4] = 3.25
    there = rng.random((300, 5)) > 0.3
    there[0, 2] = False
    df = spark.createDataFrame([[float(v) if t else None for v, t in zip(*r)] for r in zip(x, there)], "a double, b double, c double, d double, e double").repartition(3)
    for r in aggregates.correlation_pairs(df, list("abcde")).collect():
        i, j = "abcde".index(r.a), "abcde".index(r.b)
        both = there[:, i] & there[:, j]
        if "e" in (r.a, r.b):
            assert r.r is None
        else:
            assert abs(r.r - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-7
    assert [tuple(r) for r in aggregates.correlation_pairs(df.limit(0), ["a", "b"]).collect()] == [("a", "b", None)]
    assert aggregates.correlation_pairs(df, ["a"]).count() == 0


def test_one_key_of_most_rows_is_dealt_out(spark):
    """Lookups whose key is mostly one value: right rows, and more than one part for the frequent value."""
    rows = [(i, "hot" if i % 10 else f"k{i}", float(i % 7)) for i in range(3000)] + [(9000, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, actor string, v double").withColumn("ts", F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id)"))
    table = features.actor_table(df, "actor", "ts")
    out = {r.id: r.actor_event_count for r in features.attach_actor(df, table, "actor").collect()}
    assert out == {i: (None if a is None else 2700 if a == "hot" else 1) for i, a, _ in rows}
    counts = df.groupBy("actor").agg(F.count(F.lit(1)).alias("n"))
    assert [(r.actor, r["__parts"] > 20) for r in skew.hot_keys(counts.where("actor is not null"), ["actor"], 3000).collect()] == [("hot", True)]
    members = spark.createDataFrame([("hot",), ("k10",), ("none",)], "actor string")
    assert features.flag_members(df, "actor", members, "known").where("known").count() == 2701
    rare = outliers.rare_flags(df, "actor").where("outlier_rare_actor")
    assert rare.count() == 300 and rare.where("actor is null or actor = 'hot'").count() == 0
    x = np.array([[r[2], 0.0 if r[1] == "hot" else 5.0] for r in rows[:-1]])
    flat = spark.createDataFrame([(i, [float(v) for v in p], int(p[1] > 0)) for i, p in enumerate(x)], "id long, x array<double>, cluster int")
    c = [x[x[:, 1] == v].mean(axis=0) for v in (0, 5)]
    s = [np.sqrt(((x[x[:, 1] == v] - m) ** 2).sum(axis=1)).mean() for v, m in zip((0, 5), c)]
    assert abs(cluster_quality.davies_bouldin(flat).first()[0] - sum(s) / np.linalg.norm(c[0] - c[1])) < 1e-9


def test_ward_of_few_rows_is_exact_and_of_many_close(spark):
    """Rows that are no more than the features merge as by brute force; blobs of many rows are found from one scan."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 2)) + 3 * rng.integers(0, 3, (60, 1))
    parts = [[i] for i in range(60)]
    squares = lambda p: float(((x[p] - x[p].mean(axis=0)) ** 2).sum())
    while len(parts) > 4:
        _, i, j = min((squares(a + b) - squares(a) - squares(b), i, j) for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j)
        parts[i] += parts.pop(j)
    table, labels = cluster.ward_two_stage(_points(spark, x), range(4, 5))
    found = {}
    for r in labels.collect():
        found.setdefault(r.cluster, set()).add(r.id)
    assert {frozenset(v) for v in found.values()} == {frozenset(p) for p in parts}
    judged = _points(spark, x).withColumn("features", array_to_vector("x")).join(labels, "id").withColumn("cluster", F.col("cluster").cast("double"))
    assert abs(ClusteringEvaluator(predictionCol="cluster").evaluate(judged) - table.first().silhouette) < 1e-9
    many = np.vstack([rng.normal(c, 0.4, (900, 3)) for c in (0, 4, 8)])
    rows, n = cluster._blocks(_points(spark, many))
    size, sums, squares = cluster.features_of(rows, 50)
    assert len(size) == 50 and size.sum() == n == 2700
    np.testing.assert_allclose(sums.sum(axis=0), many.sum(axis=0))
    np.testing.assert_allclose(squares.sum(), (many**2).sum())
    table, labels = cluster.ward_two_stage(_points(spark, many), range(2, 5), micro=50)
    assert max(table.collect(), key=lambda r: r.silhouette).k == 3
    assert len({(r.id // 900, r.cluster) for r in labels.collect()}) == 3
    same, labels = cluster.ward_two_stage(_points(spark, [[1.0, 1.0]] * 5), range(2, 3))
    assert labels.count() == 5 and same.count() == 1
