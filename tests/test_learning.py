"""The sweeps and searches of the registered queries cover what the survey names."""

import inspect
import json

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from logforge.functions import lineage
from logforge.jobs import learn_queries, pipelines
from logforge.operators import anomaly, cluster, cluster_quality, density, knn, models, sampling

DATA = "/root/testdata/sf0.001"


def test_sweeps_are_whole(spark, monkeypatch):
    seen, plain = {}, spark.createDataFrame([(i, [float(i % 2), float(i)], i % 2) for i in range(8)], "id long, x array<double>, label int")
    for name in ("kmeans_sweep", "gmm_sweep", "ward_two_stage", "dbscan_sweep"):
        def spy(*a, name=name, sign=inspect.signature(getattr(cluster, name)), **b):
            bound = sign.bind(*a, **b)
            bound.apply_defaults()
            seen.setdefault(name, []).append(bound.arguments)
            return plain, plain.selectExpr("id", "label as cluster")

        monkeypatch.setattr(cluster, name, spy)
    pipelines.cluster_all(plain)
    for name in ("kmeans_sweep", "gmm_bic", "ward_two_stage", "dbscan_sweep", "dbscan_clusters"):
        learn_queries.QUERIES[name](spark, DATA)
    assert {n: len(calls) for n, calls in seen.items()} == {"kmeans_sweep": 2, "gmm_sweep": 2, "ward_two_stage": 2, "dbscan_sweep": 3}
    assert all((a["ks"], a["restarts"]) == (range(2, 11), 10) for a in seen["kmeans_sweep"])
    assert all((a["ks"], a["restarts"], a["final"]) == (range(2, 9), 3, 5) for a in seen["gmm_sweep"])
    assert all((a["ks"], a["micro"]) == (range(2, 7), 300) for a in seen["ward_two_stage"])
    assert all((a["eps"], a["least"]) == ((0.3, 0.5, 0.7, 1.0, 1.5), (3, 5, 10)) for a in seen["dbscan_sweep"])


def test_ward_merges_the_nearest():
    rng = np.random.default_rng(5)
    c, n = rng.normal(size=(40, 3)), rng.integers(1, 9, 40)
    parts = [[i] for i in range(40)]

    def squares(p):
        m = np.average(c[p], axis=0, weights=n[p])
        return float((n[p, None] * (c[p] - m) ** 2).sum())

    while len(parts) > 4:
        pairs = [(squares(a + b) - squares(a) - squares(b), i, j) for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j]
        _, i, j = min(pairs)
        parts[i] += parts.pop(j)
    got = cluster._ward(c, n, 4)
    assert {frozenset(np.flatnonzero(got == g).tolist()) for g in set(got.tolist())} == {frozenset(p) for p in parts}


def test_searches_are_whole(spark, monkeypatch):
    seen = {}

    def spy(name):
        def search(rows, *rest):
            family = name or (rest[0] if isinstance(rest[0], str) else type(rest[0]).__name__)
            seen[family] = rows, list(rest[0] if name else rest[1])
            return None, spark.createDataFrame([("{}", 1.0)], "parameters string, f1 double")

        return search

    for function, name in (("search", None), ("search_own", None), ("search_logistic", "logistic"), ("search_trees", "tree"), ("search_boosting", "boosting")):
        monkeypatch.setattr(models, function, spy(name))
    assert {r.family for r in learn_queries.QUERIES["grid_search"](spark, DATA).collect()} == {"logistic", "tree", "forest", "boosting", "svm", "neighbours"}
    assert {k: len(c) for k, (_, c) in seen.items()} == {"logistic": 8, "tree": 24, "RandomForestClassifier": 12, "boosting": 20, "svm": 2, "neighbours": 4}
    rows, logistic = seen["logistic"]
    assert {r.fold for r in rows.select("fold").distinct().collect()} == set(range(5))
    n = rows.where("fold <> 0").count()
    assert sorted({c["regParam"] for c in logistic}) == sorted(1 / (c * n) for c in (0.01, 0.1, 1.0, 10.0))

    calls = {}
    monkeypatch.setattr(models, "cross_validate", lambda rows, all_: calls.setdefault("cv", (rows, all_))[0])
    monkeypatch.setattr(models, "learning_curve", lambda rows, e, shares: calls.setdefault("curve", (rows, shares))[0])
    folds = [learn_queries.QUERIES[q](spark, DATA).selectExpr("max(fold)").first()[0] for q in ("cv_report", "learning_curve")]
    assert folds == [4, 4] and len(calls["curve"][1]) == 8 and calls["curve"][1][0] == 0.1 and calls["curve"][1][-1] == 1.0
    assert set(calls["cv"][1]) == set(models.families()) and len(models.families()) == 6
    assert models.estimators()["logistic"].getMaxIter() == 50


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(loc=3.0 * (i % 3 == 0), size=3)], int(i % 3 == 0)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int")
    return df.select("id", array_to_vector("x").alias("features"), "label")


def test_own_families(spark, blobs):
    """Searches of the families that Spark ML lacks: every combination over every fold, against plain numpy votes."""
    folds = lineage.materialise(sampling.folds(blobs, "label", "id"))
    model, table = models.search_own(folds, "neighbours", models.grids(100)["neighbours"])
    got = {tuple(sorted(json.loads(r.parameters).items())): r.f1 for r in table.collect()}
    rows = folds.select("id", vector_to_array("features").alias("x"), "label", "fold").orderBy("id").toPandas()
    x, y, fold = np.stack(rows.x), rows.label.to_numpy(), rows.fold.to_numpy()
    for k in (5, 11):
        for weighted in (False, True):
            f1 = []
            for f in range(5):
                t = fold != f
                mean, std = x[t].mean(axis=0), x[t].std(axis=0, ddof=1)
                a, b = (x[~t] - mean) / std, (x[t] - mean) / std
                d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                w = 1 / np.take_along_axis(d, near, axis=1) if weighted else np.ones_like(near, dtype=float)
                p = (w * y[t][near]).sum(axis=1) > w.sum(axis=1) / 2
                tp = (p & (y[~t] == 1)).sum()
                f1.append(2 * tp / (p.sum() + (y[~t] == 1).sum()))
            assert abs(got[("by_distance", weighted), ("k", k)] - np.mean(f1)) < 1e-5
    assert set(models.tuned(table.selectExpr("'neighbours' as family", "parameters", "f1"))) == {"neighbours"}
    _, table = models.search_own(folds, "svm", models.grids(100)["svm"])
    assert all(r.f1 > 0.85 for r in table.collect())


def test_kernel_svm_fits_on_training_rows(spark, blobs):
    train = blobs.where("id % 5 <> 0")
    model = models.KernelSvm().fit(train)
    rows = np.stack([r[0] for r in train.select(vector_to_array("features")).collect()])
    scaled = (rows - rows.mean(axis=0)) / rows.std(axis=0, ddof=1)
    assert abs(model.gamma - 1 / (3 * scaled.var())) < 1e-9
    out = model.scores(blobs.where("id % 5 = 0")).collect()
    assert sum(r.predicted == r.label for r in out) >= 27


def test_measures_by_model(spark):
    rng = np.random.default_rng(9)
    rows = [(m, int(rng.integers(2)), float(round(rng.random(), 1))) for m in "abc" for _ in range(40)]
    df = spark.createDataFrame(rows, "model string, label int, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    got = {r.model: r for r in models.measures_by(df, ["model"]).collect()}
    for m in "abc":
        own = [(y, s) for n, y, s in rows if n == m]
        pos, neg = [s for y, s in own if y], [s for y, s in own if not y]
        auc = np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg])
        tp, fp = sum(s >= 0.5 for s in pos), sum(s >= 0.5 for s in neg)
        assert abs(got[m].roc_auc - auc) < 1e-9 and abs(got[m].f1 - 2 * tp / (tp + fp + len(pos))) < 1e-6
        assert models.measures(df.where(F.col("model") == m)) == pytest.approx({k: got[m][k] for k in models.MEASURES})


def _brute_dbscan(x, eps, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = (d <= eps).sum(axis=1) >= least
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = i
                    todo += np.flatnonzero(core & (d[j] <= eps)).tolist()
    out = label.copy()
    for i in np.flatnonzero(~core):
        near = label[core & (d[i] <= eps)]
        out[i] = near.min() if len(near) else -1
    return out


def test_dbscan_pairs_come_from_one_forest(spark, monkeypatch):
    """All pairs of parameters as brute force gives them, on clusters, chains, noise, copies and a far row."""
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(0, 0.15, (40, 2)), rng.normal(3, 0.3, (40, 2)), [[0.22 * k, 6.0] for k in range(30)], rng.uniform(-2, 8, (40, 2)), [[9.0, 9.0]] * 6, [[50.0, 50.0]]]).round(2)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(3)
    monkeypatch.setattr(knn, "CELL", 16)  # many cells
    pairs = [(e, m) for e in (0.1, 0.25, 0.6, 1.5) for m in (1, 2, 4, 9)]
    got = cluster.dbscan_many(df, pairs).toPandas()
    assert len(got) == len(pairs) * len(x)
    for run, (e, m) in enumerate(pairs):
        own = got[got.run == run].sort_values("id")
        np.testing.assert_array_equal(own.cluster.to_numpy(), _brute_dbscan(x, e, m), err_msg=f"{e} {m}")
    forest = cluster.reach_forest(df, [2, 4], 1.5).toPandas()
    assert all(len(f) < len(x) for _, f in forest.groupby("m"))  # a forest, not a list of pairs
    one = cluster.dbscan_many(df.limit(1), [(0.5, 1), (0.5, 3)]).orderBy("run").collect()
    assert [r.cluster for r in one] == [one[0].id, -1]
    assert cluster.dbscan_many(df.limit(0), [(0.5, 3)]).count() == 0


def test_neighbours_by_pivots(spark, monkeypatch):
    """Nearest neighbours and near pairs as brute force gives them, in many cells and blocks; far cells are skipped."""
    rng = np.random.default_rng(13)
    x = np.vstack([rng.normal(c, 0.3, (60, 3)) for c in (0, 5, 10, 15)] + [[[0.0, 0.0, 0.0]] * 40]).round(2)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(3)
    monkeypatch.setattr(knn, "CELL", 20)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = {(int(i), int(j)) for i, j in np.argwhere(np.triu(d <= 0.3, 1))}
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    for k, block in ((1, 8), (7, 64)):
        got = {(r["query"], r["rank"]): r.neighbour for r in knn.nearest(df, df, k, block=block).collect()}
        assert got == {(i, j + 1): order[i, j] for i in range(len(x)) for j in range(k)}
    some = knn.nearest(df.where("id % 20 = 0"), df, 3).collect()
    assert {(r["query"], r["rank"]): r.neighbour for r in some} == {(i, j + 1): order[i, j] for i in range(0, len(x), 20) for j in range(3)}
    assert {(r.a, r.b) for r in knn.within(df, 0.3, block=16).collect()} == near
    assert knn.cell_pairs(df, df, k=5)[2] > 0.5 and knn.cell_pairs(df, df, radius=0.3)[2] > 0.5
    assert knn.nearest(df.limit(3), df.limit(3), 5).count() == 6  # fewer rows than neighbours asked for
    assert knn.nearest(df, df.limit(0), 5).count() == 0 and knn.nearest(df.limit(0), df, 5).count() == 0


@pytest.mark.parametrize("name, rows", [("knn", 5), ("knn_classify", 1)])
def test_every_vector_is_asked(spark, name, rows):
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    got = learn_queries.QUERIES[name](spark, DATA).select("query").toPandas()
    assert got["query"].nunique() == n and len(got) == rows * n


def test_dbscan_asks_for_cells_outside_the_largest_component(spark, monkeypatch):
    """Once cells have merged, only those of the smaller components meet all others."""
    x = [[0.2 * k, 0.0] for k in range(60)] + [[0.2 * k, 1.4] for k in range(8)] + [[40.0, 0.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, x array<double>")
    met, plain = [], density.block_pairs
    monkeypatch.setattr(density, "block_pairs", lambda a, b, *k, **kw: met.append((a.count(), b.count())) or plain(a, b, *k, **kw))
    pairs = [(0.5, 2), (1.0, 2), (1.5, 2)]
    got = density.dbscan_many(df, pairs).toPandas()
    for run, (e, m) in enumerate(pairs):
        own = got[got.run == run].sort_values("id")
        np.testing.assert_array_equal(own.cluster.to_numpy(), _brute_dbscan(np.array(x), e, m), err_msg=f"{e} {m}")
    assert all(a < b / 2 for a, b in met[2:])  # the first two: bounds of rows, and cells that are components of their own


def test_dbscan_of_many_clusters(spark):
    """Hundreds and thousands of clusters are found, counted and judged like few."""
    for n, eps in ((300, 0.5), (12_000, 0.5)):
        rows = spark.range(3 * n).selectExpr("id", "array(double(id div 3) * 4 + double(id % 3) * 0.1, 0.0D) as x")
        table, labels = cluster.dbscan_sweep(rows.withColumn("x", F.expr("array(x[0] % 400, double(int(x[0] / 400)) * 4)")), (eps,), (3,))
        r = table.first()
        assert (r.n_clusters, r.noise) == (n, 0) and 0.99 < r.silhouette <= 1
        assert labels.where("cluster <> id - id % 3").count() == 0


def test_trees_draw_from_the_whole_table(spark):
    dealt = anomaly._deal(spark.range(30_000).selectExpr("id", "array(double(id)) as x"), 30_000, 250, 42)
    ids, rows = dealt.selectExpr("count(distinct id)", "count(*)").first()
    assert ids > 25_000 and 60_000 < rows < 68_000


def test_dbscan_seeks_neighbours_of_few_rows(spark, monkeypatch):
    """Cells tell what dense rows are; neighbours are sought for the rest, though a dense cluster grows."""
    rng = np.random.default_rng(14)
    x = np.vstack([rng.normal(c, 0.1, (1500, 2)) for c in (0, 4)] + [[[20.0, 20.0], [20.1, 20.0], [float("nan"), 0.0]]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    asked, plain = [], density.nearest
    monkeypatch.setattr(density, "nearest", lambda q, *a, **k: asked.append(q.count()) or plain(q, *a, **k))
    got = cluster.dbscan_many(df, [(0.5, 5)]).orderBy("id").toPandas()
    assert got.cluster.tolist() == [0] * 1500 + [1500] * 1500 + [-1] * 3 and sum(asked) < 100


def test_few_queries_take_few_copies(spark, monkeypatch):
    """Rows spread evenly over many dimensions: each goes to as many cells as there are CELL queries, not CELL rows."""
    rng = np.random.default_rng(15)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(0, 1, (400, 32)))], "id long, x array<double>")
    monkeypatch.setattr(knn, "CELL", 10)
    copies, plain = [], knn.materialise
    monkeypatch.setattr(knn, "materialise", lambda d: copies.append(d) or plain(d))
    got = {(r["query"], r["rank"]): r.neighbour for r in knn.nearest(df.where("id % 20 = 0"), df, 3).collect()}
    assert sum(d.count() for d in copies if "other" in d.columns) <= 2 * 400 and len(got) == 60


def test_products_tell_the_nearest(spark, monkeypatch):
    """What shares a query's block of cells bounds its neighbours; blocks that all meet grow with the table, and each pair of rows is compared once."""
    rng = np.random.default_rng(16)
    x = np.vstack([rng.normal(0, 1, (300, 12)), 1e6 + rng.normal(0, 1e-4, (60, 12)), np.zeros((30, 12))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    own = np.arange(len(x))
    i, j, far = knn._best(own, x, own, x, 4, np.full(len(x), np.inf))
    order = np.argsort(np.where(np.eye(len(x), dtype=bool), np.inf, d), axis=1, kind="stable")[:, :4]
    assert (j.reshape(-1, 4) == order).all() and (far.reshape(-1, 4) == np.take_along_axis(d, order, 1)).all()
    monkeypatch.setattr(knn, "CELL", 20)
    monkeypatch.setattr(knn, "MANY", 3)  # a sample of the rows comes first
    df = spark.createDataFrame([(k, [float(v) for v in r], k % 3) for k, r in enumerate(x)], "id long, x array<double>, cluster int")
    got = {(r["query"], r["rank"]): r.neighbour for r in knn.nearest(df, df, 4, block=32).collect()}
    assert got == {(k, r + 1): order[k, r] for k in range(len(x)) for r in range(4)}
    assert knn.wide(1_000_000) > 4 * knn.BLOCK  # a table of 100 times the rows isn't shuffled 10,000 times
    of = [np.column_stack([d[:, own % 3 == c].sum(axis=1) / np.where(own % 3 == c, (own % 3 == c).sum() - 1, (own % 3 == c).sum()) for c in range(3)])][0]
    a = of[own, own % 3]
    b = np.where(np.eye(3, dtype=bool)[own % 3], np.inf, of).min(axis=1)
    monkeypatch.setattr(cluster_quality, "wide", lambda rows: 64)  # many blocks
    assert cluster_quality.euclidean_silhouette(df, "id").first()[0] == pytest.approx(((b - a) / np.maximum(a, b)).mean(), rel=1e-9)


def test_queries_go_to_few_cells(spark, monkeypatch):
    """In few dimensions a query goes to the cells around it, however many there are, and no row to another cell than its own."""
    x = np.random.default_rng(17).uniform(0, 1, (1500, 2))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    monkeypatch.setattr(knn, "CELL", 25)
    written, plain = [], knn.materialise
    monkeypatch.setattr(knn, "materialise", lambda d: written.append(plain(d)) or written[-1])
    assert knn.nearest(df, df, 5).count() == 7500
    assert max(d.count() for d in written) < 1500 * 6
