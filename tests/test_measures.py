"""Outliers, measures, neighbours, balancing, anomalies and clusterings against hand-computed and numpy twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logforge.operators import anomaly, balance, cluster, knn, models, outliers, reduce
from logforge.operators import cluster_quality as cq
from logforge.operators import evaluate as ev


def points(spark, x, **more):
    rows = [(i, [float(v) for v in p], *[int(m[i]) for m in more.values()]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>" + "".join(f", {k} int" for k in more))


def test_univariate_flags(spark):
    df = spark.createDataFrame([(v, 1.0) for v in (1.0, 2.0, 3.0, 4.0, 100.0, None)], "x double, c double")
    rows = outliers.zscore_flags(outliers.iqr_flags(df, ["x", "c"]), ["x", "c"], 1.5).collect()
    assert [r.outlier_iqr_x for r in rows] == [False] * 4 + [True, False]
    assert [r.outlier_zscore_x for r in rows] == [False] * 4 + [True, False]
    assert not any(r.outlier_zscore_c or r.outlier_iqr_c for r in rows)


def test_rare_is_strictly_under(spark):
    df = spark.createDataFrame([("a",)] * 197 + [("b",), ("c",), ("c",), (None,)], "v string")
    assert {r.v for r in outliers.rare_flags(df, "v").where("outlier_rare_v").collect()} == {"b"}


def test_consensus(spark):
    df = spark.createDataFrame([(False, False, False), (True, True, False), (True, False, True), (True, True, True)], "outlier_iqr_a boolean, outlier_iqr_b boolean, outlier_zscore_a boolean")
    scored = outliers.with_score(df)
    assert [r.outlier_type for r in scored.collect()] == ["normal", "strong", "strong", "extreme"]
    assert [r.agreement for r in outliers.validate(scored, count="flags").collect()] == [0, 2, 2, 3]
    assert [r.agreement for r in outliers.validate(scored, count="methods").collect()] == [0, 1, 2, 2]
    judged = outliers.confirm(outliers.validate(scored))
    assert outliers.remove(judged).count() == 1 and outliers.remove(judged, extreme_only=True).count() == 3


def test_mahalanobis(spark):
    x = np.random.default_rng(1).normal(size=(200, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 2]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = np.array([r.d for r in outliers.mahalanobis_flags(df, ["a", "b", "c"], distance="d").collect()])
    away = x - x.mean(axis=0)
    np.testing.assert_allclose(got, np.sqrt(np.einsum("ij,jk,ik->i", away, np.linalg.inv(np.cov(x.T)), away)), rtol=1e-8)
    assert outliers.mahalanobis_flags(df.withColumn("b", F.col("a")), ["a", "b"]).columns == ["a", "b", "c"]


@pytest.mark.parametrize("labels, scores, auc", [
    ([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9], 1.0), ([1, 1, 0, 0], [0.1, 0.2, 0.8, 0.9], 0.0), ([0, 1, 0, 1], [0.5] * 4, 0.5), ([0, 1, 1, 0, 1], [0.2, 0.2, 0.7, 0.7, 0.9], 2 / 3)])
def test_auc_is_mann_whitney(spark, labels, scores, auc):
    df = spark.createDataFrame(list(zip(labels, scores)), "label int, score double")
    pairs = [(p > n) + 0.5 * (p == n) for y, p in zip(labels, scores) if y for z, n in zip(labels, scores) if not z]
    assert ev.roc_auc(df).first()[0] == pytest.approx(sum(pairs) / len(pairs)) == pytest.approx(auc)


def test_thresholds_reach(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.25)], "label int, score double")
    sweep = {r.threshold: r.f1 for r in ev.threshold_sweep(df, low=0.25, high=0.75, steps=3).collect()}
    assert sweep == {0.25: pytest.approx(2 / 3), 0.5: 1.0, 0.75: 0.0}
    assert ev.best_threshold(ev.threshold_sweep(df, low=0.25, high=0.75, steps=3)).first().threshold == 0.5


def test_no_positive_predictions(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, predicted int")
    row = ev.metrics(ev.confusion(df)).first()
    assert (row.precision, row.recall, row.f1, row.accuracy) == (0, 0, 0, 0.5)


def test_nearest_and_within(spark):
    x = np.random.default_rng(2).normal(size=(90, 4)).round(1)
    df = points(spark, x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    got = {(r["query"], r["rank"]): r.neighbour for r in knn.nearest(df, df, 5, block=16).collect()}
    for i in range(90):
        order = np.lexsort((np.arange(90), d[i]))[:5]
        assert [got[i, k + 1] for k in range(5)] == order.tolist()
    pairs = {(r.a, r.b) for r in knn.within(df, 1.2, block=16).collect()}
    assert pairs == {(i, j) for i in range(90) for j in range(i + 1, 90) if d[i, j] <= 1.2}


def test_smote_and_adasyn(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(40, 2)), rng.normal(3, 0.5, size=(9, 2))])
    df = points(spark, x, label=[0] * 40 + [1] * 9)
    for parts in (1, 3):
        made = balance.smote(df.repartition(parts), k=3).where("synthetic").orderBy("id").collect()
        assert len(made) == 31
        small = x[40:]
        for r in made:
            on = [abs(np.linalg.norm(r.x - a) + np.linalg.norm(r.x - b) - np.linalg.norm(a - b)) < 1e-9 for a in small for b in small]
            assert any(on)
    assert [r.x for r in made] == [r.x for r in balance.smote(df, k=3).where("synthetic").orderBy("id").collect()]
    far = points(spark, np.vstack([rng.normal(size=(20, 2)), rng.normal(50, 0.5, size=(8, 2))]), label=[0] * 20 + [1] * 8)
    assert balance.adasyn(far, k=3).where("synthetic").count() == 16  # equal parts: 12 / 8 = 1.5, half to even
    assert balance.smote(df.where("label = 0")).count() == 40
    lone = points(spark, [[0, 0], [1, 1], [5, 5]], label=[0, 0, 1])
    assert [r.x for r in balance.smote(lone).where("synthetic").collect()] == [[5.0, 5.0]]


def test_local_outlier_factor(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(60, 3)), [[9, 9, 9]]])
    got = {r.id: r for r in anomaly.local_outlier_factor(points(spark, x), k=10).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :10]
    far = np.take_along_axis(d, near, 1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(d, near, 1), far[near]).mean(axis=1) + 1e-10)
    want = lrd[near].mean(axis=1) / lrd
    assert np.allclose([got[i].score for i in range(61)], want) and got[60].outlier_lof


def test_isolation_forest(spark):
    x = np.vstack([np.random.default_rng(5).normal(size=(200, 2)), [[12, 12], [-12, 9]]])
    rows = anomaly.isolation_forest(points(spark, x), trees=40).collect()
    assert {200, 201} <= {r.id for r in rows if r.outlier_iforest} and sum(r.outlier_iforest for r in rows) <= 12


def test_equal_partitions_score_one(spark):
    df = points(spark, [[0, 0], [0, 1], [5, 5], [5, 6]], y=[0, 0, 1, 1], cluster=[1, 1, 0, 0])
    assert cq.adjusted_rand(df, "y", "cluster").first()[0] == pytest.approx(1)
    assert cq.normalised_mutual_information(df, "y", "cluster").first()[0] == pytest.approx(1)
    assert cq.purity(df, "y", "cluster").first()[0] == 1
    assert cq.silhouette(df) == pytest.approx(cq.silhouette_by_clusters(df, "id").first()[0])
    assert cq.silhouette(df.withColumn("cluster", F.lit(0))) is None
    assert cq.calinski_harabasz(df.withColumn("cluster", F.lit(0))).first()[0] is None
    assert cq.davies_bouldin(df.withColumn("cluster", F.lit(-1))).first()[0] is None


def test_dbscan(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(0, 0.3, (30, 2)), rng.normal(4, 0.3, (30, 2)), [[2, 2], [20, 20]]])
    df = points(spark, x)
    for eps, least in ((0.5, 4), (1.0, 5)):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        core = (d <= eps).sum(axis=1) >= least
        own = {i: i for i in np.flatnonzero(core)}
        for _ in range(70):
            own = {i: min(own[j] for j in own if d[i, j] <= eps) for i in own}
        want = [own.get(i, min((own[j] for j in own if d[i, j] <= eps), default=-1)) for i in range(len(x))]
        got = {r.id: r.cluster for r in cluster.dbscan_labels(df, knn.within(df, 1.0), eps, least).collect()}
        assert [got[i] for i in range(len(x))] == want


def test_ward_merges_blobs():
    rng = np.random.default_rng(7)
    centres = np.vstack([rng.normal(0, 0.1, (10, 2)), rng.normal(5, 0.1, (10, 2)), rng.normal((0, 9), 0.1, (10, 2))])
    groups = cluster._ward(centres, np.ones(30), 3)
    assert [len(set(groups[k : k + 10])) for k in (0, 10, 20)] == [1, 1, 1] and len(set(groups)) == 3


def test_components(spark):
    x = np.random.default_rng(8).normal(size=(100, 4)) * [5, 2, 1, 0.5]
    df = reduce.to_vector(points(spark, x), ["x"])
    model = reduce.Pca(df, "features", 0.9)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    values = np.linalg.eigvalsh(np.cov(z.T))[::-1]
    share = np.cumsum(values / values.sum())
    assert model.k == int(np.searchsorted(share, 0.9)) + 1
    np.testing.assert_allclose(model.variance, values / values.sum(), rtol=1e-8)
    scores = np.array([[r[f"PC_{k + 1}"] for k in range(model.k)] for r in model.transform(df).orderBy("id").collect()])
    np.testing.assert_allclose(scores.var(axis=0, ddof=1), values[: model.k], rtol=1e-8)


def test_models(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(80, 2)), rng.normal(4, 1, size=(20, 2))])
    df = reduce.to_vector(points(spark, x, label=[0] * 80 + [1] * 20), ["x"]).select("id", "features", "label")
    fitted = models.pipeline(models.estimators()["logistic"]).fit(models.weighted(df))
    assert models.measures(models.scores(fitted, df))["f1"] > 0.9
    models.save(fitted, ["a", "b"], str(tmp_path / "m"), spark)
    loaded, names = models.load(str(tmp_path / "m"), spark)
    assert names == ["a", "b"]
    before, after = ({r.id: r.score for r in models.scores(m, df).collect()} for m in (fitted, loaded))
    assert before == after
    assert models.importance(spark, fitted, ["a", "b"]).count() == 2
    ring = np.vstack([rng.normal(0, 0.4, (100, 2)), [[3 * np.cos(t), 3 * np.sin(t)] for t in np.linspace(0, 6.28, 100)]])
    rows = reduce.to_vector(points(spark, ring, label=[0] * 100 + [1] * 100), ["x"]).select("id", "features", "label")
    assert models.measures(models.KernelSvm(n=64).fit(rows).scores(rows))["accuracy"] > 0.95
    assert len(models.grids(10)["logistic"]) == 8 and len(models.grids(10)["tree"]) == 24
