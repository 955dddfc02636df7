"""Exact quantiles and medians against Spark's own aggregates, which hold a column in one task."""

import random

import pytest
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Observation
from pyspark.sql import functions as F

from logforge.functions import ordered
from logforge.operators import aggregates, encode, missing, models, outliers, scale

SHARES = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]


def _table(spark):
    rng = random.Random(6)
    rows = [(i % 3 if i else None, rng.gauss(0, 5), float(rng.randrange(4)), 7.0 if i % 2 else None, None) for i in range(2001)] + [(9, None, float("nan"), None, None)]
    return spark.createDataFrame(rows, "key long, a double, b double, c double, d double")


def _plain(df, names, shares=SHARES):
    return df.agg(*[F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in names]).first().asDict()


def test_quantiles_are_exact(spark):
    df = _table(spark)
    got = ordered.exact_quantiles(df, {c: F.col(c) for c in "abcd"}, SHARES)
    assert str(got) == str(_plain(df, "abcd"))
    medians = {r.key: r.median for r in ordered.grouped_medians(df.select("key", F.col("a").alias("x"))).collect()}
    assert medians == {r.key: r.m for r in df.where("key < 9").groupBy("key").agg(F.median("a").alias("m")).collect()}


@pytest.mark.parametrize("ranked", [ordered.RANKED, 0])
def test_quantiles_of_many_rows(spark, monkeypatch, ranked):
    """More rows than a sketch holds: brackets are narrow, frequent values are their ends, and ranges are ranked as one task does."""
    monkeypatch.setattr(ordered, "RANKED", ranked)
    df = spark.range(60_000).select(
        (F.hash("id") % 100_003).cast("double").alias("a"), (F.pmod(F.hash("id"), F.lit(7)) / 10).alias("b"),
        F.when(F.col("id") % 3 > 0, F.lit(float("nan"))).otherwise(F.col("id")).alias("c"),
        F.when(F.col("id") % 3 > 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf"))).alias("d"), F.exp(F.col("id") % 700).alias("e"))
    assert str(ordered.exact_quantiles(df, {c: F.col(c) for c in "abcde"}, SHARES)) == str(_plain(df, "abcde"))


def test_missed_brackets_are_opened(spark):
    """Sketches of other rows bracket the wrong ranks, and nothing changes but the work."""
    df, other = spark.range(5000).toDF("a"), spark.range(100_000, 105_000).toDF("a")
    wrong = ordered.sketches(other, {"a": F.col("a")})
    assert ordered.exact_quantiles(df, {"a": F.col("a")}, SHARES, wrong) == _plain(df, "a")


def test_sketches_are_kept_and_merged(spark, monkeypatch):
    df = spark.range(40_000).select((F.hash("id") % 1009).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("b"))
    whole = {c: F.col(c) for c in "ab"}
    parts = [ordered.sketches(df.where(f"coalesce(b, 1) % 2 = {k}"), whole) for k in (0, 1)]
    held = parts[0].merged(spark, parts[1])
    assert held.rows == {"a": 40_000, "b": 32_000} and all(len(s) < 200_000 for s in held.made.values())
    want = {c: missing.fit_medians(df, [c])[c] for c in "ab"}
    summary, edges, robust = aggregates.numeric_summary(df).collect(), encode.quantile_edges(df, "a", 4), scale.fit_robust(df, ["a", "b"])
    fenced = outliers.iqr_flags(df, ["a"]).where("outlier_iqr_a").count()

    def refuse(*a):
        raise AssertionError("sketched again")

    monkeypatch.setattr(ordered, "sketches", refuse)
    assert missing.fit_medians(df, ["a", "b"], held=held) == want
    assert aggregates.numeric_summary(df, held=held).collect() == summary
    assert encode.quantile_edges(df, "a", 4, held) == edges and scale.fit_robust(df, ["a", "b"], held=held) == robust
    assert outliers.iqr_flags(df, ["a"], held=held).where("outlier_iqr_a").count() == fenced


def test_no_aggregate_holds_a_column(spark, monkeypatch):
    def refuse(*a, **b):
        raise AssertionError("all distinct values in one task")

    monkeypatch.setattr(F, "percentile", refuse)
    monkeypatch.setattr(F, "median", refuse)
    assert scale.fit_robust(spark.range(5).toDF("x"), ["x"]) == {"x": (2.0, 2.0)}


def test_models_score_after_quantiles(spark):
    """Fitted forests and machines hold the session by their summaries, which must stay fit to be sent to tasks."""
    df = spark.range(200).select("id", (F.col("id") % 2).cast("int").alias("label"), array_to_vector(F.array((F.col("id") % 2 + F.col("id") / 200).cast("double"))).alias("features"))
    assert ordered.exact_quantiles(df, {"id": F.col("id")}, [0.5]) == {"id": [99.5]}
    for model in (LinearSVC(maxIter=5).fit(df), RandomForestClassifier(numTrees=2, maxDepth=2).fit(df)):
        assert models.scores(model, df).count() == model.transform(df).where("prediction is not null").count() == 200
        assert models.scores(model, df).agg(F.max("score")).first()[0] > 0.5


def test_models_score_after_an_observation(spark):
    """Whoever used it in the session."""
    own, seen = spark.newSession(), Observation()
    df = own.range(200).select("id", (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 3).cast("int").alias("fold"),
                               array_to_vector(F.array((F.col("id") % 2 + F.col("id") / 200).cast("double"))).alias("features"))
    df.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 200}
    for estimator in [*models.estimators().values(), models.KernelSvm(n=16)]:
        fitted = models.fit(estimator, df)
        assert models.scores(fitted, df).agg(F.max("score")).first()[0] > 0.5
    assert models.search(df, models.estimators()["logistic"], [{"regParam": 0.1}, {"regParam": 0.01}])[1].count() == 2
