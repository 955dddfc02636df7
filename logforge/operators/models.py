"""Training, search, cross-validation, comparison and persistence of classifiers, on Spark ML. Tables have id, features
(vector) and label (0 or 1)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce
from itertools import product
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logforge.functions.lineage import materialise, own_dir
from logforge.functions.passes import blocks
from logforge.operators import evaluate as ev
from logforge.operators import forests, linear, trees
from logforge.operators.balance import class_weights, smote
from logforge.operators.knn import nearest, vote
from logforge.operators.sampling import learning_steps
from logforge.operators.trees import Boosting

#: Spark's trees are at most this deep; "no limit" means this.
DEEPEST = 30


def weighted(df: DataFrame) -> DataFrame:
    """df with a column weight that gives each class the same total."""
    return df.join(F.broadcast(class_weights(df, "label").select("label", "weight")), "label")  # a row for each class


def estimators(seed: int = 42) -> dict:
    """One untuned estimator of each family that Spark ML has."""
    common = {"featuresCol": "features", "labelCol": "label"}
    return {
        # the pipeline's scaler has standardised the features
        "logistic": LogisticRegression(maxIter=50, weightCol="weight", standardization=False, **common),
        "tree": DecisionTreeClassifier(maxDepth=8, weightCol="weight", seed=seed, **common),
        "forest": RandomForestClassifier(numTrees=20, maxDepth=8, weightCol="weight", seed=seed, **common),
    }


def families(seed: int = 42) -> dict:
    """One untuned estimator of each of the six families."""
    return estimators(seed) | {"boosting": Boosting(seed=seed), "svm": KernelSvm(seed=seed), "neighbours": Neighbours()}


def grids(rows: int) -> dict[str, list[dict]]:
    """The parameter combinations of a full search of each family. rows: those that a model is trained on."""

    def every(**options) -> list[dict]:
        return [dict(zip(options, values)) for values in product(*options.values())]

    return {
        # C is the inverse of the penalty on the sum over rows
        "logistic": every(regParam=[1 / (c * max(1, rows)) for c in (0.01, 0.1, 1.0, 10.0)], elasticNetParam=[0.0, 1.0]),
        "tree": every(maxDepth=[3, 5, 10, DEEPEST], minInstancesPerNode=[1, 5, 10], impurity=["gini", "entropy"]),
        "forest": every(numTrees=[100, 200], maxDepth=[10, 20, DEEPEST], minInstancesPerNode=[1, 5]),
        "boosting": every(rounds=[50, 100], depth=[3, 5, 7], rate=[0.05, 0.1], share=[0.8, 1.0]),
        "svm": every(c=[1.0, 10.0]),
        "neighbours": every(k=[5, 11], by_distance=[False, True]),
    }


def draw(combinations: list[dict], n: int, seed: int = 42) -> list[dict]:
    """n of the combinations, all if there are fewer."""
    order = np.random.default_rng(seed).permutation(len(combinations))
    return [combinations[i] for i in sorted(order[:n])]


def alone(model, spark: SparkSession):
    """A fitted model without its training summary. That holds the session, which can't be sent to tasks once anything in it
    has used an Observation. Copies have no summary, but for logistic models; those are written and read."""
    if isinstance(model, LogisticRegressionModel):
        path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
        model.write().save(path)
        return LogisticRegressionModel.load(path)
    return model.copy() if getattr(model, "hasSummary", False) else model


class Alone(Pipeline):
    """A pipeline whose models have no training summaries."""

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        return PipelineModel([alone(m, dataset.sparkSession) for m in super()._fit(dataset).stages])


def pipeline(estimator) -> Pipeline:
    """Scaler and model together, so that whoever scores with one scores with the other."""
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled")
    return Alone(stages=[scaled, estimator.copy().setFeaturesCol("scaled")])


def fit(estimator, train: DataFrame):
    """A fitted model, classes weighted; its scaler is fitted on the training rows alone."""
    return estimator.fit(train) if isinstance(estimator, OWN) else pipeline(estimator).fit(weighted(train))


def scores(model, df: DataFrame) -> DataFrame:
    """(id, label, score, predicted) of each row."""
    if hasattr(model, "scores"):
        return model.scores(df)
    out = model.transform(df)
    if "probability" in out.columns:
        score = F.coalesce(F.get(vector_to_array("probability"), 1), F.lit(0.0))  # one class in training: no second place
    else:
        score = 1 / (1 + F.exp(-F.coalesce(F.get(vector_to_array("rawPrediction"), 1), F.lit(-30.0))))
    return out.select("id", "label", score.alias("score"), F.col("prediction").cast("int").alias("predicted"))


def _scaler(train: DataFrame):
    return StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled").fit(train)


class Neighbours:
    """k-nearest-neighbour classifier on standardised features; votes are equal, or by the inverse of the distance."""

    def __init__(self, k: int = 5, by_distance: bool = False):
        self.k, self.by_distance = k, by_distance

    def fit(self, train: DataFrame) -> Neighbours:
        self.scaler = _scaler(train)
        self.rows = materialise(self._scaled(train))
        return self

    def _scaled(self, df: DataFrame) -> DataFrame:
        return self.scaler.transform(df).select("id", vector_to_array("scaled").alias("x"), "label")

    def near(self, df: DataFrame) -> DataFrame:
        return nearest(self._scaled(df).select("id", "x"), self.rows.select("id", "x"), self.k)

    def voted(self, near: DataFrame, df: DataFrame, k: int, by_distance: bool) -> DataFrame:
        votes = vote(near.where(F.col("rank") <= k), self.rows.select("id", "label"), by_distance)
        return df.select("id", "label").join(votes, F.col("id") == F.col("query")).select("id", "label", F.col("probability").alias("score"), "predicted")

    def scores(self, df: DataFrame) -> DataFrame:
        return self.voted(self.near(df), df, self.k, self.by_distance)

    def save(self, path: str, spark: SparkSession) -> None:
        self.scaler.write().overwrite().save(f"{path}/scaler")
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        _write_own(spark, path, {"k": self.k, "by_distance": self.by_distance})

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> Neighbours:
        model = cls(**_read_own(spark, path))
        model.scaler, model.rows = StandardScalerModel.load(f"{path}/scaler"), spark.read.parquet(f"{path}/rows")
        return model


class KernelSvm:
    """A linear SVM on random Fourier features of standardised features, which approximates an RBF SVM with gamma
    1 / (p var(X)). Scaler and gamma are fitted on training rows."""

    def __init__(self, c: float = 1.0, n: int = 256, seed: int = 42):
        self.c, self.n, self.seed = c, n, seed

    def fit(self, train: DataFrame) -> KernelSvm:
        self.scaler = _scaler(train)
        scaled = self.scaler.transform(train)
        self.size = len(self.scaler.mean)
        spread = scaled.select(F.explode(vector_to_array("scaled")).alias("v")).agg(F.var_pop("v")).first()[0]
        self.gamma = 1 / (self.size * spread) if spread else 1.0 / self.size
        rows = materialise(weighted(self._mapped(train)))
        svm = LinearSVC(featuresCol="fourier", weightCol="weight", regParam=1 / (self.c * max(1, rows.count())), maxIter=50)
        self.model = alone(svm.fit(rows), rows.sparkSession)
        return self

    def _mapped(self, df: DataFrame) -> DataFrame:
        return fourier_features(self.scaler.transform(df), "scaled", self.size, self.gamma, self.n, self.seed).drop("scaled")

    def scores(self, df: DataFrame) -> DataFrame:
        return scores(self.model, self._mapped(df))

    def save(self, path: str, spark: SparkSession) -> None:
        self.scaler.write().overwrite().save(f"{path}/scaler")
        self.model.write().overwrite().save(f"{path}/svm")
        # the random features are drawn again from their seed
        _write_own(spark, path, {"c": self.c, "n": self.n, "seed": self.seed, "size": self.size, "gamma": self.gamma})

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> KernelSvm:
        own = _read_own(spark, path)
        model = cls(own["c"], own["n"], own["seed"])
        model.size, model.gamma = own["size"], own["gamma"]
        model.scaler, model.model = StandardScalerModel.load(f"{path}/scaler"), LinearSVCModel.load(f"{path}/svm")
        return model


#: The families that are no Spark ML pipelines; they fit, score, save and load themselves.
OWN = (Neighbours, KernelSvm, Boosting)


def _write_own(spark: SparkSession, path: str, own: dict) -> None:
    spark.createDataFrame([(json.dumps(own),)], "own string").coalesce(1).write.mode("overwrite").text(f"{path}/own")


def _read_own(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/own").first()[0])


MEASURES = ("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision")


def measures_by(scored: DataFrame, keys: Sequence[str], names: Sequence[str] = MEASURES) -> DataFrame:
    """The named measures of scored rows, a row for each of the keys: all models and folds in the same few passes."""
    out = ev.metrics(ev.confusion(scored, keys=keys), 6).select(*keys, *[n for n in names if n not in ("roc_auc", "average_precision")])
    if "roc_auc" in names:
        out = out.join(ev.roc_auc(scored, keys=keys).withColumnRenamed("auc", "roc_auc"), list(keys), "left")
    if "average_precision" in names:
        out = out.join(ev.average_precision(scored, keys=keys), list(keys), "left")
    return out.select(*keys, *names)


def measures(scored: DataFrame, names: Sequence[str] = MEASURES) -> dict[str, float]:
    """The same of one model's rows, as numbers."""
    row = measures_by(materialise(scored.withColumn("one", F.lit(1))), ["one"], names).first()
    return {n: float(row[n]) if row and row[n] is not None else None for n in names}


def _together(jobs: Sequence, most: int = 8) -> list:
    """Calls the functions, a few at a time; each starts Spark jobs of its own."""
    with ThreadPoolExecutor(most) as pool:
        return list(pool.map(lambda job: job(), jobs))


_METRICS = "model string, accuracy double, precision double, recall double, f1 double, roc_auc double, average_precision double"


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def train_and_compare(train: DataFrame, test: DataFrame, models: dict | None = None) -> tuple[DataFrame, dict]:
    """A row of measures on the test rows for each model, and the fitted models; by default all six families."""
    models = families() if models is None else models
    train = train.persist()
    fitted = dict(zip(models, _together([partial(fit, e, train) for e in models.values()])))
    scored = reduce(DataFrame.unionByName, [scores(m, test).withColumn("model", F.lit(n)) for n, m in fitted.items()])
    table = measures_by(materialise(scored), ["model"])
    train.unpersist()
    return table, fitted


def compare_long(table: DataFrame) -> DataFrame:
    """(model, metric, value), and whether the model is the best by F1 (ties by name)."""
    best = table.orderBy(F.desc("f1"), "model").limit(1).select(F.col("model").alias("best"))
    long = table.unpivot(["model"], [c for c in table.columns if c != "model"], "metric", "value")
    return long.crossJoin(F.broadcast(best)).select("model", "metric", "value", (F.col("model") == F.col("best")).alias("is_best"))  # a single row


def search(df: DataFrame, estimator, combinations: Sequence[dict], parallelism: int = 8):
    """The best combination by F1 of the positive class over the folds in column fold, refitted on all rows; and
    (parameters, f1) of each combination. Forests grow side by side, by search_forests()."""
    if isinstance(estimator, RandomForestClassifier):
        return search_forests(df, combinations, estimator.getSeed())
    rows = weighted(df).withColumn("fold", F.col("fold").cast("int")).persist()
    pipe = pipeline(estimator)
    model = pipe.getStages()[-1]
    grid = [{model.getParam(k): v for k, v in c.items()} for c in combinations] or ParamGridBuilder().build()
    folds = rows.agg(F.max("fold")).first()[0] + 1
    judge = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0)
    found = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, foldCol="fold", parallelism=parallelism).fit(rows)
    rows.unpersist()
    return found.bestModel, _searched(df.sparkSession, combinations, found.avgMetrics)


def _searched(spark: SparkSession, combinations: Sequence[dict], f1: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(json.dumps(c, sort_keys=True), float(f)) for c, f in zip(combinations, f1)], "parameters string, f1 double")


def search_own(df: DataFrame, family: str, combinations: Sequence[dict]):
    """As search(), for the two families that Spark ML lacks. Neighbours are sought once for each fold, for the largest k."""
    rows = df.withColumn("fold", F.col("fold").cast("int")).persist()
    folds, scored = range(rows.agg(F.max("fold")).first()[0] + 1), []

    def of_fold(fold: int) -> list[DataFrame]:
        train, valid = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        if family == "svm":
            found = [scores(KernelSvm(**c).fit(train), valid) for c in combinations]
        else:
            model = Neighbours(k=max(c["k"] for c in combinations)).fit(train)
            near = materialise(model.near(valid))
            found = [model.voted(near, valid, **c) for c in combinations]
        return [f.select(F.lit(k).alias("combination"), F.lit(fold).alias("fold"), "id", "label", "score", "predicted") for k, f in enumerate(found)]

    for found in _together([partial(of_fold, fold) for fold in folds]):
        scored += found
    each = measures_by(materialise(reduce(DataFrame.unionByName, scored)), ["combination", "fold"], ("f1",))
    f1 = {r.combination: r.f1 for r in each.groupBy("combination").agg(F.avg("f1").alias("f1")).collect()}  # a row for each combination
    best = max(range(len(combinations)), key=lambda k: (f1[k], -k))
    model = (KernelSvm if family == "svm" else Neighbours)(**combinations[best]).fit(rows)
    rows.unpersist()
    return model, _searched(df.sparkSession, combinations, [f1[k] for k in range(len(combinations))])


def _f1(counts: np.ndarray, combinations: int) -> list[float]:
    """The mean F1 over folds of each combination, from (combinations x folds, 4) counts of outcomes."""
    _, fp, fn, tp = counts.T
    f1 = np.divide(2 * tp, 2 * tp + fp + fn, out=np.zeros(len(tp)), where=tp > 0)
    return f1.reshape(combinations, -1).mean(axis=1).tolist()


def _folds_of(df: DataFrame) -> tuple[DataFrame, int, list[int]]:
    rows = df.withColumn("fold", F.col("fold").cast("int")).persist()
    n, last = rows.agg(F.count(F.lit(1)), F.max("fold")).first()
    return rows, n, list(range(last + 1))


def search_logistic(df: DataFrame, combinations: Sequence[dict], seed: int = 42):
    """As search(), with all combinations and folds fitted in the same passes over the rows."""
    rows, n, folds = _folds_of(df)
    held = blocks(rows.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"), "fold"), n)
    fits = [linear.Fit(f, c["regParam"], c["elasticNetParam"]) for c in combinations for f in folds]
    thetas, scale, _ = linear.fit_many(held, fits)
    f1 = _f1(linear.validated(held, fits, thetas, scale), len(combinations))
    held.unpersist()
    base = estimators(seed)["logistic"]
    best = combinations[max(range(len(f1)), key=lambda k: (f1[k], -k))]
    model = fit(base.copy({base.getParam(k): v for k, v in best.items()}), df)
    rows.unpersist()
    return model, _searched(df.sparkSession, combinations, f1)


def search_trees(df: DataFrame, combinations: Sequence[dict], seed: int = 42):
    """As search(): trees of all folds grow side by side, and those that differ by depth alone are one tree, cut at each."""
    rows, n, folds = _folds_of(df)
    bounds = trees.edges(rows, "features", len(rows.select("features").first()[0]))
    held = trees.prepared(rows, bounds, n)
    deepest = max(c["maxDepth"] for c in combinations)
    kinds = list(dict.fromkeys((c["minInstancesPerNode"], c["impurity"]) for c in combinations))
    runs = {(kind, f): trees.Run(f, deepest, *kind) for kind in kinds for f in folds}
    trees.grow(held, list(runs.values()))
    asked = [(runs[(c["minInstancesPerNode"], c["impurity"]), f], None, c["maxDepth"]) for c in combinations for f in folds]
    f1 = _f1(trees.validated(held, asked), len(combinations))
    held.unpersist()
    base = estimators(seed)["tree"]
    best = combinations[max(range(len(f1)), key=lambda k: (f1[k], -k))]
    model = fit(base.copy({base.getParam(k): v for k, v in best.items()}), df)
    rows.unpersist()
    return model, _searched(df.sparkSession, combinations, f1)


def search_forests(df: DataFrame, combinations: Sequence[dict], seed: int = 42):
    """As search(): the trees of all forests and folds grow side by side; forests that differ by number and depth of trees
    alone are the same trees, the first of them and cut. The best one is fitted by Spark."""
    rows, n, folds = _folds_of(df)
    size = len(rows.select("features").first()[0])
    held = trees.prepared(rows, trees.edges(rows, "features", size), n, forests.LEAST_ROWS)
    leasts, most = list(dict.fromkeys(c["minInstancesPerNode"] for c in combinations)), max(c["numTrees"] for c in combinations)
    grown = {(least, f): [forests.Bagged(f, least, k, seed) for k in range(most)] for least in leasts for f in folds}
    # as many features for a node as Spark's forests take
    forests.grow(held, [t for own in grown.values() for t in own], max(c["maxDepth"] for c in combinations), ceil(sqrt(size)))
    f1 = _f1(forests.validated(held, [(grown[c["minInstancesPerNode"], f][: c["numTrees"]], c["maxDepth"]) for c in combinations for f in folds]), len(combinations))
    held.unpersist()
    base = estimators(seed)["forest"]
    best = combinations[max(range(len(f1)), key=lambda k: (f1[k], -k))]
    model = fit(base.copy({base.getParam(k): v for k, v in best.items()}), df)
    rows.unpersist()
    return model, _searched(df.sparkSession, combinations, f1)


def search_boosting(df: DataFrame, combinations: Sequence[dict], seed: int = 42):
    """As search(): boosted trees of all folds, and of all rows, grow side by side, and combinations that differ by the number
    of rounds alone are one sequence of trees. Also gives the best one's scores of the rows that each fold left out."""
    rows, n, folds = _folds_of(df)
    bounds = trees.edges(rows, "features", len(rows.select("features").first()[0]))
    held = trees.prepared(rows, bounds, n)
    most = max(c["rounds"] for c in combinations)
    kinds = list(dict.fromkeys((c["depth"], c["rate"], c["share"]) for c in combinations))
    runs = {(kind, f): Boosting(most, *kind, seed=seed).run(f) for kind in kinds for f in [*folds, -1]}
    trees.grow(held, list(runs.values()))
    own = lambda c, f: runs[(c["depth"], c["rate"], c["share"]), f]
    f1 = _f1(trees.validated(held, [(own(c, f), c["rounds"], None) for c in combinations for f in folds]), len(combinations))
    held.unpersist()
    best = combinations[max(range(len(f1)), key=lambda k: (f1[k], -k))]

    def model(out: int) -> Boosting:
        made = Boosting(**best, seed=seed)
        made.bounds, made.grown = bounds, made.run(out)
        made.grown.start, made.grown.trees = own(best, out).start, own(best, out).trees[: best["rounds"]]
        return made

    left_out = [model(f).scores(rows.where(F.col("fold") == f)).withColumn("fold", F.lit(f)) for f in folds]
    scored = materialise(reduce(DataFrame.unionByName, left_out))
    rows.unpersist()
    return model(-1), _searched(df.sparkSession, combinations, f1), scored


def search_all(df: DataFrame, seed: int = 42) -> tuple[dict, DataFrame, dict[str, DataFrame]]:
    """The best model of every family; (family, parameters, f1) of all combinations searched: whole grids, but for forest and
    boosting 20 combinations that are drawn, or all if there are fewer; and, of the families whose search keeps them, the
    scores of the rows that each fold left out."""
    whole = grids(df.where("fold <> 0").count())
    own = {n: draw(g, 20, seed) if n in ("forest", "boosting") else g for n, g in whole.items()}
    found = dict(zip(own, _together([
        partial(search_logistic, df, own["logistic"], seed), partial(search_trees, df, own["tree"], seed),
        partial(search, df, estimators(seed)["forest"], own["forest"]), partial(search_boosting, df, own["boosting"], seed),
        partial(search_own, df, "svm", own["svm"]), partial(search_own, df, "neighbours", own["neighbours"])])))
    table = reduce(DataFrame.unionByName, [f[1].select(F.lit(n).alias("family"), "parameters", "f1") for n, f in found.items()])
    return {n: f[0] for n, f in found.items()}, table, {n: f[2] for n, f in found.items() if len(f) > 2}


def tuned(searched: DataFrame, seed: int = 42) -> dict:
    """An estimator of each family with its best parameters, from a table of search_all(); ties to the first in order."""
    out, plain = {}, families(seed)
    for r in searched.orderBy("family", F.desc("f1"), "parameters").collect():  # a row for each combination
        if r.family not in out:
            own = json.loads(r.parameters)
            base = plain[r.family]
            out[r.family] = type(base)(**own) if isinstance(base, OWN) else base.copy({base.getParam(k): v for k, v in own.items()})
    return out


def cross_validate(df: DataFrame, models: dict, resample: bool = False, seed: int = 42, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """(model, metric, mean, std) of each of the models (name: estimator) over the folds in column fold; std is the
    population's. With resample, synthetic rows are made inside each fold's training rows only. known: models whose
    scores of the rows left out are there already (id, label, score, predicted, fold)."""
    known = known or {}
    rows = df.persist()

    def of_fold(fold: int, name: str, estimator) -> DataFrame:
        train = rows.where(F.col("fold") != fold)
        if resample:
            dense = train.select("id", vector_to_array("features").alias("x"), "label")
            train = materialise(smote(dense, seed=seed)).select("id", array_to_vector("x").alias("features"), "label")
        return scores(fit(estimator, train), rows.where(F.col("fold") == fold)).withColumns({"model": F.lit(name), "fold": F.lit(fold)})

    folds = range(rows.agg(F.max("fold")).first()[0] + 1)
    scored = _together([partial(of_fold, k, n, e) for n, e in models.items() if n not in known for k in folds])
    scored += [df.withColumn("model", F.lit(n)) for n, df in known.items() if n in models]
    names = ("accuracy", "f1", "roc_auc")
    each = measures_by(materialise(reduce(DataFrame.unionByName, scored)), ["model", "fold"], names)
    long = each.unpivot(["model", "fold"], list(names), "metric", "value")
    out = materialise(long.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")))
    rows.unpersist()
    return out


def with_cv(table: DataFrame, cv: DataFrame) -> DataFrame:
    """A row of measures for each model, with cv_<metric>_mean and cv_<metric>_std beside those on test rows."""
    wide = cv.groupBy("model").pivot("metric", ["accuracy", "f1", "roc_auc"]).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    short = {"accuracy": "acc", "f1": "f1", "roc_auc": "roc"}
    return table.join(wide.select("model", *[F.col(f"{m}_{s}").alias(f"cv_{n}_{s}") for m, n in short.items() for s in ("mean", "std")]), "model", "left")


def learning_curve(df: DataFrame, estimator, shares: Sequence[float] = (0.1, 0.25, 0.5, 1.0), seed: int = 42) -> DataFrame:
    """(share, rows, train_f1, valid_f1, their deviations) over growing stratified samples and the folds in column fold."""
    steps = materialise(learning_steps(df, "label", "id", list(shares), seed))
    scored = []

    def of_step(k: int, fold: int) -> list[DataFrame]:
        train, valid = steps.where((F.col("step") <= k) & (F.col("fold") != fold)), steps.where(F.col("fold") == fold)
        model = fit(estimator, train)
        return [scores(model, rows).select(F.lit(k).alias("k"), F.lit(fold).alias("fold"), F.lit(part).alias("part"), "label", "score", "predicted")
                for part, rows in (("train", train), ("valid", valid))]

    folds = range(steps.agg(F.max("fold")).first()[0] + 1)
    for found in _together([partial(of_step, k, fold) for k in range(len(shares)) for fold in folds]):
        scored += found
    counts = ev.confusion(materialise(reduce(DataFrame.unionByName, scored)), keys=["k", "fold", "part"])
    each = ev.metrics(counts, 6).withColumn("n", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    share = F.get(F.array(*[F.lit(float(s)) for s in shares]), F.col("k"))
    of = lambda part, c: F.when(F.col("part") == part, F.col(c))
    return each.groupBy(share.alias("share")).agg(
        F.avg(of("train", "n")).alias("rows"), F.avg(of("train", "f1")).alias("train_f1"), F.stddev_pop(of("train", "f1")).alias("train_std"),
        F.avg(of("valid", "f1")).alias("valid_f1"), F.stddev_pop(of("valid", "f1")).alias("valid_std"))


def importance(spark: SparkSession, model: PipelineModel, names: Sequence[str], most: int = 15) -> DataFrame:
    """The features that weigh most: tree importances, or absolute coefficients."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else np.abs(last.coefficients.toArray())
    rows = sorted(zip(names, map(float, values)), key=lambda r: (-r[1], r[0]))[:most]
    return spark.createDataFrame(rows, "feature string, importance double")


def tune_threshold(scored: DataFrame) -> float:
    return float(ev.best_threshold(ev.threshold_sweep(scored)).first()["threshold"])


def retrain(train: DataFrame, valid: DataFrame, test: DataFrame, estimator=None, seed: int = 42) -> DataFrame:
    """Measures on the test rows of a baseline, of the same retrained with synthetic minority rows, and of the baseline
    at the threshold that is best on the validation rows."""
    estimator = estimator or estimators(seed)["forest"]
    base = pipeline(estimator).fit(weighted(train))
    dense = train.select("id", vector_to_array("features").alias("x"), "label")
    # a fit reads its rows many times, and neighbours are to be found once
    more = materialise(smote(dense, seed=seed)).select("id", array_to_vector("x").alias("features"), "label")
    again = pipeline(estimator).fit(weighted(more))
    edge = tune_threshold(scores(base, valid))
    scored = scores(base, test)
    rows = [
        {"model": "baseline"} | measures(scored),
        {"model": "smote"} | measures(scores(again, test)),
        {"model": "threshold"} | measures(scored.withColumn("predicted", (F.col("score") >= edge).cast("int"))),
    ]
    return _table(train.sparkSession, rows, _METRICS)


def save(model, names: Sequence[str], path: str, spark: SparkSession) -> None:
    """A model of any family with its scaler, and the ordered list of features, in one folder of any file system that Spark
    writes to."""
    if isinstance(model, OWN):
        model.save(f"{path}/model", spark)
    else:
        model.write().overwrite().save(f"{path}/model")
    kept = json.dumps({"kind": type(model).__name__, "features": list(names)})
    spark.createDataFrame([(kept,)], "features string").coalesce(1).write.mode("overwrite").text(f"{path}/features")


def load(path: str, spark: SparkSession) -> tuple:
    """(model, feature names) of what save() wrote."""
    kept = json.loads(spark.read.text(f"{path}/features").first()[0])
    own = {c.__name__: c for c in OWN}.get(kept["kind"])
    return PipelineModel.load(f"{path}/model") if own is None else own.load(f"{path}/model", spark), kept["features"]


def fourier_features(df: DataFrame, features: str, size: int, gamma: float, n: int = 256, seed: int = 42) -> DataFrame:
    """df with column fourier (vector): random features whose products approximate the RBF kernel of a vector of `size`."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (size, n)), rng.uniform(0, 2 * np.pi, n)

    @F.pandas_udf("array<double>")
    def mapped(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.sqrt(2 / n) * np.cos(np.stack(x.to_numpy()) @ w + b)) if len(x) else [], dtype=object)

    return df.withColumn("fourier", array_to_vector(mapped(vector_to_array(features))))
