"""Principal components and feature selection."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logforge.operators.missing import batches, col, fill_numeric, variances


def to_vector(df: DataFrame, names: list[str], out: str = "features") -> DataFrame:
    """Numeric columns, or one array column, as a vector."""
    if len(names) == 1 and dict(df.dtypes)[names[0]].startswith("array"):
        return df.withColumn(out, array_to_vector(col(names[0]).cast("array<double>")))
    return VectorAssembler(inputCols=names, outputCol=out, handleInvalid="error").transform(df)


class Pca:
    """Principal components of standardised features (Spark's own doesn't centre when it transforms). Each component's
    sign makes its largest loading positive."""

    def __init__(self, df: DataFrame, features: str, share: float | int = 0.95):
        self.scaler = StandardScaler(withMean=True, withStd=True, inputCol=features, outputCol="__scaled").fit(df)
        size = len(self.scaler.mean)
        self.model = PCA(k=size, inputCol="__scaled", outputCol="__scores").fit(self.scaler.transform(df))
        self.variance = np.asarray(self.model.explainedVariance.toArray())
        if isinstance(share, int):
            self.k = min(share, size)
        else:
            self.k = min(size, int(np.searchsorted(np.cumsum(self.variance), share - 1e-12)) + 1)
        loads = self.model.pc.toArray()[:, : self.k]
        self.signs = np.where(loads[np.abs(loads).argmax(axis=0), range(self.k)] < 0, -1.0, 1.0)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with PC_1 .. PC_k, bound to its rows in place."""
        kept = [col(c) for c in df.columns]
        scores = vector_to_array("__scores")
        out = self.model.transform(self.scaler.transform(df))
        return out.select(*kept, *[(scores[i] * F.lit(float(self.signs[i]))).alias(f"PC_{i + 1}") for i in range(self.k)])

    def explained(self, df: DataFrame) -> DataFrame:
        """(component, variance, cumulative) of the components kept."""
        rows = [(i + 1, float(v), float(c)) for i, (v, c) in enumerate(zip(self.variance, np.cumsum(self.variance)))][: self.k]
        return df.sparkSession.createDataFrame(rows, "component int, variance double, cumulative double")


def pca_columns(df: DataFrame, names: list[str], k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Scores and explained variances of at most k components of numeric columns, nulls filled with means."""
    filled = to_vector(fill_numeric(df, "mean", names), names, "__features")
    model = Pca(filled, "__features", min(k, len(names)))
    return model.transform(filled).drop("__features"), model.explained(df)


def variance_filter(df: DataFrame, names: list[str], threshold: float) -> list[str]:
    """The columns whose population variance is over the threshold."""
    found = variances(df, names, population=True)
    return [c for c in names if found[c] > threshold]


def anova_f(df: DataFrame, names: list[str], target: str) -> DataFrame:
    """(feature, f): one-way analysis of variance. Rows without a target are left out. The rows are read once for each
    batch of features: a row of sums for each class, which are then turned into a row for each feature and class."""
    parts = []
    for part in batches(names):
        triples = [F.struct(F.lit(c).alias("feature"), F.count(col(c)).cast("double").alias("n"), F.sum(col(c).cast("double")).alias("s"),
                            F.sum(col(c).cast("double") * col(c)).alias("q")).alias(str(k)) for k, c in enumerate(part)]
        sums = df.where(col(target).isNotNull()).groupBy(col(target)).agg(*triples)
        parts.append(sums.select(F.explode(F.array(*[F.col(str(k)) for k in range(len(part))])).alias("e")).select("e.*"))
    total = reduce(DataFrame.unionByName, parts).where("n > 0").groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count(F.lit(1)).alias("c"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("c") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("c"))
    return total.select("feature", F.try_divide(between, within).alias("f"))


def anova_top(df: DataFrame, names: list[str], target: str, k: int = 20) -> DataFrame:
    return anova_f(df, names, target).where(F.col("f").isNotNull()).orderBy(F.desc(F.round("f", 9)), "feature").limit(k)
