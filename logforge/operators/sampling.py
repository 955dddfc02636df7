"""Samples, splits and folds in the order of a hash: the same rows under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logforge.functions.ordered import hash_rank, hashed
from logforge.operators.missing import col


def _ranked(df: DataFrame, label: str, id_col: str, seed: int) -> DataFrame:
    """Rank within the class and size of the class; rows without a class are left out."""
    rows = df.where(col(label).isNotNull())
    sizes = rows.groupBy(col(label).alias("__label")).agg(F.count(F.lit(1)).alias("__size"))
    ranked = hash_rank(rows, id_col, seed, [label], "__rank")
    return ranked.join(sizes, col(label) == F.col("__label")).drop("__label")


def stratified_sample(df: DataFrame, label: str, id_col: str, fraction: float, seed: int = 42) -> DataFrame:
    """round(fraction n) rows of each class, halves to even."""
    return _ranked(df, label, id_col, seed).where(F.col("__rank") <= F.bround(F.col("__size") * F.lit(fraction))).drop("__rank", "__size")


def random_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, or all if there are fewer; the n smallest hashes, which Spark takes by partial top lists."""
    return df.orderBy(hashed(seed, col(id_col)), col(id_col)).limit(n)


def capped_sample(df: DataFrame, id_col: str, cap: int = 1000, seed: int = 42) -> DataFrame:
    """Rows without nulls, at most `cap` of them, for a look at pairs of columns."""
    return random_sample(df.dropna(), id_col, cap, seed)


def sample(df: DataFrame, id_col: str, fraction: float, label: str | None = None, seed: int = 42) -> DataFrame:
    """Stratified if the label's column exists, else plain."""
    if label is not None and label in df.columns:
        return stratified_sample(df, label, id_col, fraction, seed)
    ranked = hash_rank(df, id_col, seed, [], "__rank")
    size = df.agg(F.count(F.lit(1)).alias("__size"))
    return ranked.crossJoin(F.broadcast(size)).where(F.col("__rank") <= F.bround(F.col("__size") * F.lit(fraction))).drop("__rank", "__size")  # a single row


def train_test_split(df: DataFrame, label: str, id_col: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """df with split: test for round(test n) rows of each class, train for the others."""
    is_test = F.col("__rank") <= F.bround(F.col("__size") * F.lit(test))
    return _ranked(df, label, id_col, seed).withColumn("split", F.when(is_test, "test").otherwise("train")).drop("__rank", "__size")


def folds(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """df with fold 0..k-1, dealt in turn within each class."""
    return _ranked(df, label, id_col, seed).withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank", "__size")


def learning_steps(df: DataFrame, label: str, id_col: str, shares: list[float], seed: int = 42) -> DataFrame:
    """df with step: the first of the shares whose stratified sample has the row; samples grow from step to step."""
    step: Column = F.lit(len(shares))
    for k in range(len(shares) - 1, -1, -1):
        step = F.when(F.col("__rank") <= F.bround(F.col("__size") * F.lit(shares[k])), k).otherwise(step)
    return _ranked(df, label, id_col, seed).withColumn("step", step.cast("int")).drop("__rank", "__size")
