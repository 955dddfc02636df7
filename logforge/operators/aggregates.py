"""Grouped aggregates, top lists and distributions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logforge.functions.heavy import top_values
from logforge.functions.ordered import QUARTILES, Sketches, exact_quantiles, grouped_medians
from logforge.functions.passes import blocks, summed
from logforge.functions.stats import kurtosis_corrected, skew_corrected
from logforge.operators.missing import batches, col, numeric_columns
from logforge.operators.quality import _long


def by_actor(df: DataFrame, actor: str, ts: str, label: str) -> DataFrame:
    """Events with a time, labelled events and the label's mean for each actor; rows without an actor are left out."""
    return df.where(col(actor).isNotNull()).groupBy(col(actor).alias("actor")).agg(
        F.count(col(ts)).alias("event_count"), F.sum(col(label)).cast("long").alias("bot_events"), F.avg(col(label)).alias("bot_ratio"))


def counts(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    """Rows for each value of a key; null is no value."""
    return df.where(col(key).isNotNull()).groupBy(col(key).alias("value")).agg(F.count(F.lit(1)).alias(out))


def top(df: DataFrame, by: str, ties: str, most: int = 10) -> DataFrame:
    """The first rows by a measure; ties in the order of `ties`."""
    return df.orderBy(F.desc(by), ties).limit(most)


def top_actors(df: DataFrame, actor: str, ts: str, most: int = 10) -> DataFrame:
    """(actor, event_count): the actors of most events with a time, ties in the order of actors."""
    return top_values(df, col(actor), most, col(ts).isNotNull().cast("long")).select(F.col("value").alias("actor"), F.col("n").alias("event_count"))


def hourly_volume(df: DataFrame, ts: str, hours: int = 1) -> DataFrame:
    """Events in each bucket of so many hours between the first event and the last; empty buckets have 0."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    step = F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(0), F.lit(0))
    days = F.datediff(F.to_date(col(ts)), F.lit("1970-01-01").cast("date")).cast("long")
    bucket = F.floor((days * 24 + F.hour(col(ts))) / hours).cast("long")
    found = df.where(col(ts).isNotNull()).groupBy(bucket.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    spine = found.agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("k"))
    at = start + step * F.col("k")
    return spine.join(found, "k", "left").select(at.alias("bucket"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and percent of each class, and the imbalance ratio of the largest to the smallest."""
    every = Window.partitionBy()  # as many rows as there are classes
    n = df.where(col(label).isNotNull()).groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("label", "n", F.round(100.0 * F.col("n") / F.sum("n").over(every), 2).alias("pct"),
                    F.round(F.max("n").over(every) / F.min("n").over(every), 4).alias("imbalance"))


def grouped_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    x = col(value).cast("double")
    rows = df.where(col(key).isNotNull()).select(col(key).alias("key"), x.alias("x"))
    out = rows.groupBy("key").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.count("x").alias("n"))
    return out.join(grouped_medians(rows), "key", "left").select("key", "mean", "median", "std", "n")


def numeric_summary(df: DataFrame, names: list[str] | None = None, held: Sketches | None = None) -> DataFrame:
    """Describe, missing values, bias-corrected skewness and excess kurtosis of each numeric column. held: sketches of these
    rows, if there are any."""
    parts = []
    for part in batches(numeric_columns(df) if names is None else names, 40):
        found = exact_quantiles(df, {c: col(c) for c in part}, QUARTILES, held)

        def stats(c):
            x = col(c).cast("double")
            return F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                            F.array(*[F.lit(v).cast("double") for v in found[c] or [None] * 3]).alias("q"), F.max(x).alias("max"),
                            F.count_if(x.isNull()).alias("missing"), skew_corrected(x).alias("skewness"), kurtosis_corrected(x).alias("kurtosis"))

        wide = df.agg(*[stats(c).alias(str(k)) for k, c in enumerate(part)])
        parts.append(_long(wide, part, "v").select(
            "column", "v.n", "v.mean", "v.std", "v.min", F.col("v.q")[0].alias("p25"), F.col("v.q")[1].alias("p50"), F.col("v.q")[2].alias("p75"),
            "v.max", "v.missing", "v.skewness", "v.kurtosis"))
    return reduce(DataFrame.unionByName, parts)


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value, n) for every value of each column, null too: one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in names])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))


def _products(block: dict, shift: np.ndarray) -> tuple[np.ndarray, ...]:
    """Over the rows that have both of two columns: how many, the sums and squares of the one, and the products."""
    x = block["x"].astype(float) - shift
    there = np.isfinite(x)
    x = np.where(there, x, 0.0)
    there = there.astype(float)
    return there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x


def correlation_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, r) for every pair a < b in the order of names: Pearson's r over rows that have both (finite) values; null where
    a column doesn't vary. One scan for all pairs: partitions add up four products of the columns' matrix and of its mask."""
    schema = "a string, b string, r double"
    pairs = list(combinations(range(len(names)), 2))
    values = df.select(F.array(*[col(c).cast("double") for c in names]).alias("x"))
    if not pairs or (start := values.first()) is None:
        return df.sparkSession.createDataFrame([(names[i], names[j], None) for i, j in pairs], schema)
    shift = np.array([0.0 if v is None or not np.isfinite(v) else v for v in start.x])  # near the values, so that sums keep their digits
    n, sums, squares, products = summed(blocks(values), _products, shift)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = squares - sums**2 / n
        spread = np.where(spread > 1e-13 * squares, spread, np.nan)
        r = (products - sums * sums.T / n) / np.sqrt(spread * spread.T)
    rows = [(names[i], names[j], float(r[i, j]) if np.isfinite(r[i, j]) else None) for i, j in pairs]  # a row for each pair of columns
    return df.sparkSession.createDataFrame(rows, schema)


def top_correlations(df: DataFrame, names: list[str], most: int = 10) -> DataFrame:
    """The pairs of largest absolute correlation."""
    found = correlation_pairs(df, names).where(F.col("r").isNotNull() & ~F.isnan("r"))
    return found.orderBy(F.desc(F.round(F.abs("r"), 9)), "a", "b").limit(most)


def histogram(df: DataFrame, name: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of equal-width bins from the least value to the greatest, which is in the last bin."""
    x = col(name).cast("double")
    edges = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).where("lo is not null")
    k = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int")
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0 / bins)
    edges = edges.withColumn("w", width)
    n = df.where(x.isNotNull()).select(x.alias("x")).crossJoin(F.broadcast(edges)).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # a single row
    spine = edges.select("lo", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(n, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"),
                                               (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def box_stats(df: DataFrame, name: str) -> DataFrame:
    """Quartiles, and whiskers: the outermost values within 1.5 interquartile ranges; how many lie beyond."""
    x = col(name).cast("double")
    q = df.sparkSession.createDataFrame([exact_quantiles(df, {name: x}, QUARTILES)[name] or [None] * 3], "q1 double, median double, q3 double")
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    met = df.where(x.isNotNull()).select(x.alias("x")).crossJoin(F.broadcast(q))  # a single row
    inside = F.col("x").between(low, high)
    return met.groupBy("q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("x"))).alias("low_whisker"), F.max(F.when(inside, F.col("x"))).alias("high_whisker"),
        F.count_if(~inside).alias("n_beyond"))


def hour_counts(df: DataFrame, ts: str) -> DataFrame:
    return df.where(col(ts).isNotNull()).groupBy(F.hour(col(ts)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def weekday_counts(df: DataFrame, ts: str) -> DataFrame:
    """Events by weekday, 0 for Monday."""
    names = F.array(*[F.lit(d) for d in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")])
    out = df.where(col(ts).isNotNull()).groupBy(F.weekday(col(ts)).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("weekday", F.get(names, F.col("weekday")).alias("name"), "n")


def stage_class_counts(stages: dict[str, DataFrame], label: str) -> DataFrame:
    """Rows of each class in each stage: one row for each class, one column for each stage."""
    long = reduce(DataFrame.unionByName, [
        df.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(s)) for s, df in stages.items()])
    return long.groupBy("label").pivot("stage", list(stages)).agg(F.first("n")).na.fill(0)
