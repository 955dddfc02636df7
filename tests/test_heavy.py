"""The most frequent values against plain aggregation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logforge.functions import heavy


def _plain(df, most):
    return [tuple(r) for r in df.where("v is not null").groupBy("v").agg(F.sum(F.coalesce("w", F.lit(0))).alias("n")).orderBy(F.desc("n"), "v").limit(most).collect()]


def _skewed(spark, rows=30_000):
    """Twenty values have most of the rows, and thousands of values a row or two each; some are null."""
    heavy_one = F.pow(F.lit(20.0), F.pmod(F.hash("id"), F.lit(1000)) / 1000).cast("long")
    return spark.range(0, rows, 1, 7).select(F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 4 == 1, F.col("id") + 100).otherwise(heavy_one).alias("v"),
                                             F.lit(1).cast("long").alias("w"))


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_top_values_of_many(spark, monkeypatch, kind):
    monkeypatch.setattr(heavy, "HELD", 64)
    df = _skewed(spark).withColumn("v", F.col("v").cast(kind))
    assert [tuple(r) for r in heavy.top_values(df, F.col("v"), 10).collect()] == _plain(df, 10)
    weighed = df.withColumn("w", F.when(F.col("v") == "3", F.lit(None)).otherwise(F.col("w") * 3))
    assert [tuple(r) for r in heavy.top_values(weighed, F.col("v"), 10, F.col("w")).collect()] == _plain(weighed, 10)


def test_summaries_bound_every_weight(spark):
    df = _skewed(spark, 150_000)  # several batches of each partition
    found = heavy.summarise(df, F.col("v"), held=50)
    true = {r.v: r["count"] for r in df.where("v is not null").groupBy("v").count().collect()}
    held = dict(zip(found.counts["value"].to_pylist(), found.counts["n"].to_pylist()))
    assert len(held) <= 50 and 0 < found.error <= sum(true.values()) / 51
    assert all(held.get(v, 0) <= n <= held.get(v, 0) + found.error for v, n in true.items())


def test_only_candidates_are_added_up(spark, monkeypatch):
    monkeypatch.setattr(heavy, "HELD", 64)
    asked = []
    plain = heavy.F.broadcast
    monkeypatch.setattr(heavy.F, "broadcast", lambda df: asked.append(df.count()) or plain(df))
    heavy.top_values(_skewed(spark), F.col("v"), 5).collect()
    assert len(asked) == 1 and 5 <= asked[0] <= 64


def test_even_weights_are_all_added_up(spark, monkeypatch):
    """No summary proves anything where all values weigh the same: each is tried, and then all values are aggregated."""
    monkeypatch.setattr(heavy, "HELD", 16)
    monkeypatch.setattr(heavy, "WIDEST", 200)
    widths = []
    summarise = heavy.summarise
    monkeypatch.setattr(heavy, "summarise", lambda *a: widths.append(a[3]) or summarise(*a))
    df = spark.range(0, 6000, 1, 5).select((F.col("id") % 3000).alias("v"), F.lit(1).cast("long").alias("w"))
    assert [tuple(r) for r in heavy.top_values(df, F.col("v"), 4).collect()] == [(0, 2), (1, 2), (2, 2), (3, 2)]
    assert widths == [16, 128]


def test_top_values_of_odd_tables(spark):
    empty = spark.createDataFrame([], "v string")
    assert heavy.top_values(empty, F.col("v"), 3).collect() == []
    assert heavy.top_values(spark.createDataFrame([(None,)] * 4, "v string"), F.col("v"), 3).collect() == []
    ties = spark.createDataFrame([(dt.date(2024, 1, d), None if d == 3 else 1) for d in (3, 2, 1, 3)], "v date, w int")
    got = heavy.top_values(ties, F.col("v"), 5, F.col("w"))
    assert [tuple(r) for r in got.collect()] == [(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 1), (dt.date(2024, 1, 3), 0)]
