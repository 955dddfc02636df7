"""Joins whose keys may be hot: one value may hold a third of all rows, and its rows are still spread over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hot keys are those with over one in so many of all rows, so there are fewer of them, and over so many rows.
MOST_HOT, LEAST_ROWS = 4096, 64


def hot_keys(counts: DataFrame, keys: Sequence[str], total: int, least: int = LEAST_ROWS) -> DataFrame:
    """(keys, parts): the keys of more than `edge` rows, and in how many parts their rows are to be dealt.
    counts: keys and n, the rows of each key; total: all rows. The edge grows with the total, so that there are at most
    MOST_HOT hot keys, and MOST_HOT parts beside one for each, however many keys there are."""
    edge = max(least, -(-total // MOST_HOT))
    return counts.where(F.col("n") > edge).select(*keys, F.ceil(F.col("n") / edge).cast("int").alias("__parts"))


def spread_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], hot: DataFrame, by: Sequence[str | Column], how: str = "inner") -> DataFrame:
    """rows joined with table on keys, of which the table has few rows for each key (how: inner or left). The rows of a
    hot key are dealt into parts by a hash of the columns `by`, and each part meets a copy of the key's rows of the table.

    The two sides are merged, never broadcast: either may grow with the input, and Spark sizes it too low after an explode or
    by compressed files. A hint on `table` would be spent on the join with hot."""
    hot = F.broadcast(hot)  # at most MOST_HOT rows
    part = F.coalesce(F.pmod(F.xxhash64(*by), F.col("__parts")).cast("int"), F.lit(0))
    left = rows.join(hot, list(keys), "left").withColumn("__part", part).drop("__parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    right = table.join(hot, list(keys), "left").withColumn("__part", copies).drop("__parts")
    return left.join(right.hint("merge"), [*keys, "__part"], how).drop("__part")


def lookup(rows: DataFrame, table: DataFrame, value: Column, name: str) -> DataFrame:
    """rows with the columns of a table that has one row for each value of its column `name`, which is left out; null where
    `value` is null or not there. The rows of a frequent value are dealt over many tasks by a hash of all their columns."""
    keyed = rows.withColumn(name, value)
    counts = keyed.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return spread_join(keyed, table, [name], hot_keys(counts, [name], rows.count()), [F.col(f"`{c}`") for c in rows.columns], "left").select(
        *[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"`{c}`") for c in table.columns if c != name])
