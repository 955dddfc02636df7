"""Ranks and running totals without a window that holds a whole class, or the whole table, in one task."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logforge.functions.lineage import materialise


def running_totals(df: DataFrame, bucket: Column, order: Sequence[Column], sums: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """df with a running total for each of sums, in ascending order of (bucket, order) within keys.

    Totals run inside each bucket, in parallel; the small table of the buckets' own totals gives what comes before
    each. bucket must not decrease along the order.
    """
    df = df.withColumn("__bucket", bucket)
    near = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "__bucket").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    totals = totals.select(*keys, "__bucket", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    # null keys are a group too
    on = F.col("a.__bucket").eqNullSafe(F.col("b.__bucket"))
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    inner = df.select("*", *[F.sum(c).over(near).alias(f"__near_{n}") for n, c in sums.items()]).alias("a")
    return inner.join(totals.alias("b"), on).select(
        *[F.col(f"a.{c}") for c in df.columns if c != "__bucket"],
        *[(F.col(f"a.__near_{n}") + F.col(f"b.__{n}")).alias(n) for n in sums])


def hashed(seed: int, *ids: str | Column) -> Column:
    """The MD5 of ids and seed, joined by colons, in hexadecimal digits: SQL engines give the same. Null ids are skipped."""
    return F.md5(F.concat_ws(":", *[F.col(c) if isinstance(c, str) else c for c in ids], F.lit(seed)))


def hash_rank(df: DataFrame, id_col: str, seed: int, keys: Sequence[str] = (), out: str = "rank", digits: int = 3) -> DataFrame:
    """df with the 1-based rank of each row in the order of hashed(seed, id), within keys. The order is that of a plain
    row_number; the work is spread over 16^digits buckets of the hash for each key, each of which one task sorts: 3 digits
    leave it 24,000 rows of 100 million."""
    h = hashed(seed, F.col(f"`{id_col}`"))
    return running_totals(df, F.substring(h, 1, digits), [h, F.col(f"`{id_col}`")], {out: F.lit(1).cast("long")}, keys)


def in_ranges(df: DataFrame, *order: Column, out: str = "range") -> DataFrame:
    """df with the number of its range: ranges ascend in the given order and have about one size, however values are
    spread. Written, so that a task that runs again meets the same ranges."""
    return materialise(df.repartitionByRange(*order).withColumn(out, F.spark_partition_id()))


QUARTILES = [0.25, 0.5, 0.75]


def _edges(buckets: int) -> Column:
    """Rough quantiles of x. Buckets are right for any edges; good ones make them of one size."""
    return F.array_sort(F.percentile_approx("x", [k / buckets for k in range(1, buckets)], 1000)).alias("edges")


def _bucket() -> Column:
    return F.size(F.filter("edges", lambda e: e <= F.col("x")))


#: Size of a column's KLL sketch, which takes at most some 100 KB, and its rank error as a share of the rows (99 times in 100).
SKETCH = 4096
SKETCH_ERROR = 2.296 / SKETCH**0.9723
#: Tasks that merge the sketches of partitions.
MERGERS = 64
#: Values inside a bracket that one task may rank; beyond them, ranges of values are ranked in many tasks.
RANKED = 1_000_000


@dataclass(frozen=True)
class Sketches:
    """Quantile sketches of columns: how many values each has, and its sketch. Made by one read of a table, they serve every
    later question about quantiles of that table. They merge, so a table may be sketched part by part."""

    rows: dict[str, int]
    made: dict[str, bytes]

    def near(self, spark: SparkSession, names: Sequence[str], ranks: Sequence[float]) -> list[list[float]]:
        """For each of the columns, the values whose ranks, from 0 to 1, are about the given ones."""
        asked = F.array(*map(F.lit, ranks))
        return [list(v) for v in spark.sql("SELECT 1").select(*[F.kll_sketch_get_quantile_double(F.lit(bytearray(self.made[c])), asked) for c in names]).first()]

    def merged(self, spark: SparkSession, other: Sketches) -> Sketches:
        """The sketches of both tables' rows together, of the columns that both have."""
        names = [c for c in self.rows if c in other.rows]
        both = spark.createDataFrame([(k, bytearray(x.made[c])) for k, c in enumerate(names) for x in (self, other)], "k int, s binary")
        found = {names[r.k]: bytes(r.s) for r in both.groupBy("k").agg(F.kll_merge_agg_double("s", SKETCH).alias("s")).collect()}  # one for each column
        return Sketches({c: self.rows[c] + other.rows[c] for c in names}, found)


def sketches(df: DataFrame, columns: Mapping[str, Column]) -> Sketches:
    """KLL sketches of columns, taken as doubles, by one read of df. NaN, which is greatest, is sketched as infinity. The
    partitions' sketches are merged in MERGERS tasks before one merges what those have made."""
    values = [c.cast("double") for c in columns.values()]
    if not values:
        return Sketches({}, {})
    finite = [F.when(F.isnan(x), F.lit(math.inf)).otherwise(x) for x in values]
    flat = df.select(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("__part"), *[y.alias(str(k)) for k, y in enumerate(finite)])
    each = range(len(values))
    parts = flat.groupBy("__part").agg(*[e for k in each for e in (F.count(f"`{k}`").alias(f"n{k}"), F.kll_sketch_agg_double(f"`{k}`", SKETCH).alias(f"s{k}"))])
    row = parts.agg(*[e for k in each for e in (F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}"), F.kll_merge_agg_double(f"s{k}", SKETCH).alias(f"s{k}"))]).first()
    return Sketches({c: row[f"n{k}"] for k, c in enumerate(columns)}, {c: bytes(row[f"s{k}"]) for k, c in enumerate(columns)})


def exact_quantiles(df: DataFrame, columns: Mapping[str, Column], shares: Sequence[float], held: Sketches | None = None) -> dict[str, list[float] | None]:
    """The quantiles of each column, as F.percentile gives them: interpolated between neighbours. None without values.

    Sketches bracket each wanted rank: they are made by one read of df, or given, if those of the same rows are held. Two
    more count the values below and at both ends of each bracket, and write the few between them, which are then ranked;
    frequent values are ends. A bracket that missed its rank is opened to all values, by reads of its own."""
    names, values = list(columns), [c.cast("double") for c in columns.values()]
    held = sketches(df, columns) if held is None else held
    rows = [held.rows[c] for c in names]
    places = {(k, j): (rows[k] - 1) * s for k in range(len(names)) if rows[k] for j, s in enumerate(shares)}
    if not places:
        return dict.fromkeys(names)
    marks = [v for s in shares for v in (max(0.0, s - 2 * SKETCH_ERROR), min(1.0, s + 2 * SKETCH_ERROR))]
    filled = [k for k in range(len(names)) if rows[k]]
    about = dict(zip(filled, held.near(df.sparkSession, [names[k] for k in filled], marks)))
    nan = float("nan")  # no value is greater
    brackets = {(k, j): (about[k][2 * j], nan if about[k][2 * j + 1] == math.inf else about[k][2 * j + 1]) for k, j in places}
    ends = {key: (math.floor(p), math.ceil(p)) for key, p in places.items()}
    near, counts = _inside(df, values, brackets)
    missed = {key: (-math.inf, nan) for key, (a, b) in ends.items() if not counts[key][0] <= a <= b < counts[key][3]}
    if missed:
        again, opened = _inside(df, values, missed)
        near = near.where(~F.struct("k", "j").isin(*[F.struct(F.lit(k), F.lit(j)) for k, j in missed])).unionByName(again)
        counts, brackets = counts | opened, brackets | missed
    at, wanted = {}, {}
    for key, pair in ends.items():
        below, low, high, _ = counts[key]
        for p in pair:
            if p < low or p >= high:
                at[*key, p] = brackets[key][0 if p < low else 1]
            else:
                wanted.setdefault(key, set()).add(p - low)
    if wanted:
        grouped = near.groupBy("k", "j", "x").agg(F.count(F.lit(1)).alias("n"))
        if max(counts[key][2] - counts[key][1] for key in wanted) <= RANKED:
            order = Window.partitionBy("k", "j").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ranked = grouped.withColumn("upto", F.sum("n").over(order))
        else:
            ranked = running_totals(in_ranges(grouped, F.col("x")), F.col("range"), [F.col("x")], {"upto": F.col("n")}, ["k", "j"])
        small = df.sparkSession.createDataFrame([(*key, sorted(p)) for key, p in wanted.items()], "k int, j int, at array<long>")
        own = F.filter("at", lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("n")))
        met = ranked.join(F.broadcast(small), ["k", "j"])  # a row for each column and share
        at |= {(r.k, r.j, r.p + counts[r.k, r.j][1]): r.x for r in met.select("k", "j", "x", F.explode(own).alias("p")).collect()}  # two for each

    def value(k: int, j: int) -> float:
        low, high = ends[k, j]
        a, b = at[k, j, low], at[k, j, high]
        return a if low == high or a == b else (high - places[k, j]) * a + (places[k, j] - low) * b

    return {c: [value(k, j) for j in range(len(shares))] if rows[k] else None for k, c in enumerate(names)}


def _inside(df: DataFrame, values: Sequence[Column], brackets: Mapping[tuple[int, int], tuple[float, float]]) -> tuple[DataFrame, dict[tuple[int, int], tuple[int, ...]]]:
    """The values between the ends of each bracket, as written rows of k, j and x; and how many values lie below its low end,
    up to that, below its high end, and up to that. A read for the rows and one for the counts: an Observation would save
    the second, but its manager stays in the session, and models that hold their session can't be sent to tasks any more."""
    x = {k: F.col(f"`{k}`") for k in range(len(values))}
    tests = {key: (x[key[0]] < F.lit(low), x[key[0]] <= F.lit(low), x[key[0]] < F.lit(high), x[key[0]] <= F.lit(high)) for key, (low, high) in brackets.items()}
    counts = [F.count_if(t).alias(f"{k}_{j}_{i}") for (k, j), found in tests.items() for i, t in enumerate(found)]
    between = {(k, j): (x[k] > F.lit(brackets[k, j][0])) & t[2] for (k, j), t in tests.items()}
    some = [F.when(c, F.struct(F.lit(k).alias("k"), F.lit(j).alias("j"), x[k].alias("x"))) for (k, j), c in between.items()]
    flat = df.select(*[c.alias(str(k)) for k, c in enumerate(values)])
    met = flat.where(reduce(lambda a, b: a | b, between.values()))
    near = materialise(met.select(F.explode(F.array_compact(F.array(*some))).alias("p")).select("p.*"))
    found = flat.agg(*counts).first()
    return near, {(k, j): tuple(found[f"{k}_{j}_{i}"] for i in range(4)) for k, j in brackets}


def grouped_medians(df: DataFrame, buckets: int = 128) -> DataFrame:
    """(key, median) of the columns key and x, without nulls. A key of many rows is ranked in many tasks."""
    counted = materialise(df.where("key is not null and x is not null").groupBy("key", "x").agg(F.count(F.lit(1)).alias("n")))
    edges = counted.agg(_edges(buckets))
    met = counted.crossJoin(F.broadcast(edges)).select("key", "x", "n", _bucket().alias("b"))  # a single row
    ranked = running_totals(met, F.col("b"), [F.col("x")], {"upto": F.col("n")}, ["key"])
    rows = counted.groupBy("key").agg(F.sum("n").alias("rows"))
    at = lambda p: F.max(F.when((p < F.col("upto")) & (p >= F.col("upto") - F.col("n")), F.col("x")))
    half = (F.col("rows") - 1) * 0.5
    found = ranked.join(rows, "key").groupBy("key").agg(at(F.floor(half)).alias("a"), at(F.ceil(half)).alias("b"))
    return found.select("key", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(0.5 * F.col("a") + 0.5 * F.col("b")).alias("median"))
