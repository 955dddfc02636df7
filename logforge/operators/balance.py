"""Class balancing: synthetic minority rows and class weights. Tables have id (long), x (array of double) and label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logforge.functions.ordered import hash_rank, hashed
from logforge.operators.aggregates import stage_class_counts
from logforge.operators.knn import nearest
from logforge.operators.missing import col, fill_numeric, numeric_columns


#: Bits of a draw.
DRAW_BITS = 52


def _draw(seed: int, part: int, *ids: str) -> Column:
    """A non-negative number of DRAW_BITS that depends on the ids, the seed and which of a row's draws it is."""
    return F.conv(F.substring(hashed(part, *ids, F.lit(seed)), 1, DRAW_BITS // 4), 16, 10).cast("long")


def _classes(df: DataFrame) -> tuple[int | None, int, int]:
    """The smallest class (of equal ones the greatest label), its size, and the size of the largest."""
    sizes = {r.label: r.n for r in df.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each class
    if not sizes:
        return None, 0, 0
    low = min(sizes, key=lambda c: (sizes[c], -c))
    return low, sizes[low], max(sizes.values())


def _between(wanted: DataFrame, rows: DataFrame, near: DataFrame, seed: int) -> DataFrame:
    """A point between each wanted anchor and one of its neighbours; the anchor itself where it has none.
    wanted: n (number of the point), anchor. rows: id, x. near: as from nearest()."""
    some = near.groupBy("query").agg(F.max("rank").alias("k"))
    picked = wanted.join(some, F.col("anchor") == F.col("query"), "left").drop("query")
    picked = picked.withColumn("rank", (F.pmod(_draw(seed, 1, "n", "anchor"), F.coalesce("k", F.lit(1))) + 1).cast("int"))
    picked = picked.join(near.select(F.col("query").alias("anchor"), "rank", "neighbour"), ["anchor", "rank"], "left")
    picked = picked.withColumn("neighbour", F.coalesce("neighbour", "anchor")).withColumn("share", _draw(seed, 2, "n", "anchor") / F.lit(float(1 << DRAW_BITS)))
    met = picked.join(rows.select(F.col("id").alias("anchor"), F.col("x").alias("from")), "anchor").join(
        rows.select(F.col("id").alias("neighbour"), F.col("x").alias("to")), "neighbour")
    point = F.zip_with("from", "to", lambda a, b: a + F.col("share") * (b - a))
    return met.select("n", "anchor", "neighbour", "share", point.alias("x"))


def smote(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(id, x, label, synthetic): the rows, and as many points of the smallest class as the largest has more rows; each
    lies between a row and one of its k nearest of its class. A row is never its own neighbour; a lone row is copied.
    The neighbours are found once for each row; draws are hashes, so any partitioning gives the same points."""
    kept = df.where("label is not null").select("id", "x", "label")
    low, m, most = _classes(kept)
    original = kept.withColumn("synthetic", F.lit(False))
    if low is None or most == m:
        return original
    rows = hash_rank(kept.where(F.col("label") == low), "id", seed, [], "place").select((F.col("place") - 1).alias("id"), "x")
    wanted = df.sparkSession.range(most - m).select(F.col("id").alias("n")).withColumn("anchor", F.pmod(_draw(seed, 0, "n"), F.lit(m)))
    made = _between(wanted, rows, nearest(rows, rows, k), seed)
    return original.unionByName(made.select((-F.col("n") - 1).alias("id"), "x", F.lit(low).cast(dict(df.dtypes)["label"]).alias("label"), F.lit(True).alias("synthetic")))


def _points_each(kept: DataFrame, low: int, m: int, most: int, k: int) -> DataFrame:
    """(anchor, n) of the rows of the smallest class that ADASYN gives points: in proportion to the other classes near them."""
    rows = kept.where(F.col("label") == low).select("id", "x")
    around = nearest(rows, kept.select("id", "x"), k).join(kept.select(F.col("id").alias("neighbour"), "label"), "neighbour")
    r = around.groupBy("query").agg(F.avg((F.col("label") != low).cast("double")).alias("r"))
    r = rows.select("id").join(r, F.col("id") == F.col("query"), "left").select("id", F.coalesce("r", F.lit(0.0)).alias("r"))
    total = r.agg(F.sum("r").alias("all"))
    share = F.when(F.col("all") > 0, F.col("r") / F.col("all")).otherwise(1.0 / m)
    n = r.crossJoin(F.broadcast(total)).select(F.col("id").alias("anchor"), F.bround(share * (most - m)).cast("long").alias("n"))  # a single row
    return n.where("n > 0 and anchor is not null")


def adasyn(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """As smote(), but a row gets points in proportion to the share of other classes among its k nearest of all rows
    (in equal parts if no row has any), rounded half to even, so the total may differ from the gap."""
    kept = df.where("label is not null").select("id", "x", "label")
    low, m, most = _classes(kept)
    original = kept.withColumn("synthetic", F.lit(False))
    if low is None or most == m:
        return original
    rows = kept.where(F.col("label") == low).select("id", "x")
    wanted = _points_each(kept, low, m, most, k).select("anchor", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("n"))
    made = _between(wanted, rows, nearest(rows, rows, k), seed)
    ident = -_draw(seed, 3, "n", "anchor") - 1
    return original.unionByName(made.select(ident.alias("id"), "x", F.lit(low).cast(dict(df.dtypes)["label"]).alias("label"), F.lit(True).alias("synthetic")))


def matrix(df: DataFrame, id_col: str, label: str, names: list[str] | None = None, most: int = 30) -> DataFrame:
    """id, x and label of the first `most` numeric columns, nulls as 0; rows without a label are left out."""
    names = [c for c in numeric_columns(df) if c not in (id_col, label)][:most] if names is None else names
    full = fill_numeric(df.where(col(label).isNotNull()), "zero", names)
    return full.select(col(id_col).cast("long").alias("id"), F.array(*[col(c).cast("double") for c in names]).alias("x"), col(label).cast("int").alias("label"))


def resample_report(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Rows of each class before and after each resampler: the rows of smote() and adasyn(), which are counted without being
    placed. SMOTE fills the gap whatever lies near; ADASYN's points follow from one search of neighbours."""
    kept = df.where("label is not null").select("id", "x", "label")
    low, m, most = _classes(kept)
    own = kept.select("label")
    if low is None or most == m:
        return stage_class_counts({"original": df, "smote": own, "adasyn": own}, "label")
    made = F.lit(low).cast(dict(df.dtypes)["label"]).alias("label")
    drawn = _points_each(kept, low, m, most, k).select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(made)
    return stage_class_counts({"original": df, "smote": own.unionByName(df.sparkSession.range(most - m).select(made)), "adasyn": own.unionByName(drawn)}, "label")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n of all rows over the number of classes times the class's rows."""
    n = df.where(col(label).isNotNull()).groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("classes"))
    return n.crossJoin(F.broadcast(total)).select("label", "n", (F.col("all") / (F.col("classes") * F.col("n"))).alias("weight"))  # a single row
