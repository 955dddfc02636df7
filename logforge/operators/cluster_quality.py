"""Internal and external quality of a clustering. Rows have an array column of coordinates and a cluster; cluster -1,
or null, is noise and is left out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logforge.functions.lineage import materialise
from logforge.functions.skew import hot_keys, spread_join
from logforge.operators.knn import apart, block_pairs, distances, squares, wide
from logforge.operators.missing import col


def _members(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    x = df.select(col(cluster).cast("long").alias("cluster"), col(vector).cast("array<double>").alias("x"))
    return x.where("cluster is not null and cluster >= 0 and x is not null")


def _long_centroids(rows: DataFrame) -> DataFrame:
    """(cluster, i, mean, n): coordinates of the centroids, by partial sums."""
    return rows.select("cluster", F.posexplode("x").alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def centroids(df: DataFrame, cluster: str = "cluster", vector: str = "x") -> DataFrame:
    """(cluster, centroid, n); as many coordinates in a group as vectors have."""
    found = _long_centroids(_members(df, cluster, vector))
    return found.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda s: s["mean"]).alias("centroid"), F.max("n").alias("n"))


def _square(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def davies_bouldin(df: DataFrame, cluster: str = "cluster", vector: str = "x") -> DataFrame:
    """Mean over clusters of the worst ratio of their spread to the distance of centroids; null for one cluster. Blocks of
    clusters meet, however many clusters there are."""
    rows = _members(df, cluster, vector)
    c = centroids(df, cluster, vector)
    # a large cluster's rows meet copies of its centroid in many tasks
    hot = hot_keys(c, ["cluster"], c.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    spread = spread_join(rows, c, ["cluster"], hot, ["x"]).groupBy("cluster", "centroid").agg(F.avg(F.sqrt(_square(F.col("x"), F.col("centroid")))).alias("s"))
    spread = materialise(spread.select(F.col("cluster").alias("id"), F.col("centroid").alias("x"), "s"))

    def local(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            for at, d in distances(np.stack(a["own_x"].to_numpy()), np.stack(b["other_x"].to_numpy())):
                part = a.iloc[at : at + len(d)]
                other = part["own"].to_numpy()[:, None] != b["other"].to_numpy()[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    r = (part["own_s"].to_numpy()[:, None] + b["other_s"].to_numpy()[None, :]) / d
                out.append(pd.DataFrame({"id": part["own"].to_numpy(), "r": np.where(other, r, -np.inf).max(axis=1)}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "r": []})

    pairs, _ = block_pairs(spread, spread, own=("s",), other=("s",))
    worst = pairs.applyInPandas(local, "id long, r double").groupBy("id").agg(F.max("r").alias("r"))
    return worst.where(F.col("r") >= 0).agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, cluster: str = "cluster", vector: str = "x") -> DataFrame:
    """Between-cluster over within-cluster variance; null for fewer than two clusters."""
    rows = _members(df, cluster, vector)
    long = rows.select("cluster", F.posexplode("x").alias("i", "v")).groupBy("cluster", "i").agg(
        F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    each = long.groupBy("i").agg(
        (F.sum("q") - F.sum(F.col("s") * F.col("s") / F.col("n"))).alias("w"),
        (F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")).alias("b"),
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    k, n = F.max("k"), F.max("n")
    return each.agg(F.when(k > 1, (F.sum("b") / (k - 1)) / (F.sum("w") / (n - k))).alias("calinski_harabasz"))


def silhouette(df: DataFrame, cluster: str = "cluster", vector: str = "x") -> float | None:
    """Mean silhouette under squared Euclidean distance, by Spark ML, which holds the clusters' sums in each task; None for
    fewer than two clusters. Clusters are numbers below 2^53."""
    rows = _members(df, cluster, vector)
    if rows.select("cluster").distinct().limit(2).count() < 2:
        return None
    return ClusteringEvaluator(predictionCol="cluster", featuresCol="v").evaluate(rows.select(F.col("cluster").cast("double").alias("cluster"), array_to_vector("x").alias("v")))


def _mean_silhouette(each: DataFrame) -> DataFrame:
    """each: a row's mean distance to its own cluster (a) and to the nearest other one (b), and size, its cluster's rows."""
    s = F.when(F.col("size") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return each.where("b is not null").agg(F.avg(s).alias("silhouette"))


def silhouette_by_clusters(df: DataFrame, id_col: str, cluster: str = "cluster", vector: str = "x") -> DataFrame:
    """The same from sums alone: each row's mean squared distance to each cluster follows from the cluster's size, sum and
    sum of squared norms. Blocks of rows meet blocks of clusters, however many clusters there are; null for one cluster.
    Clusters are any long numbers, such as ids of rows; ids are unique."""
    rows = df.select(col(id_col).cast("long").alias("id"), col(cluster).cast("long").alias("c"), col(vector).cast("array<double>").alias("x"))
    rows = rows.where("c is not null and c >= 0 and x is not null")
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    sums = centroids(rows, "c", "x").join(rows.groupBy(F.col("c").alias("cluster")).agg(F.sum(norm).alias("sq")), "cluster")
    sums = materialise(sums.select(F.col("cluster").alias("id"), F.col("centroid").alias("x"), "n", "sq"))

    def local(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in ("id", "a", "b", "size")})
        x, m, n = np.stack(a["own_x"].to_numpy()), np.stack(b["other_x"].to_numpy()), b["other_n"].to_numpy(dtype=float)
        total = np.maximum(0.0, n * (x * x).sum(axis=1)[:, None] + b["other_sq"].to_numpy() - 2 * n * (x @ m.T))
        own = a["own_c"].to_numpy()[:, None] == b["other"].to_numpy()[None, :]
        other = np.where(own, np.inf, total / n).min(axis=1)
        mine, at = own.any(axis=1), own.argmax(axis=1)
        size = n[at]
        inner = total[np.arange(len(x)), at] / np.maximum(1, size - 1)
        return pd.DataFrame({"id": a["own"], "a": np.where(mine, inner, np.nan), "b": np.where(np.isfinite(other), other, np.nan), "size": np.where(mine, size, np.nan)})

    pairs, _ = block_pairs(rows, sums, own=("c",), other=("n", "sq"))
    each = pairs.applyInPandas(local, "id long, a double, b double, size double")
    clean = lambda f, c: f(F.when(~F.isnan(c), F.col(c))).alias(c)
    return _mean_silhouette(each.groupBy("id").agg(clean(F.max, "a"), clean(F.min, "b"), clean(F.max, "size")))


def euclidean_silhouette(df: DataFrame, id_col: str, cluster: str = "cluster", vector: str = "x") -> DataFrame:
    """Mean silhouette under Euclidean distance, whose means don't follow from sums: every block of rows meets every
    other once, so the work grows with the square of the table. Blocks grow with it up to a bound, so that less is shuffled. Each pair
    of blocks leaves a row for each row and cluster. Distances are from products of matrices, and from differences where those
    would tell too little of a small one."""
    rows = df.select(col(id_col).cast("long").alias("id"), col(cluster).cast("long").alias("c"), col(vector).cast("array<double>").alias("x"))
    rows = rows.where("c is not null and c >= 0 and x is not null")
    n = rows.count()
    last = max(1, -(-n // wide(n))) - 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(last + 1)).cast("int"))
    left = dealt.select("id", "c", "x", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.lit(last))).alias("j"))
    right = dealt.select("id", "c", "x", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"))

    def local(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in ("id", "own", "cluster", "s", "n")})
        x, y, sides = np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy()), []
        for side, other in ((a, b), (b, a)):
            found, code = np.unique(other["c"].to_numpy(), return_inverse=True)
            member = np.zeros((len(other), len(found)))
            member[np.arange(len(other)), code] = 1
            sides.append((side, found, member, np.zeros((len(side), len(found)))))
        for at, d, wrong in squares(x, y):
            i, j = np.divmod(np.flatnonzero((d < 1e9 * wrong[:, None]).ravel()), d.shape[1])
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            d[i, j] = apart(x, y, at + i, j)
            part = slice(at, at + len(d))
            sides[0][3][part] = d @ sides[0][2]
            sides[1][3][:] += d.T @ sides[1][2][part]
        if a["i"].iloc[0] == a["j"].iloc[0]:
            sides.pop()  # a block that meets itself
        return pd.concat([pd.DataFrame({"id": np.repeat(side["id"].to_numpy(), len(found)), "own": np.repeat(side["c"].to_numpy(), len(found)), "cluster": np.tile(found, len(side)),
                                        "s": s.ravel(), "n": np.tile(member.sum(axis=0), len(side))}) for side, found, member, s in sides])

    pairs = left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))
    sums = pairs.applyInPandas(local, "id long, own long, cluster long, s double, n double").groupBy("id", "own", "cluster").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.col("own") == F.col("cluster")
    return _mean_silhouette(sums.groupBy("id", "own").agg(
        F.max(F.when(own, F.try_divide(F.col("s"), F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"), F.max(F.when(own, F.col("n"))).alias("size")))


def contingency(df: DataFrame, label: str, cluster: str) -> DataFrame:
    return df.where(col(label).isNotNull() & col(cluster).isNotNull()).groupBy(col(label).alias("y"), col(cluster).alias("c")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2.0


def adjusted_rand(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """1 for equal partitions."""
    t = contingency(df, label, cluster)
    i = t.agg(F.sum(_pairs(F.col("n"))).alias("i"), F.sum("n").alias("n"))
    a = t.groupBy("y").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("a"))
    b = t.groupBy("c").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("b"))
    e = F.try_divide(F.col("a") * F.col("b"), _pairs(F.col("n")))
    top, bottom = F.col("i") - e, (F.col("a") + F.col("b")) / 2 - e
    return i.crossJoin(a).crossJoin(b).select(F.when(bottom == 0, 1.0).otherwise(F.try_divide(top, bottom)).alias("ari"))  # single rows


def _entropy(t: DataFrame, key: str, out: str) -> DataFrame:
    n = t.groupBy(key).agg(F.sum("n").cast("double").alias("k"))
    return n.agg((F.log(F.sum("k")) - F.sum(F.col("k") * F.log("k")) / F.sum("k")).alias(out))


def normalised_mutual_information(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """Mutual information over the mean of the entropies; 1 if both are 0."""
    t = contingency(df, label, cluster)
    joint = t.agg((F.log(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("hj"))
    both = joint.crossJoin(_entropy(t, "y", "hy")).crossJoin(_entropy(t, "c", "hc"))  # single rows
    mean = (F.col("hy") + F.col("hc")) / 2
    return both.select(F.when(mean <= 1e-12, 1.0).otherwise(F.greatest(F.lit(0.0), (F.col("hy") + F.col("hc") - F.col("hj")) / mean)).alias("nmi"))


def purity(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """The share of rows that are of their cluster's largest class."""
    t = contingency(df, label, cluster)
    return t.groupBy("c").agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg((F.sum("m") / F.sum("n")).alias("purity"))


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows of each cluster, noise (-1) included, and their share."""
    n = df.groupBy(col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each cluster


def cluster_profile(df: DataFrame, names: list[str], cluster: str = "cluster", most: int = 12) -> DataFrame:
    """(feature, cluster, mean) of the features whose means differ most between clusters."""
    means = df.groupBy(col(cluster).alias("cluster")).agg(*[F.avg(col(c)).alias(c) for c in names])
    long = means.unpivot(["cluster"], names, "feature", "mean")
    top = long.groupBy("feature").agg(F.var_samp("mean").alias("v")).orderBy(F.desc(F.round("v", 12)), "feature").limit(most)
    return long.join(F.broadcast(top.select("feature")), "feature").select("feature", "cluster", "mean")  # at most `most` rows


def array_profile(df: DataFrame, vector: str, cluster: str = "cluster", most: int = 12) -> DataFrame:
    """The same for the coordinates of an array column, which are named by their place."""
    long = _long_centroids(_members(df, cluster, vector)).select(F.concat(F.lit("f"), "i").alias("feature"), "cluster", "mean")
    top = long.groupBy("feature").agg(F.var_samp("mean").alias("v")).orderBy(F.desc(F.round("v", 12)), "feature").limit(most)
    return long.join(F.broadcast(top.select("feature")), "feature")  # at most `most` rows
