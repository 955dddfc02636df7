"""Clusterings: k-means, Gaussian mixtures, two-stage Ward and DBSCAN. Tables have id (long) and x (array of double)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logforge.functions.lineage import materialise
from logforge.functions.passes import blocks, summed, uniform
from logforge.functions.skew import lookup
from logforge.operators.cluster_quality import silhouette_by_clusters
from logforge.operators.density import dbscan_many
from logforge.operators.graph import connected_components
from logforge.operators.knn import cell_pairs, distances, nearest, within


#: Rows whose distances to all centres are held at once.
_AT_ONCE = 2_048


def _blocks(df: DataFrame) -> tuple[RDD, int]:
    """Blocks of x, its squared length and a key of the id, and the number of rows."""
    rows = materialise(df.select(F.col("x").cast("array<double>").alias("x"), F.xxhash64("id").alias("key")))
    n = rows.count()
    return blocks(rows, n), n


def _parts(block: dict):
    for at in range(0, len(block["x"]), _AT_ONCE):
        yield block["x"][at : at + _AT_ONCE], block["key"][at : at + _AT_ONCE]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centres."""
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :], 0)


def _drawn(block: dict, state: list) -> tuple[np.ndarray, ...]:
    """For each set of centres the row that a race draws: with chances as the squared distances to the nearest centre."""
    best, rows = np.full(len(state), np.inf), np.zeros((len(state), block["x"].shape[1]))
    for x, key in _parts(block):
        for k, (salt, centres) in enumerate(state):
            far = _distances(x, centres).min(axis=1) if len(centres) else np.ones(len(x))
            race = np.full(len(x), np.inf)
            some = far > 0
            race[some] = -np.log1p(-uniform(key[some], salt)) / far[some]
            first = race.argmin()
            if race[first] < best[k]:
                best[k], rows[k] = race[first], x[first]
    return best, rows


def _first(a: tuple, b: tuple) -> tuple:
    return np.minimum(a[0], b[0]), np.where((a[0] <= b[0])[:, None], a[1], b[1])


def _seeds(rows: RDD, sets: list[tuple[int, int]]) -> list[np.ndarray]:
    """k-means++ seeds for many (k, salt): every pass over the rows draws the next seed of all sets."""
    found = [np.empty((0, 0)) for _ in sets]
    for step in range(max(k for k, _ in sets)):
        wanted = [j for j, (k, _) in enumerate(sets) if k > step]
        race, drawn = summed(rows, _drawn, [(sets[j][1] * 1_009 + step, found[j]) for j in wanted], _first)
        for j, r, row in zip(wanted, race, drawn):
            if np.isfinite(r):  # else there are fewer different rows than that
                found[j] = np.vstack([found[j].reshape(-1, len(row)), row])
    return found


def _moved(block: dict, sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """For each set of centres: rows and their sum by centre, and the inertia."""
    every = np.vstack(sets)
    ends = np.cumsum([len(s) for s in sets])
    n, sums, inertia = np.zeros(len(every)), np.zeros(every.shape), np.zeros(len(sets))
    for x, _ in _parts(block):
        far = _distances(x, every)  # of all sets in one product
        for k, (end, own) in enumerate(zip(ends, sets)):
            part = far[:, end - len(own) : end]
            near = part.argmin(axis=1)
            inertia[k] += part[np.arange(len(x)), near].sum()
            mark = np.zeros((len(own), len(x)))
            mark[near, np.arange(len(x))] = 1
            n[end - len(own) : end] += mark.sum(axis=1)
            sums[end - len(own) : end] += mark @ x
    return n, sums, inertia


def _kmeans(rows: RDD, sets: list[np.ndarray], most: int = 50, near: float = 1e-4) -> tuple[list[np.ndarray], np.ndarray]:
    """Lloyd's iterations of all sets of centres, one pass for each; sets that have settled take no further part. Also the
    inertia of each."""
    sets, inertia, open_ = list(sets), np.zeros(len(sets)), list(range(len(sets)))
    for step in range(most + 1):
        n, sums, costs = summed(rows, _moved, [sets[j] for j in open_])
        ends, left = np.cumsum([len(sets[j]) for j in open_]), []
        for j, end, cost in zip(open_, ends, costs):
            own = slice(end - len(sets[j]), end)
            inertia[j] = cost
            new = np.where(n[own, None] > 0, sums[own] / np.maximum(n[own, None], 1), sets[j])
            if step < most and np.sqrt(((new - sets[j]) ** 2).sum(axis=1)).max() > near:
                sets[j] = new
                left.append(j)
        open_ = left
        if not open_:
            break
    return sets, inertia


def _silhouettes(rows: RDD, sets: list[np.ndarray], groups: list[np.ndarray] | None = None) -> list[float | None]:
    """The mean silhouette of each set's clustering, by squared distances: two passes for all sets. None with one cluster.
    A row is in the cluster of its nearest centre or, with groups, in that centre's group."""
    groups = [np.arange(len(c)) for c in sets] if groups is None else groups
    sizes = [int(g.max()) + 1 for g in groups]

    def totals(block: dict, state: tuple) -> tuple[np.ndarray, ...]:
        n, sums, squares = [], [], []
        for c, g, size in zip(*state):
            mark = np.eye(size)[g[_distances(block["x"], c).argmin(axis=1)]]
            n.append(mark.sum(axis=0))
            sums.append(mark.T @ block["x"])
            squares.append(mark.T @ (block["x"] ** 2).sum(axis=1))
        return np.concatenate(n), np.concatenate(sums), np.concatenate(squares)

    def widths(block: dict, state: tuple) -> tuple[np.ndarray, ...]:
        sets, groups, sizes, n, sums, squares = state
        x, out, at = block["x"], np.zeros(len(sets)), 0
        for k, (c, g, size) in enumerate(zip(sets, groups, sizes)):
            own = slice(at, at + size)
            at += size
            near, each = g[_distances(x, c).argmin(axis=1)], np.arange(len(x))
            whole = n[own] * (x**2).sum(axis=1)[:, None] + squares[own] - 2 * x @ sums[own].T
            mean = np.where(n[own] > 0, whole / np.maximum(n[own], 1), np.inf)
            alone = n[own][near] < 2
            a = whole[each, near] / np.maximum(n[own][near] - 1, 1)
            mean[each, near] = np.inf
            b = mean.min(axis=1)
            top = np.maximum(a, b)
            out[k] = np.where(alone | (top <= 0) | ~np.isfinite(b), 0, (b - a) / np.where(top > 0, top, 1)).sum()
        return (out,)

    n, sums, squares = summed(rows, totals, (sets, groups, sizes))
    found = summed(rows, widths, (sets, groups, sizes, n, sums, squares))[0]
    ends = np.cumsum(sizes)
    used = [(n[e - size : e] > 0).sum() for e, size in zip(ends, sizes)]
    return [float(f / n[: sizes[0]].sum()) if u > 1 else None for f, u in zip(found, used)]


def _assigned(df: DataFrame, f) -> DataFrame:
    """(id, cluster), where f gives the clusters of a matrix of rows."""

    @F.pandas_udf("int")
    def cluster(x: pd.Series) -> pd.Series:
        return pd.Series(f(np.stack(x.to_numpy()).astype(float)) if len(x) else [], dtype="int32")

    return df.select("id", cluster(F.col("x").cast("array<double>")).alias("cluster"))


def kmeans_sweep(df: DataFrame, ks: range = range(2, 11), restarts: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(k, inertia, silhouette) for each k, best of some restarts by inertia; and (id, cluster) of the best silhouette.

    All restarts of all k go together: a pass over the rows draws the next k-means++ seed of each, or moves the centres of
    each. With fewer different rows than k there are fewer clusters."""
    rows, _ = _blocks(df)
    runs = [(k, seed + r) for k in ks for r in range(restarts)]
    sets, inertia = _kmeans(rows, _seeds(rows, runs))
    best = [min((j for j, (own, _) in enumerate(runs) if own == k), key=lambda j: (inertia[j], j)) for k in ks]
    widths = _silhouettes(rows, [sets[j] for j in best])
    rows.unpersist()
    found = [(k, float(inertia[j]), w) for k, j, w in zip(ks, best, widths)]
    chosen = sets[max(zip(best, widths), key=lambda p: -2.0 if p[1] is None else p[1])[0]]
    labels = materialise(_assigned(df, lambda x: _distances(x, chosen).argmin(axis=1)))
    return df.sparkSession.createDataFrame(found, "k int, inertia double, silhouette double"), labels


@dataclass
class Mixture:
    """Weights, means and covariances of Gaussian components."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def logs(self, x: np.ndarray) -> np.ndarray:
        """The log of weight times density, of each row and component."""
        out = np.empty((len(x), len(self.weights)))
        for k, (w, mean, cov) in enumerate(zip(self.weights, self.means, self.covariances)):
            low = np.linalg.cholesky(cov)
            z = np.linalg.solve(low, (x - mean).T)
            out[:, k] = np.log(max(w, 1e-300)) - 0.5 * (z**2).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * len(mean) * np.log(2 * np.pi)
        return out


def _expected(block: dict, state: list) -> tuple[np.ndarray, ...]:
    """For each mixture (or set of centres, at the start): the sums that its components are estimated from, and the log
    likelihood."""
    d = block["x"].shape[1]
    sizes = [len(m) if isinstance(m, np.ndarray) else len(m.weights) for m in state]
    n, sums, products, logs = np.zeros(sum(sizes)), np.zeros((sum(sizes), d)), np.zeros((sum(sizes), d, d)), np.zeros(len(state))
    for x, _ in _parts(block):
        at = 0
        for j, (m, size) in enumerate(zip(state, sizes)):
            if isinstance(m, np.ndarray):
                share = np.zeros((len(x), size))
                share[np.arange(len(x)), _distances(x, m).argmin(axis=1)] = 1
            else:
                log = m.logs(x)
                top = log.max(axis=1)
                total = top + np.log(np.exp(log - top[:, None]).sum(axis=1))
                logs[j] += total.sum()
                share = np.exp(log - total[:, None])
            for k in range(size):
                products[at + k] += (x * share[:, k, None]).T @ x
            n[at : at + size] += share.sum(axis=0)
            sums[at : at + size] += share.T @ x
            at += size
    return n, sums, products, logs


def _mixtures(rows: RDD, n_rows: int, starts: list[np.ndarray], most: int = 100, near: float = 1e-3, ridge: float = 1e-6) -> tuple[list[Mixture], np.ndarray]:
    """Expectation and maximisation of all mixtures from their starting centres, one pass for each round; those whose mean log
    likelihood gains less than `near` take no further part. Also the log likelihood of each."""
    state, logs, open_ = list(starts), np.full(len(starts), -np.inf), list(range(len(starts)))
    for step in range(most + 1):
        n, sums, products, found = summed(rows, _expected, [state[j] for j in open_])
        at, left = 0, []
        for j, log in zip(open_, found):
            size = len(state[j]) if isinstance(state[j], np.ndarray) else len(state[j].weights)
            own, at = slice(at, at + size), at + size
            if step:
                gain, logs[j] = (log - logs[j]) / n_rows, log
                if gain < near or step == most:
                    continue
            count = np.maximum(n[own], 1e-10)[:, None]
            means = sums[own] / count
            covs = products[own] / count[:, :, None] - means[:, :, None] * means[:, None, :] + ridge * np.eye(means.shape[1])
            covs = (covs + covs.transpose(0, 2, 1)) / 2
            state[j] = Mixture(n[own] / n_rows, means, np.stack([_definite(c, ridge) for c in covs]))
            left.append(j)
        open_ = left
        if not open_:
            break
    return state, logs


def _definite(c: np.ndarray, ridge: float) -> np.ndarray:
    """c, with eigenvalues of `ridge` at least: a component of few rows has a flat covariance."""
    values, vectors = np.linalg.eigh(c)
    return c if values[0] >= ridge / 2 else (vectors * np.maximum(values, ridge)) @ vectors.T


def gmm_sweep(df: DataFrame, ks: range = range(2, 9), restarts: int = 3, seed: int = 42, final: int = 5) -> tuple[DataFrame, DataFrame]:
    """(k, log_likelihood, bic) for each k, best of some restarts; and (id, cluster) of the least BIC, best of `final`
    restarts. A restart begins with a k-means clustering. All restarts of all k go together, in the same passes."""
    rows, n = _blocks(df)
    runs = [(k, seed + r) for k in ks for r in range(max(restarts, final))]
    starts, _ = _kmeans(rows, _seeds(rows, runs), most=10)
    d = starts[0].shape[1]
    early = [j for j, (_, s) in enumerate(runs) if s < seed + restarts]
    fitted, logs = _mixtures(rows, n, [starts[j] for j in early])
    found, chosen = [], None
    for k in ks:
        j = max((j for j, e in enumerate(early) if runs[e][0] == k), key=lambda j: (logs[j], -j))
        free = k * d * (d + 1) / 2 + k * d + k - 1
        bic = -2 * logs[j] + free * np.log(n)
        found.append((k, float(logs[j]), float(bic)))
        if chosen is None or bic < chosen[0]:
            chosen = bic, k, logs[j], fitted[j]
    late = [j for j, (k, s) in enumerate(runs) if k == chosen[1] and s >= seed + restarts]
    more, logs = _mixtures(rows, n, [starts[j] for j in late]) if late else ([], [])
    rows.unpersist()
    model = max([(chosen[2], 0, chosen[3]), *[(log, -j - 1, m) for j, (log, m) in enumerate(zip(logs, more))]], key=lambda c: c[:2])[2]
    labels = materialise(_assigned(df, lambda x: model.logs(x).argmax(axis=1)))
    return df.sparkSession.createDataFrame(found, "k int, log_likelihood double, bic double"), labels


def _ward(centres: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
    """Merges weighted points, always the pair that adds least to the within-cluster squares, down to `wanted` groups."""
    c, n = centres.astype(float).copy(), sizes.astype(float).copy()
    group = np.arange(len(c))
    cost = lambda i: ((c[i, None, :] - c[None, :, :]) ** 2).sum(axis=2) * (n[i, None] * n[None, :] / (n[i, None] + n[None, :]))
    d = np.vstack([cost(np.array([i])) for i in range(len(c))])
    np.fill_diagonal(d, np.inf)
    for _ in range(len(c) - wanted):
        keep, gone = sorted(divmod(int(d.argmin()), len(c)))
        c[keep] = (c[keep] * n[keep] + c[gone] * n[gone]) / (n[keep] + n[gone])
        n[keep] += n[gone]
        group[group == gone] = keep
        d[gone], d[:, gone] = np.inf, np.inf
        left = np.isfinite(d[keep])
        d[keep, left] = d[left, keep] = cost(np.array([keep]))[0, left]
    return np.searchsorted(np.unique(group), group)


#: Rows whose summaries are condensed together.
_CONDENSED = 1_024


def _condense(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """At most so many clustering features (rows, their sum, their squared lengths) in place of many. Features that are each
    other's nearest by Ward's cost merge, the cheapest first: merges that Ward's criterion makes too, in some order."""
    while len(n) > most:
        far = _distances(sums / n[:, None], sums / n[:, None]) * (n[:, None] * n[None, :] / (n[:, None] + n[None, :]))
        np.fill_diagonal(far, np.inf)
        near = far.argmin(axis=1)
        i = np.flatnonzero((near[near] == np.arange(len(n))) & (np.arange(len(n)) < near))
        i = i[np.argsort(far[i, near[i]], kind="stable")][: len(n) - most]
        j = near[i]
        keep = np.ones(len(n), bool)
        keep[j] = False
        for v in (n, sums, squares):
            v[i] += v[j]
        n, sums, squares = n[keep], sums[keep], squares[keep]
    return n, sums, squares


def features_of(rows: RDD, most: int) -> tuple[np.ndarray, ...]:
    """At most so many clustering features of all rows, in one scan: each block's are condensed, and those of blocks merge in
    a tree of tasks."""

    def own(block: dict, most: int) -> tuple[np.ndarray, ...]:
        found = None
        for at in range(0, len(block["x"]), _CONDENSED):
            x = block["x"][at : at + _CONDENSED].astype(float)
            part = np.ones(len(x)), x.copy(), (x**2).sum(axis=1)
            found = _condense(*(part if found is None else tuple(np.concatenate(p) for p in zip(found, part))), most)
        return found

    return summed(rows, own, most, lambda a, b: _condense(*(np.concatenate(p) for p in zip(a, b)), most))


def ward_two_stage(df: DataFrame, ks: range = range(2, 7), micro: int = 300, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(k, silhouette), and (id, cluster) of the best. One scan condenses the rows to at most `micro` clustering features,
    which Ward's criterion merges; rows go to the nearest feature. So the merging doesn't grow with the table, and a table
    of no more rows than that is merged exactly."""
    rows, _ = _blocks(df)
    n, sums, _ = features_of(rows, micro)
    centres = sums / n[:, None]
    groups = [_ward(centres, n, min(k, len(n))) for k in ks]
    widths = _silhouettes(rows, [centres] * len(groups), groups)
    rows.unpersist()
    best = groups[max(range(len(groups)), key=lambda j: (-2.0 if widths[j] is None else widths[j], -j))]
    labels = materialise(_assigned(df, lambda x: best[_distances(x, centres).argmin(axis=1)]))
    return df.sparkSession.createDataFrame([(k, w) for k, w in zip(ks, widths)], "k int, silhouette double"), labels


def dbscan_labels(df: DataFrame, edges: DataFrame, eps: float, least: int) -> DataFrame:
    """(id, cluster): the smallest id among the cluster's core rows; -1 for noise. A border row is in the cluster of
    the smallest such id among its core neighbours. edges: as from within(), at least to eps."""
    near = edges.where(F.col("distance") <= eps)
    both = near.select("a", "b").union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    core = df.select("id").join(degree, F.col("id") == F.col("a"), "left").where(F.coalesce("n", F.lit(0)) + 1 >= least).select(F.col("id").alias("core"))
    inner = near.join(core, F.col("a") == F.col("core"), "left_semi").join(core, F.col("b") == F.col("core"), "left_semi")
    joined = connected_components(inner.select("a", "b"))
    cores = core.join(joined, F.col("core") == F.col("node"), "left").select("core", F.coalesce("component", "core").alias("cluster"))
    border = both.join(cores, F.col("b") == F.col("core")).groupBy(F.col("a").alias("row")).agg(F.min("cluster").alias("beside"))
    out = df.select("id").join(cores, F.col("id") == F.col("core"), "left").join(border, F.col("id") == F.col("row"), "left")
    return out.select("id", F.coalesce("cluster", "beside", F.lit(-1).cast("long")).alias("cluster"))


def reach_forest(df: DataFrame, least: Sequence[int], most: float, near: DataFrame | None = None) -> DataFrame:
    """(m, a, b, w): for each place m of `least` a spanning forest of the rows by mutual reachability up to `most`. Rows a
    and b are mutually reachable from the distance on from which they are that near and both have least[m] rows, themselves
    included, as near. Edges of w up to any eps connect the core rows of DBSCAN's clusters for that eps.

    Borůvka's rounds: every component finds its least edge to another one, and they merge. Candidates are compared where
    blocks of rows meet and only the best of each component leaves, so pairs of rows are never listed. near: as from
    nearest(), for max(least) - 1 neighbours."""
    near = near if near is not None else nearest(df, df, max(least) - 1)
    ranks = F.array(*[F.coalesce(F.max(F.when(F.col("rank") == m - 1, F.col("distance"))), F.lit(math.inf)) if m > 1 else F.lit(0.0) for m in least])
    cores = near.groupBy(F.col("query").alias("id")).agg(ranks.alias("core"))
    alone = F.array(*[F.lit(0.0 if m < 2 else math.inf) for m in least])
    rows = materialise(df.select("id", "x").join(cores, "id", "left").withColumns({"core": F.coalesce("core", alone), "key": F.monotonically_increasing_id()}))
    state = rows.withColumn("comp", F.transform("core", lambda c: F.when(c <= most, F.col("key")).otherwise(F.lit(-1))))  # -1: never a core row
    found, schema = [], "m int, comp long, w double, lo long, hi long, beside long"

    def local(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            ids, own = b["other"].to_numpy(), a["own"].to_numpy()
            core_a, core_b, comp_a, comp_b = (np.stack(v.to_numpy()) for v in (a["own_core"], b["other_core"], a["own_comp"], b["other_comp"]))
            order = np.argsort(ids, kind="stable")  # of equal edges that to the smallest id
            ids, core_b, comp_b = ids[order], core_b[order], comp_b[order]
            for at, d in distances(np.stack(a["own_x"].to_numpy()).astype(float), np.stack(b["other_x"].to_numpy()).astype(float)[order]):
                part = slice(at, at + len(d))
                for m in range(core_a.shape[1]):
                    w = np.maximum(np.maximum(d, core_a[part, m][:, None]), core_b[:, m])
                    w[(comp_a[part, m][:, None] == comp_b[:, m]) | (comp_a[part, m][:, None] < 0) | (comp_b[:, m] < 0)] = np.inf
                    j = w.argmin(axis=1)
                    i = np.flatnonzero(w[np.arange(len(d)), j] <= most)
                    j, i_own, other = j[i], own[part][i], ids[j[i]]
                    out.append(pd.DataFrame({"m": m, "comp": comp_a[part, m][i], "w": w[i, j], "lo": np.minimum(i_own, other), "hi": np.maximum(i_own, other), "beside": comp_b[j, m]}))
        if not out:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        every = pd.concat(out).sort_values(["m", "comp", "w", "lo", "hi"])
        return every.drop_duplicates(["m", "comp"])

    while True:
        pairs, _, _ = cell_pairs(state, state, radius=most, own=("core", "comp"), other=("core", "comp"))
        best = pairs.applyInPandas(local, schema).groupBy("m", "comp").agg(F.min(F.struct("w", "lo", "hi", "beside")).alias("e"))
        best = materialise(best.select("m", "comp", "e.*"))
        if not best.limit(1).count():
            break
        found.append(best.select("m", F.col("lo").alias("a"), F.col("hi").alias("b"), "w").distinct())
        size = len(least)
        joined = connected_components(best.select((F.col("comp") * size + F.col("m")).alias("a"), (F.col("beside") * size + F.col("m")).alias("b")))
        long = state.select("id", "x", "core", "key", F.posexplode("comp").alias("m", "comp")).withColumn("node", F.when(F.col("comp") >= 0, F.col("comp") * size + F.col("m")))
        moved = lookup(long, joined.withColumnRenamed("node", "__node"), F.col("node"), "__node")
        comp = F.when(F.col("component").isNull(), F.col("comp")).otherwise(F.floor(F.col("component") / size).cast("long"))
        state = moved.groupBy("id").agg(F.first("x").alias("x"), F.first("core").alias("core"), F.first("key").alias("key"),
                                        F.transform(F.array_sort(F.collect_list(F.struct("m", comp.alias("comp")))), lambda p: p["comp"]).alias("comp"))
        state = materialise(state)
    edges = reduce(DataFrame.unionByName, found) if found else df.sparkSession.createDataFrame([], "m int, a long, b long, w double")
    return edges.select("m", "a", "b", "w")


def dbscan_sweep(df: DataFrame, eps: tuple[float, ...] = (0.3, 0.5, 0.7, 1.0, 1.5), least: tuple[int, ...] = (3, 5, 10),
                 fallback: tuple[float, int] = (0.5, 5)) -> tuple[DataFrame, DataFrame]:
    """(eps, least, n_clusters, noise, silhouette) for each pair of parameters, and (id, cluster) of the best silhouette
    without noise; of `fallback` if there is none. All pairs come from one grid. Any number of clusters is counted and
    judged in the same way; with fewer than two there is no silhouette."""
    rows = materialise(df.select("id", "x"))
    pairs = [(float(e), int(m)) for e in eps for m in least]
    labels = materialise(dbscan_many(rows, [*pairs, (float(fallback[0]), int(fallback[1]))]))
    counts = labels.groupBy("run").agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n"), F.count_if(F.col("cluster") < 0).alias("noise"))
    counts = {r.run: (r.n, r.noise) for r in counts.collect()}  # a row for each pair
    of = lambda run: labels.where(F.col("run") == run).select("id", "cluster")
    judged = [r for r in range(len(pairs)) if counts.get(r, (0, 0))[0] > 1]
    with ThreadPoolExecutor(4) as pool:
        widths = dict(zip(judged, pool.map(lambda r: silhouette_by_clusters(rows.join(of(r), "id"), "id").first()[0], judged)))
    found = [(e, m, *counts.get(r, (0, 0)), widths.get(r)) for r, (e, m) in enumerate(pairs)]
    known = [r for r in judged if widths[r] is not None]
    chosen = max(known, key=lambda r: (widths[r], -r)) if known else len(pairs)
    return df.sparkSession.createDataFrame(found, "eps double, least int, n_clusters long, noise long, silhouette double"), materialise(of(chosen))


def compare(metrics: dict[str, dict[str, float]], df: DataFrame) -> DataFrame:
    """(algorithm, metric, value) of several clusterings."""
    rows = [(a, m, None if v is None else float(v)) for a, own in metrics.items() for m, v in own.items()]
    return df.sparkSession.createDataFrame(rows, "algorithm string, metric string, value double")
