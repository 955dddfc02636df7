"""DBSCAN for many parameters at once over a grid of small cells: rows meet only where boxes of cells can't decide."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logforge.functions.lineage import materialise
from logforge.functions.skew import hot_keys, lookup, spread_join
from logforge.operators.graph import connected_components
from logforge.operators.knn import block_pairs, cell_pairs, distances, nearest

#: Cells of a block, and those of one block that are compared with another at once.
_BLOCK, _AT_ONCE = 2_048, 256
#: Boxes decide with this share to spare, as distances are rounded.
_SLACK = 1e-9


def _gridded(rows: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """(id, x, cell) of the rows and (cell, n, lo, hi, least) of the cells that have rows: their number, their bounds and their
    smallest id. Rows of a cell are at most half of eps apart."""
    first = rows.select(F.size("x").alias("d")).first()
    side = eps / (2 * math.sqrt(max(1, first.d)))
    if side > 0:
        step = F.transform("x", lambda v: F.floor(v / side))
        # beyond that steps are rounded: such a row has a cell of its own
        wide = F.when(F.array_max(F.transform("x", F.abs)) > side * 2.0**50, F.col("id"))
    else:
        step, wide = F.col("x"), F.lit(None).cast("long")
    keyed = materialise(rows.select("id", "x", F.concat_ws(",", step.cast("array<string>"), wide.cast("string")).alias("key")))
    bound = lambda f: F.array(*[f(F.col("x")[i]) for i in range(first.d)])
    cells = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), bound(F.min).alias("lo"), bound(F.max).alias("hi"), F.min("id").alias("least"))
                        .withColumn("cell", F.monotonically_increasing_id()))
    met = spread_join(keyed, cells.select("key", "cell"), ["key"], hot_keys(cells, ["key"], keyed.count()), ["id"])
    return materialise(met.select("id", "x", "cell")), cells.drop("key")


def _boxes(a: pd.DataFrame, b: pd.DataFrame, far: bool) -> Iterator[tuple[slice, np.ndarray]]:
    """The largest distances that rows of two cells may have (or the least ones), by slices of a."""
    a_lo, a_hi, b_lo, b_hi = (np.stack(v.to_numpy()).astype(float) for v in (a["own_lo"], a["own_hi"], b["other_lo"], b["other_hi"]))
    for at in range(0, len(a_lo), _AT_ONCE):
        part = slice(at, min(len(a_lo), at + _AT_ONCE))
        found = np.zeros((part.stop - at, len(b_lo)))
        for i in range(a_lo.shape[1]):
            up, down = b_hi[:, i] - a_lo[part, i, None], a_hi[part, i, None] - b_lo[:, i]
            found += (np.maximum(up, down) if far else np.maximum(0, np.maximum(-up, -down))) ** 2
        yield part, np.sqrt(found)


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy())


def _links(comp_a: np.ndarray, comp_b: np.ndarray, met: np.ndarray, out: list[pd.DataFrame], m: int) -> None:
    """Adds the pairs of different components of which rows (or cells) meet."""
    i, j = np.nonzero(met & (comp_a[:, None] != comp_b) & (comp_a >= 0)[:, None] & (comp_b >= 0))
    if len(i):
        pairs = np.unique(np.stack([comp_a[i], comp_b[j]], axis=1), axis=0)
        out.append(pd.DataFrame({"m": m, "a": pairs[:, 0], "b": pairs[:, 1]}))


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Pairs that connect what the given ones do, fewer than there are different numbers."""
    nodes, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(pairs.shape).T
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    some = root != np.arange(len(nodes))
    return np.stack([nodes[some], nodes[root[some]]], axis=1)


def _every(out: list[pd.DataFrame]) -> pd.DataFrame:
    """What a task has found, as a forest for each place m."""
    if not out:
        return pd.DataFrame({n: [] for n in ("m", "a", "b")})
    found = []
    for m, part in pd.concat(out).groupby("m"):
        pairs = _forest(part[["a", "b"]].to_numpy())
        found.append(pd.DataFrame({"m": m, "a": pairs[:, 0], "b": pairs[:, 1]}))
    return pd.concat(found)


def _merged(cells: DataFrame, links: DataFrame, size: int) -> DataFrame:
    """cells, whose components (an array: one for each place of `least`) have merged by links (m, a, b)."""
    links = materialise(links)
    if not links.limit(1).count():
        return cells
    joined = connected_components(links.select((F.col("a") * size + F.col("m")).alias("a"), (F.col("b") * size + F.col("m")).alias("b")))
    long = cells.select("cell", F.posexplode("comp").alias("m", "comp")).withColumn("node", F.when(F.col("comp") >= 0, F.col("comp") * size + F.col("m")))
    moved = lookup(long, materialise(joined.withColumnRenamed("node", "__node")), F.col("node"), "__node")
    comp = F.when(F.col("component").isNull(), F.col("comp")).otherwise(F.floor(F.col("component") / size).cast("long"))
    new = moved.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", comp.alias("comp")))), lambda p: p["comp"]).alias("comp"))
    return materialise(cells.drop("comp").join(new, "cell"))


def _asked(cells: DataFrame, size: int) -> DataFrame:
    """The cells that are, for some place of `least`, in another component than that of most cells: of two components that may
    be linked one at least is such a one."""
    large = cells.select(F.posexplode("comp").alias("m", "comp")).where("comp >= 0").groupBy("m", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("m").agg(F.max_by("comp", "n").alias("c"))
    most = {r.m: r.c for r in large.collect()}  # a row for each place
    return cells.where(reduce(lambda a, b: a | b, [(F.col("comp")[m] >= 0) & (F.col("comp")[m] != F.lit(most.get(m, -1))) for m in range(size)]))


def _sure(cells: DataFrame, eps: float, size: int) -> DataFrame:
    """(m, a, b): components of cells all of whose rows are within eps of each other."""

    def local(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(a) and len(b):
            comp_a, comp_b = _matrix(a["own_comp"]), _matrix(b["other_comp"])
            for part, far in _boxes(a, b, True):
                met = far <= eps * (1 - _SLACK)
                for m in range(size):
                    _links(comp_a[part, m], comp_b[:, m], met, out, m)
        return _every(out)

    return block_pairs(_asked(cells, size), cells, _BLOCK, own=("lo", "hi", "comp"), other=("lo", "hi", "comp"))[0].applyInPandas(local, "m int, a long, b long").distinct()


def _open(cells: DataFrame, eps: float, size: int) -> DataFrame:
    """(cell, open): for which places of `least` the cell may have rows within eps of another component's."""

    def local(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"cell": [], "open": pd.Series([], dtype=object)})
        comp_a, comp_b = _matrix(a["own_comp"]), _matrix(b["other_comp"])
        own_open, other_open = np.zeros((len(a), size), bool), np.zeros((len(b), size), bool)
        for part, near in _boxes(a, b, False):
            met = near <= eps * (1 + _SLACK)
            for m in range(size):
                own, other = comp_a[part, m], comp_b[:, m]
                apart = met & (own[:, None] != other) & (own >= 0)[:, None] & (other >= 0)
                own_open[part, m] = apart.any(axis=1)
                other_open[:, m] |= apart.any(axis=0)
        ids, found = np.concatenate((a["own"].to_numpy(), b["other"].to_numpy())), np.concatenate((own_open, other_open))
        some = found.any(axis=1)
        return pd.DataFrame({"cell": ids[some], "open": pd.Series(found[some].tolist(), dtype=object)})

    pairs, _ = block_pairs(_asked(cells, size), cells, _BLOCK, own=("lo", "hi", "comp"), other=("lo", "hi", "comp"))
    return pairs.applyInPandas(local, "cell long, open array<boolean>").groupBy("cell").agg(F.array(*[F.bool_or(F.col("open")[m]) for m in range(size)]).alias("open"))


def _met(rows: DataFrame, cells: DataFrame, eps: float, places: Sequence[int], hot: DataFrame) -> DataFrame | None:
    """(m, a, b): components of which core rows are within eps, sought where boxes leave it open; None if they leave nothing
    open. Of two components one at least is not the largest, so only rows of the others are sought among all. rows: id, x, cell,
    core; places: those in core of this eps, one for each place of `least`."""
    size = len(places)
    left = materialise(cells.join(_open(_boxed(cells), eps, size), "cell"))
    if not left.limit(1).count():
        return None
    large = left.select("n", F.posexplode("comp").alias("m", "comp")).where("comp >= 0").groupBy("m", "comp").agg(F.sum("n").alias("n")).groupBy("m").agg(F.max_by("comp", "n").alias("c"))
    most = {r.m: r.c for r in large.collect()}  # a row for each place
    kept = F.array(*[F.when(F.col("open")[m], F.col("comp")[m]).otherwise(F.lit(-1)) for m in range(size)])
    held = spread_join(rows, left.select("cell", kept.alias("comp")), ["cell"], hot, ["id"])
    own = F.array(*[F.when(F.col("core")[r], F.col("comp")[m]).otherwise(F.lit(-1)) for m, r in enumerate(places)])
    held = materialise(held.select("id", "x", own.alias("comp")).where(F.exists("comp", lambda c: c >= 0)))
    asked = F.array(*[F.when(F.col("comp")[m] == F.lit(most.get(m, -1)), F.lit(-1)).otherwise(F.col("comp")[m]) for m in range(size)])
    queries = materialise(held.withColumn("comp", asked).where(F.exists("comp", lambda c: c >= 0)))

    def local(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(a) and len(b):
            comp_a, comp_b = _matrix(a["own_comp"]), _matrix(b["other_comp"])
            for at, d in distances(_matrix(a["own_x"]).astype(float), _matrix(b["other_x"]).astype(float)):
                met = d <= eps
                for m in range(size):
                    _links(comp_a[at : at + len(d), m], comp_b[:, m], met, out, m)
        return _every(out)

    return cell_pairs(queries, held, radius=eps, own=("comp",), other=("comp",))[0].applyInPandas(local, "m int, a long, b long").distinct()


def _boxed(cells: DataFrame) -> DataFrame:
    """cells as block_pairs() takes them; the bounds are their coordinates."""
    return cells.withColumn("id", F.col("cell")).withColumn("x", F.lit(0))


def _counts(cells: DataFrame, eps: Sequence[float]) -> DataFrame:
    """(cell, sure): for each eps, how many rows are within eps of every row of the cell for sure."""

    def local(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"cell": [], "sure": pd.Series([], dtype=object)})
        found, n = np.zeros((len(a), len(eps))), b["other_n"].to_numpy(dtype=float)
        for part, far in _boxes(a, b, True):
            for k, e in enumerate(eps):
                found[part, k] = (far <= e * (1 - _SLACK)) @ n
        return pd.DataFrame({"cell": a["own"], "sure": pd.Series(found.tolist(), dtype=object)})

    pairs, _ = block_pairs(cells, cells, _BLOCK, own=("lo", "hi"), other=("lo", "hi", "n"))
    return pairs.applyInPandas(local, "cell long, sure array<double>").groupBy("cell").agg(F.array(*[F.sum(F.col("sure")[k]) for k in range(len(eps))]).alias("sure"))


def dbscan_many(df: DataFrame, pairs: Sequence[tuple[float, int]]) -> DataFrame:
    """(run, id, cluster) of DBSCAN for each place `run` of the pairs (eps, least): as dbscan_labels() gives them.

    Rows are gathered in cells at most half of the smallest eps wide. Bounds of cells tell which rows are core rows and which
    cells are linked; only rows whose cells leave it open are compared. Those that may be no core rows are few in each cell, and
    their nearest neighbours decide, and hold all that border rows need. Larger eps go on from the components of smaller ones.
    A row with a coordinate that is not finite is near no other."""
    eps, least = sorted({float(e) for e, _ in pairs}), sorted({m for _, m in pairs})
    every = materialise(df.select("id", F.col("x").cast("array<double>").alias("x")))
    finite = every.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))))
    wanted = F.array(*[F.struct(F.lit(eps.index(float(e)) * len(least) + least.index(m)).alias("place"), F.when(F.lit(m <= 1), F.col("id")).otherwise(F.lit(-1).cast("long")).alias("alone"))
                       for e, m in pairs])
    total = finite.count()
    if not total:
        return every.select("id", F.posexplode(wanted).alias("run", "w")).select("run", "id", F.col("w.alone").alias("cluster"))
    rows, cells = _gridded(finite, eps[0])
    size, most, runs = len(least), max(least), [(k, m) for k in range(len(eps)) for m in range(len(least))]
    cells = materialise(cells.join(_counts(_boxed(cells), eps), "cell"))
    # rows that may be no core rows for some of the pairs: fewer than `most` in a cell
    sure = F.array(*[F.col("sure")[k] >= least[m] for k, m in runs])
    hot = materialise(hot_keys(cells, ["cell"], total))
    queries = materialise(spread_join(rows, cells.where(F.col("sure")[0] < most).select("cell", sure.alias("certain")), ["cell"], hot, ["id"]))
    near = materialise(nearest(queries.select("id", "x"), rows.select("id", "x"), max(1, most - 1), radius=eps[-1]))
    far = near.groupBy(F.col("query").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "distance"))).alias("at"))
    reach = lambda m: F.lit(0.0) if m <= 1 else F.coalesce(F.element_at("at", F.lit(m - 1)), F.lit(math.inf))
    core = F.array(*[F.col("certain")[r] | (reach(least[m]) <= F.lit(eps[k])) for r, (k, m) in enumerate(runs)])
    asked = materialise(queries.join(far, "id", "left").select("id", "cell", core.alias("core")))
    rows = materialise(rows.join(asked.select("id", "core"), "id", "left").withColumn("core", F.coalesce("core", F.array(*[F.lit(True)] * len(runs)))))
    firsts = asked.groupBy("cell").agg(F.array(*[F.min(F.when(F.col("core")[r], F.col("id"))) for r in range(len(runs))]).alias("some"))
    cells = cells.join(firsts, "cell", "left").withColumn("first", F.coalesce("some", F.array(*[F.col("least")] * len(runs)))).drop("some", "least", "sure")
    cells = materialise(cells.withColumn("comp", F.array(*[F.lit(-1).cast("long")] * size)))
    named = []
    for k, e in enumerate(eps):
        # components of a smaller eps stay; cells that have core rows from here on begin as their own
        own = [F.when(F.col("comp")[m] >= 0, F.col("comp")[m]).when(F.col("first")[k * size + m].isNotNull(), F.col("cell")).otherwise(F.lit(-1)) for m in range(size)]
        state = materialise(cells.withColumn("comp", F.array(*own)))
        state = _merged(state, _sure(_boxed(state), e, size), size)
        links = _met(rows, state, e, range(k * size, k * size + size), hot)
        cells = state if links is None else _merged(state, links, size)
        places = F.array(*[F.struct(F.lit(k * size + m).alias("place"), F.col("comp")[m].alias("comp"), F.col("first")[k * size + m].alias("first")) for m in range(size)])
        named.append(cells.select("cell", F.explode(places).alias("s")).select("cell", "s.*").where("first is not null"))
    named = materialise(reduce(DataFrame.unionByName, named))
    first = materialise(named.groupBy("place", "comp").agg(F.min("first").alias("cluster"), F.count(F.lit(1)).alias("n")))
    both = spread_join(named, first.drop("n"), ["place", "comp"], hot_keys(first, ["place", "comp"], named.count()), ["cell"])
    labels = both.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("place", "cluster"))).alias("of"))
    label = F.array(*[F.when(F.col("core")[r], F.element_at("of", F.lit(r))) for r in range(len(runs))])
    inner = materialise(spread_join(rows, materialise(labels), ["cell"], hot, ["id"], "left").select("id", label.alias("cluster")))
    beside = near.join(inner.withColumnRenamed("id", "neighbour"), "neighbour").where(F.exists("cluster", lambda c: c.isNotNull()))
    border = beside.groupBy(F.col("query").alias("id")).agg(F.array(*[F.min(F.when(F.col("distance") <= F.lit(eps[k]), F.col("cluster")[r])) for r, (k, _) in enumerate(runs)]).alias("beside"))
    out = every.select("id").join(inner, "id", "left").join(border, "id", "left").select("id", "cluster", "beside", F.posexplode(wanted).alias("run", "w"))
    return out.select("run", "id", F.coalesce(F.get("cluster", F.col("w.place")), F.get("beside", F.col("w.place")), F.col("w.alone")).alias("cluster"))
