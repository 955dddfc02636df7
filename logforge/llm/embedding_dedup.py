"""Embedding near-duplicates by an epsilon grid order join (Böhm et al. 2001).

Vectors are scaled to length one, so a least cosine is a largest distance epsilon, and projected on leading principal
dimensions, where distances only shrink. They are sorted by their grid cells of width epsilon on those dimensions and
cut into intervals of the sequence. Two intervals are joined by halving the larger again and again; halves whose
bounds lie further apart than epsilon are skipped, and what is left is compared in full by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logforge.llm.common import connected_components, hot_keys, materialise, read_table, spread_join

#: Bytes of an interval of the sequence, at 8 for each component, and rows of the pieces at which halving ends.
INTERVAL_BYTES, LEAF = 2 << 20, 128
#: Intervals on either side of a tile of pairs, which a task holds.
TILE = 4
#: Principal dimensions; vectors that the rotation is fitted on, which no result depends on.
DIMENSIONS, ROTATION_SAMPLE = 8, 4096
_SLACK = 1e-6  # what rounding may take from a distance


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _rotation(classes: DataFrame, size: int, dimensions: int, sample: int) -> np.ndarray:
    """Leading principal dimensions of a bounded sample (by hash) of the vectors of one size."""
    rows = classes.where(F.col("size") == size).select("vector").orderBy("key", "low").limit(sample).collect()
    units = _unit(np.array([r[0] for r in rows], dtype=float))
    _, axes = np.linalg.eigh(np.cov(units, rowvar=False, bias=True).reshape(size, size))
    return axes[:, ::-1][:, : min(dimensions, size)]


def _projector(axes: dict[int, np.ndarray], epsilon: float, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for size, part in rows.groupby("size"):
                vectors = np.stack(part["vector"].to_numpy()).astype(kind)
                cells = np.floor(_unit(vectors.astype(float)) @ axes[size] / epsilon).astype("int32")
                padded = np.zeros((len(part), DIMENSIONS), dtype="int32")
                padded[:, : min(DIMENSIONS, cells.shape[1])] = cells[:, :DIMENSIONS]
                yield part[["label", "size", "low", "key", "copies"]].assign(raw=[v.tobytes() for v in vectors], cells=list(padded))

    return run


def _packed(values: pd.Series) -> list[bytes]:
    return [values.to_numpy().astype("<i8").tobytes()]


def _intervals(axes: dict[int, np.ndarray], epsilon: float, length: int | None, kind: str):
    """Cuts the sorted rows of a partition into intervals of one label and vector size."""

    def made(rows: pd.DataFrame, number: int) -> pd.DataFrame:
        size = int(rows["size"].iloc[0])
        raw = b"".join(rows["raw"])
        places = _unit(np.frombuffer(raw, kind).reshape(-1, size).astype(float)) @ axes[size]
        low, high = places.min(axis=0), places.max(axis=0)
        cells = [[int(np.floor(v / epsilon)) for v in (*bounds[:2], 0.0)[:2]] for bounds in (low - _SLACK, high + _SLACK)]
        return pd.DataFrame({
            "label": rows["label"].iloc[:1].to_numpy(), "size": [size], "interval": [(TaskContext.get().partitionId() << 32) + number],
            "low": [low], "high": [high], "from_cells": [cells[0]], "to_cells": [cells[1]],
            "ids": _packed(rows["low"]), "keys": _packed(rows["key"]), "copies": _packed(rows["copies"]), "raw": [raw]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, number = None, 0
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            rest = None
            group = rows[["label", "size"]].to_numpy()
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
            for a, b in zip(cuts, cuts[1:]):
                most = (length or max(1, INTERVAL_BYTES // (8 * int(rows["size"].iloc[a])))) if a < b else 1
                while b - a >= most:
                    yield made(rows.iloc[a : a + most], number)
                    a, number = a + most, number + 1
                if a < b and b < len(rows):
                    yield made(rows.iloc[a:b], number)
                    number += 1
                elif a < b:
                    rest = rows.iloc[a:b]
        if rest is not None:
            yield made(rest, number)

    return run


class _Side:
    """One interval: unit vectors, ids, keys and copies, and the places that bounds are taken of."""

    def __init__(self, axes: np.ndarray, size: int, kind: str, ids: bytes, keys: bytes, copies: bytes, raw: bytes):
        self.units = _unit(np.frombuffer(raw, kind).reshape(-1, size).astype(float))
        self.ids, self.keys, self.copies = (np.frombuffer(x, "<i8") for x in (ids, keys, copies))
        self.places = self.units @ axes
        self.links = np.zeros(len(self.ids), dtype="int64")


def _apart(s: _Side, a: int, b: int, t: _Side, c: int, d: int, epsilon: float) -> bool:
    """Whether bounds prove that no vector of s[a:b] is within epsilon of one of t[c:d]."""
    x, y = s.places[a:b], t.places[c:d]
    gap = np.maximum(0.0, np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)))
    return float(gap @ gap) > (epsilon + _SLACK) ** 2


def _ego_join(s: _Side, t: _Side, least: float, epsilon: float, leaf: int) -> list[tuple[int, int]]:
    """Adds to the sides' links, and gives links that connect what all of them connect."""
    edges: list[tuple[int, int]] = []
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def join(a: int, b: int, c: int, d: int) -> None:
        own = s is t and a == c
        if not own and _apart(s, a, b, t, c, d, epsilon):
            return
        if b - a > leaf or d - c > leaf:
            if own:
                m = (a + b) // 2
                join(a, m, a, m), join(a, m, m, b), join(m, b, m, b)
            elif b - a >= d - c:
                m = (a + b) // 2
                join(a, m, c, d), join(m, b, c, d)
            else:
                m = (c + d) // 2
                join(a, b, c, m), join(a, b, m, d)
            return
        near = s.units[a:b] @ t.units[c:d].T >= least
        if own:
            near &= ~np.eye(b - a, dtype=bool)
        s.links[a:b] += near @ t.copies[c:d]
        if not own:
            t.links[c:d] += s.copies[a:b] @ near
        for i, j in np.argwhere(near).tolist():
            p, q = int(s.ids[a + i]), int(t.ids[c + j])
            x, y = root(p), root(q)
            if x != y:
                parent[max(x, y)] = min(x, y)
                edges.append((p, q))

    join(0, len(s.ids), 0, len(t.ids))
    return edges


_HELD = ("ids", "keys", "copies", "raw")
_FOUND = "a long, k long, b long, n long"


def _compare(axes: dict[int, np.ndarray], least: float, epsilon: float, leaf: int, kind: str):
    """Links of a tile's pairs of intervals: rows (a, k, null, n) count the links of the class of smallest id a and key k,
    rows (a, null, b, 0) connect ids."""

    def run(intervals: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        sides = {r.interval: _Side(axes[r.size], r.size, kind, *(getattr(r, c) for c in _HELD)) for r in intervals.itertuples(index=False)}
        edges = []
        for p, q in zip(pairs["interval_a"], pairs["interval_b"]):
            edges += _ego_join(sides[p], sides[q], least, epsilon, leaf)
        some = [(x, x.links > 0) for x in sides.values()]
        parts = [pd.DataFrame({"a": x.ids[m], "k": x.keys[m], "n": x.links[m]}) for x, m in some if m.any()]
        out = pd.concat([*[part.assign(b=None) for part in parts], pd.DataFrame(edges, columns=["a", "b"]).assign(k=None, n=0)], ignore_index=True)
        return out[["a", "k", "b", "n"]].astype({"a": "int64", "k": "Int64", "b": "Int64", "n": "int64"})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    least_cosine: float = 0.93, interval: int | None = None, leaf: int = LEAF, dimensions: int = DIMENSIONS) -> DataFrame:
    """For each row of vectors: the id, n_links (other rows linked directly), component_id (smallest id that links
    reach) and kept (the id is its component's).

    Rows link if their labels are equal and their cosine, in double precision, is at least `least_cosine`. Null, empty
    and zero vectors, vectors with null or non-finite components, and rows with a null label or id link with nothing:
    n_links 0, component_id their own id, kept true. Vectors of different sizes don't link. Equal vectors are one node
    that counts its copies, so a large group of copies costs one comparison. Rows that share an id are one node of the
    components, while each counts its own vector's links. An empty table gives an empty table. interval: rows of an
    interval, by default as many as INTERVAL_BYTES hold.
    """
    dimensions = min(dimensions, DIMENSIONS)
    epsilon = float(np.sqrt(2 - 2 * least_cosine))
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    vector = F.col(vector_col) if kind == "<f4" else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    alone = rows.where(~fit).select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.where(fit)
    classes = materialise(rows.groupBy("label", "vector").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies")).withColumns(
        {"size": F.size("vector"), "key": F.xxhash64("label", "vector")}))
    sizes = [r[0] for r in classes.select("size").distinct().collect()]  # vectors of one column: one size, or few
    if not sizes:
        return alone
    axes = {n: _rotation(classes, n, dimensions, ROTATION_SAMPLE) for n in sizes}

    label = dict(vectors.dtypes)[label_col]
    placed = classes.mapInPandas(_projector(axes, epsilon, kind), f"label {label}, size int, low long, key long, copies long, raw binary, cells array<int>")
    order = ["label", "size", *[F.col("cells")[k] for k in range(DIMENSIONS)], "low", "key"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("cells")
    intervals = materialise(placed.mapInPandas(
        _intervals(axes, epsilon, interval, kind),
        f"label {label}, size int, interval long, low array<double>, high array<double>, from_cells array<int>, to_cells array<int>, "
        "ids binary, keys binary, copies binary, raw binary"))

    # pairs of intervals whose bounds are within epsilon; each pair is found in one cell of the first two dimensions
    def cells(side: str, more: int) -> DataFrame:
        out = intervals.select("label", "size", *[F.col(c).alias(f"{c}_{side}") for c in ("interval", "low", "high", "from_cells", "to_cells")])
        for k in (0, 1):
            out = out.withColumn(f"cell{k}", F.explode(F.sequence(F.col(f"from_cells_{side}")[k] - more, F.col(f"to_cells_{side}")[k] + more)))
        return out.drop(f"to_cells_{side}")

    keys = ["label", "size", "cell0", "cell1"]
    left, right = cells("a", 0), cells("b", 1)
    many = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    below = F.zip_with("low_a", "high_b", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    above = F.zip_with("low_b", "high_a", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    gap = F.aggregate(F.zip_with(below, above, lambda x, y: F.greatest(x, y)), F.lit(0.0), lambda t, x: t + x * x)
    here = [F.col(f"cell{k}") == F.greatest(F.col("from_cells_a")[k], F.col("from_cells_b")[k] - 1) for k in (0, 1)]
    met = spread_join(left, right, keys, hot_keys(many, keys, left.count()), ["interval_a"])
    met = met.where((F.col("interval_a") < F.col("interval_b")) & here[0] & here[1] & (gap <= (epsilon + _SLACK) ** 2))
    # pairs are dealt to tiles of a grid; an interval travels once to each tile of its row and column, and once to meet itself
    tile = lambda c: F.floor(F.col(c) / TILE).cast("long")
    pairs = met.select(tile("interval_a").alias("row"), tile("interval_b").alias("column"), "interval_a", "interval_b")
    own = intervals.select((-F.col("interval") - 1).alias("row"), F.col("interval").alias("column"), F.col("interval").alias("interval_a"), F.col("interval").alias("interval_b"))
    pairs = materialise(pairs.unionByName(own))
    asked = pairs.select(F.col("row").alias("to_row"), F.col("column").alias("to_column"), F.explode(F.array("interval_a", "interval_b")).alias("interval")).distinct()
    sent = asked.join(intervals.select("interval", "size", *_HELD), "interval")
    compare = _compare(axes, least_cosine, epsilon, leaf, kind)
    found = materialise(sent.groupBy("to_row", "to_column").cogroup(pairs.groupBy("row", "column")).applyInPandas(compare, _FOUND))

    counts = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("low"), F.col("k").alias("key")).agg(F.sum("n").alias("n"))
    components = connected_components(found.where(F.col("b").isNotNull()).select("a", "b"))
    named = classes.join(counts, ["low", "key"], "left").join(components.withColumnRenamed("node", "low"), "low", "left")
    named = named.select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "low").alias("component_id"))
    copies = classes.select("label", "vector", F.col("copies").alias("n"))
    out = spread_join(rows, named, ["label", "vector"], hot_keys(copies, ["label", "vector"], rows.count()), ["id"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id",
                      (F.col("id") == F.col("component_id")).alias("kept")).unionByName(alone)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op3_sql() -> str:
    """The same in DuckDB by comparing all pairs of a label; components by their repeated least neighbour."""
    return """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::double[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
        reach AS (
            SELECT vec_id AS a, vec_id AS b FROM v
            UNION
            SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT vec_id, coalesce(n, 0)::bigint AS n_links, coalesce(c, vec_id) AS component_id, coalesce(vec_id = c, true) AS kept
        FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
        LEFT JOIN (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY a) USING (vec_id)"""
