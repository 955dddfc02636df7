"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's 64 bits are dealt to random vectors of radius + 1 bits; every non-zero vector v of as many bits gives a
mask: the bits whose own vector has an odd scalar product with v. For two fingerprints that differ in at most `radius`
places some mask avoids all those places (Pagh 2016), so they collide in that mask's table: no pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logforge.llm.common import connected_components, hot_keys, materialise, read_table, release, spread_join

#: Rows of a bucket that are compared in one task; larger buckets are cut into pairs of blocks of about this size.
BLOCK = 1024
_TABLES_SEED = 20160117


def fingerprint(text: str | None, words: int = 4) -> int:
    """The fingerprint of a whole text, as an unsigned 64-bit integer: bit b is set if over half of the shingles' XXH64
    values have it set. Texts of fewer words have one shingle; texts of none (or null) have fingerprint zero."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):  # a long text's bits are never held all at once
        block = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(counts * 2 > n).tolist())


def with_fingerprints(docs: DataFrame, text_col: str = "text", words: int = 4) -> DataFrame:
    """docs with fp, the fingerprint's bits as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        release()
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn("fp", fp(F.col(text_col)))


def covering_masks(radius: int) -> list[int]:
    """The masks of all tables, as signed longs."""
    rng = np.random.default_rng(_TABLES_SEED)
    own = rng.integers(0, 1 << (radius + 1), 64).tolist()
    masks = [sum(1 << i for i, o in enumerate(own) if (o & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _forest(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of the links between values, those that a spanning forest needs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            yield x, y


def _links(radius: int):
    """For rows that are sorted by group: links within radius, as a spanning forest of each group. In a group of two
    blocks only links between the blocks are sought; other groups have one block."""

    def near(fps: np.ndarray, side: np.ndarray, two: bool) -> tuple[np.ndarray, np.ndarray]:
        left, right = (fps[side == 0], fps[side == 1]) if two else (fps, fps)
        found_a, found_b = [], []
        for at in range(0, len(left), 256):
            close = np.bitwise_count(left[at : at + 256, None] ^ right[None, :]) <= radius
            i, j = np.nonzero(close)
            keep = slice(None) if two else (i + at < j)
            found_a.append(left[at + i[keep]])
            found_b.append(right[j[keep]])
        return np.concatenate(found_a), np.concatenate(found_b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rows[["table", "bucket", "block_a", "block_b"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            last = cuts[-1] if len(cuts) else 0
            rest = rows.iloc[last:]  # a group that may go on; at most two blocks
            if last:
                yield found(rows.iloc[:last], cuts[:-1])
        if rest is not None and len(rest):
            keys = rest[["table", "bucket", "block_a", "block_b"]].to_numpy()
            yield found(rest, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)

    def found(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        fps, side = rows["fp"].to_numpy().view(np.uint64), rows["side"].to_numpy()
        two = (rows["block_a"] != rows["block_b"]).to_numpy()
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(rows)]))
        out: list[tuple[int, int]] = []
        # pairs, by far the most groups, all at once
        pair = starts[(ends - starts == 2) & ~two[starts]]
        close = np.bitwise_count(fps[pair] ^ fps[pair + 1]) <= radius
        signed = fps.view(np.int64)
        out += zip(signed[pair[close]].tolist(), signed[pair[close] + 1].tolist())
        for a, b in zip(starts.tolist(), ends.tolist()):
            if b - a > 2 or (b - a == 2 and two[a]):
                x, y = near(fps[a:b], side[a:b], bool(two[a]))
                out += _forest(x.view(np.int64), y.view(np.int64))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def link_fingerprints(distinct: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column fp that differ in at most `radius` bits: enough of them
    to connect what all of them connect.

    Buckets are counted first, with partial sums. Buckets of one go; those of over `block` rows are dealt into blocks by
    a hash, and every pair of blocks becomes a group of its own, so no task holds more than two blocks of a bucket and
    all of its pairs are still compared.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius)])
    rows = distinct.select("fp", F.posexplode(masks).alias("table", "mask")).select(
        F.col("table").cast("short").alias("table"), F.col("mask").bitwiseAND(F.col("fp")).alias("bucket"), "fp")
    sizes = rows.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # both grow with the rows and are merged; a large bucket's rows are dealt over many tasks
    key = ["table", "bucket"]
    shared = spread_join(rows, sizes, key, hot_keys(sizes, key, len(covering_masks(radius)) * distinct.count()), ["fp"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    shared = shared.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    groups = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("block_a"), F.lit(0).alias("block_b")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
            F.least(k, F.col("own")).alias("block_a"), F.greatest(k, F.col("own")).alias("block_b"))))
    shared = shared.select("table", "bucket", "fp", "own", F.explode(groups).alias("g")).select(
        "table", "bucket", "g.block_a", "g.block_b", (F.col("own") != F.col("g.block_a")).cast("byte").alias("side"), "fp")
    key = ["table", "bucket", "block_a", "block_b"]
    shared = shared.repartition(*key).sortWithinPartitions(*key)
    return shared.mapInPandas(_links(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: the id, fingerprint (16 hexadecimal digits) and component_id, the smallest id that links
    of at most `radius` differing bits reach.

    Documents of one fingerprint are one node, so a group of copies costs no more than a single document; the rows of a
    large group, and the fingerprints of a large component, are dealt over many tasks when they get their labels. Null and
    empty texts have fingerprint zero and link with each other. A null id keeps its row, never becomes a component_id,
    and a component of null ids alone has a null one. Repeated rows each keep their row. Ties don't arise.
    """
    prints = materialise(with_fingerprints(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__lf_text")), "__lf_text", words)
                         .select(id_col, "fp"))
    classes = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("low"), F.count(F.lit(1)).alias("n")))
    labels = connected_components(link_fingerprints(classes.select("fp"), radius))
    named = classes.join(labels.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = spread_join(named.drop("low"), lowest.drop("n"), ["component"], hot_keys(lowest, ["component"], classes.count()), ["fp"])
    found = spread_join(prints, named.select("fp", "component_id"), ["fp"], hot_keys(classes, ["fp"], prints.count()), [id_col])
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: that of the smallest id. Rows without an id stay. Of rows that agree in
    id and text one stays; rows of one id and different texts stay or go together, as an id names one document."""
    groups = near_duplicates(docs, radius, words, id_col, text_col).select(id_col, "component_id")
    kept = groups.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__lf_id")).distinct()
    same = Window.partitionBy("__lf_id", "__lf_text").orderBy("__lf_id")
    named = docs.where(F.col(id_col).isNotNull()).join(kept.hint("merge"), F.col(id_col) == F.col("__lf_id"))
    named = named.withColumn("__lf_text", F.xxhash64(text_col)).withColumn("__lf_row", F.row_number().over(same)).where("__lf_row = 1")
    return named.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(F.col(id_col).isNull()))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
