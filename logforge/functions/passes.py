"""Shared passes: many models are fitted side by side, and each pass over the rows adds up what all of them need."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame

#: Rows of a partition at least, so that a small table isn't read in many small tasks.
LEAST_ROWS = 20_000


def blocks(df: DataFrame, rows: int | None = None, least: int = LEAST_ROWS) -> RDD:
    """The rows of df as blocks: dicts of a numpy array for each column (a matrix for a column of arrays of one length, with
    NaN for null). With the number of rows given they are for many passes: kept in memory, made again if lost, and in
    partitions of about `least` rows or more."""
    names = df.columns

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                block = {}
                for name in names:
                    values = batch.column(name)
                    if pa.types.is_list(values.type):
                        block[name] = values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    else:
                        block[name] = values.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    if rows is not None:
        parts, now = max(1, rows // least), df.rdd.getNumPartitions()
        more = min(parts, 2 * df.sparkSession.sparkContext.defaultParallelism)
        df = df.coalesce(parts) if parts < now else df.repartition(more) if more > now else df
    made = df.mapInArrow(packed, "block binary").rdd.map(lambda r: pickle.loads(r[0]))
    return made if rows is None else made.persist()


def _add(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def summed(rows: RDD, f: Callable[[dict, object], tuple[np.ndarray, ...]], state: object, merge: Callable[[tuple, tuple], tuple] = _add) -> tuple[np.ndarray, ...]:
    """The sums over all blocks of what f(block, state) gives, added up in a tree of tasks; with another merge than the
    sum, what that makes of them. The state is broadcast: it holds parameters of models."""
    held = rows.context.broadcast(state)
    total = rows.map(lambda block: f(block, held.value)).treeReduce(merge)
    held.unpersist()
    return total


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers between 0 and 1 from 64-bit keys: the same ones for a key and salt wherever a row is."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
