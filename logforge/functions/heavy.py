"""The most frequent values of a column, without a shuffle of all that it holds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that a summary holds at first, by how much it is widened where that proves nothing, and how wide it gets.
HELD, WIDER, WIDEST = 1024, 8, 65_536
#: Tasks that merge the summaries of partitions, before the driver merges theirs.
MERGERS = 64


@dataclass(frozen=True)
class Summary:
    """Misra-Gries counters: for each value held its weight at least, and by how much any value's weight, held or not, may
    be over that. An error of 0 says that these are all values, with their weights."""

    counts: pa.Table
    error: int


def _merge(tables: list[pa.Table], held: int) -> tuple[pa.Table, int]:
    """Counters of value and n added up, and what all of them lost so that no more than `held` stay."""
    plain = [pa.table({"value": t["value"], "n": t["n"]}) for t in tables]  # batches may say that a column has no nulls
    found = pa.concat_tables(plain).group_by("value").aggregate([("n", "sum")]).rename_columns(["value", "n"])
    if found.num_rows <= held:
        return found, 0
    cut = pc.sort_indices(found["n"], sort_keys=[("", "descending")])[held]
    lost = found["n"][cut.as_py()].as_py()
    found = found.set_column(1, "n", pc.subtract(found["n"], lost))
    return found.filter(pc.greater(found["n"], 0)), lost


def summarise(df: DataFrame, value: Column, weight: Column | None = None, held: int = HELD) -> Summary:
    """Misra-Gries summary of a column's values that are not null, by one read of df. weight: of each row, not negative (1
    if none is given; null is 0). Each partition makes its own, MERGERS tasks merge those, and the driver the rest: at
    most MERGERS * (held + 1) rows. The error is at most the whole weight over held + 1."""
    w = F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))
    rows = df.select(value.alias("value"), w.cast("long").alias("n")).where("value is not null")
    schema = rows.withColumn("slot", F.lit(0)).withColumn("error", F.lit(0).cast("long")).schema

    def packed(counts: pa.Table, slot: int, error: int) -> pa.Table:
        n = counts.num_rows
        out = pa.table({"value": counts["value"], "n": counts["n"], "slot": pa.array([slot] * n, pa.int32()), "error": pa.array([0] * n, pa.int64())})
        # a row without a value tells the error
        return pa.concat_tables([out, pa.table({"value": pa.nulls(1, out.schema.field("value").type), "n": pa.array([0]), "slot": pa.array([slot], pa.int32()), "error": pa.array([error])})])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, error = None, 0
        for batch in batches:
            if batch.num_rows:
                kept, lost = _merge([pa.Table.from_batches([batch]), *([kept] if kept is not None else [])], held)
                error += lost
        if kept is not None:
            yield from packed(kept, TaskContext.get().partitionId() % MERGERS, error).to_batches()

    def second(group: pa.Table) -> pa.Table:
        counts, error = _joined(group, held)
        return packed(counts, group["slot"][0].as_py(), error)

    parts = rows.mapInArrow(first, schema).groupBy("slot").applyInArrow(second, schema)
    return Summary(*_joined(parts.toArrow(), held))


def _joined(rows: pa.Table, held: int) -> tuple[pa.Table, int]:
    told = pc.sum(rows["error"]).as_py() or 0
    counts, lost = _merge([rows.filter(pc.is_valid(rows["value"])).select(["value", "n"])], held)
    return counts, told + lost


def top_values(df: DataFrame, value: Column, most: int, weight: Column | None = None) -> DataFrame:
    """(value, n): the `most` values of greatest weight n, ties in the order of value; nulls are no value.

    A summary holds candidates and bounds what any other value can weigh. If its error is 0, it has the answer; if the last
    of the first `most` is sure to weigh more than any value that isn't held, a second read adds up the candidates alone,
    which are broadcast; else a wider summary is made. Where even the widest proves nothing, as weights are too even, all
    values are aggregated."""
    w = F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))
    rows = df.select(value.alias("value"), w.cast("long").alias("n")).where("value is not null")
    held = max(HELD, 2 * most)
    while held <= max(WIDEST, 2 * most):
        found = summarise(rows, F.col("value"), F.col("n"), held)
        if found.error == 0:
            exact = df.sparkSession.createDataFrame(found.counts.cast(pa.schema([found.counts.schema.field("value"), pa.field("n", pa.int64())])), rows.schema)
            return exact.orderBy(F.desc("n"), "value").limit(most)
        least = sorted(found.counts["n"].to_pylist(), reverse=True)[most - 1 : most]
        if least and least[0] > found.error:
            near = found.counts.filter(pc.greater_equal(pc.add(found.counts["n"], found.error), least[0])).select(["value"])
            candidates = df.sparkSession.createDataFrame(near, rows.select("value").schema)
            rows = rows.join(F.broadcast(candidates), "value", "left_semi")  # at most `held` values
            break
        held *= WIDER
    return rows.groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(most)
