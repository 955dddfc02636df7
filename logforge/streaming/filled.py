"""Event volume over a stream, with empty buckets: the streaming twin of the zero-filled hourly volume."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Parts that a series' events are dealt to by a hash of their id, so that one series may be most of the stream.
SHARDS = 4


def filled_volume(stream: DataFrame, ts: str, event_id: str, series: str, seconds: int = 3600, delay: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """(series, shard, bucket, n) of a stream: the events of each bucket of so many seconds, 0 where there are none, from a
    series' first event on. The volume of a bucket is the sum over shards; sum_volume() gives it.

    A bucket is closed, and emitted once, when the watermark passes its end, by a timer where no events come; events that
    are later than that are left out. Repeated event ids within the watermark count once. Rows without a time, id or series
    are left out."""
    rows = stream.where(F.col(ts).isNotNull() & F.col(event_id).isNotNull() & F.col(series).isNotNull()).withWatermark(ts, delay)
    rows = rows.dropDuplicatesWithinWatermark([event_id])
    shard = F.pmod(F.xxhash64(event_id), F.lit(shards)).cast("int")
    rows = rows.select(F.col(series).cast("string").alias("series"), shard.alias("shard"), F.col(ts).alias("ts"))
    width = seconds * 1000

    def counted(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        # the next bucket to close, whether one was closed already, and the counts of open ones
        first, closed, text = state.get if state.exists else (None, False, "{}")
        counts = {int(k): n for k, n in json.loads(text).items()}
        for batch in batches:
            at = batch["ts"].astype("datetime64[ms]").astype("int64") // width * width
            for bucket, n in at.value_counts().items():
                if first is None or not closed or bucket >= first:
                    counts[int(bucket)] = counts.get(int(bucket), 0) + int(n)
        if counts and not closed:
            first = min(counts)
        mark = state.getCurrentWatermarkMs()
        out = []
        while first is not None and first + width <= mark:
            out.append((key[0], key[1], pd.Timestamp(first, unit="ms"), counts.pop(first, 0)))
            first, closed = first + width, True
        if first is not None:
            state.update((first, closed, json.dumps(counts)))
            state.setTimeoutTimestamp(max(first + width, mark + 1))
        yield pd.DataFrame(out, columns=["series", "shard", "bucket", "n"])

    return rows.groupBy("series", "shard").applyInPandasWithState(
        counted, "series string, shard int, bucket timestamp, n long", "first long, closed boolean, counts string", "append", GroupStateTimeout.EventTimeTimeout)


def sum_volume(parts: DataFrame) -> DataFrame:
    """(series, bucket, n) of what a stream wrote so far."""
    return parts.groupBy("series", "bucket").agg(F.sum("n").alias("n"))
