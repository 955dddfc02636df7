"""Zero-filled volume over a stream, in several runs, against the batch counts."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from logforge.streaming import filled, volume


def test_two_runs_with_a_gap_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    start = dt.datetime(2024, 3, 1)
    rows = [(i, start + dt.timedelta(minutes=rng.randint(0, 600)), "hot" if i % 8 else "rare") for i in range(400)]
    rows += [(1000 + i, start + dt.timedelta(hours=30, minutes=rng.randint(0, 300)), "hot") for i in range(200)]  # after 20 empty hours
    early, later = rows[:400], rows[400:]
    early += early[::5] + [(None, start, "hot"), (5000, None, "hot"), (5001, start, None)]  # repeated ids, and rows that lack something
    later += [(9000, start, "hot")]  # far too late
    schema = "event_id long, ts timestamp, kind string"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for part in (early, later):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        volume.run_available(filled.filled_volume(stream, "ts", "event_id", "kind"), str(tmp_path / "out"), str(tmp_path / "cp"))
    parts = spark.read.parquet(str(tmp_path / "out"))
    assert not parts.groupBy("series", "shard", "bucket").count().where("count > 1").count()  # each bucket is closed once
    got = {(r.series, r.bucket): r.n for r in filled.sum_volume(parts.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH"))).collect()}
    n = Counter((kind, ts.replace(minute=0)) for i, ts, kind in rows)
    mark = max(ts for _, ts, _ in rows) - dt.timedelta(hours=1)
    want = {}
    for kind in ("hot", "rare"):
        at = min(b for k, b in n if k == kind)
        while at + dt.timedelta(hours=1) <= mark:
            want[kind, at.strftime("%Y-%m-%d %H")] = n[kind, at]
            at += dt.timedelta(hours=1)
    assert got == want and sum(v == 0 for v in want.values()) > 30
