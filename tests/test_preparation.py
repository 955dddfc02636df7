"""Boundary rows for typing, missing values, quality, samples, codes, bins and scaling."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logforge.functions.ordered import hash_rank, running_totals
from logforge.jobs import pipelines
from logforge.operators import aggregates, encode, features, missing, quality, sampling, scale, typing_rules
from logforge.sources import tables


def test_typing_rules(spark):
    raw = spark.createDataFrame(
        [("1700000000123", "2024-01-02 03:04:05", "7", "true"), ("abc", "soon", None, "x"), (None, None, "a", "0")],
        ["@timestamp", "created_at", "user_id", "actor_is_bot"])
    rows = typing_rules.apply_types(raw).collect()
    assert str(rows[0]["@timestamp"]) == "2023-11-14 22:13:20.123000" and rows[1]["@timestamp"] is None
    assert str(rows[0].created_at) == "2024-01-02 03:04:05" and rows[1].created_at is None
    assert [r.user_id for r in rows] == ["7", None, "a"] and [r.actor_is_bot for r in rows] == [1.0, None, 0.0]


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a.b", "A B", " c"])
    assert typing_rules.standard_name(" C.d ") == "_c_d_"
    with pytest.raises(ValueError, match="a_b"):
        typing_rules.standardise_names(df)
    assert typing_rules.standardise_names(df.drop("A B")).columns == ["a_b", "_c"]


def test_sparse_columns_go_over_half_only(spark):
    df = spark.createDataFrame([(1, 1.0, None, math.nan), (None, 2.0, None, 1.0)], "half int, full double, none string, nan double")
    assert missing.drop_sparse(df).columns == ["half", "full", "nan"]
    assert missing.drop_sparse(df, 0.4).columns == ["full"]


def test_fill(spark):
    df = spark.createDataFrame([(1.0, None, None), (2.0, "a", None), (None, "b", None), (10.0, None, None)], "x double, s string, empty double")
    medians = missing.fit_medians(df)
    assert medians == {"x": 2.0, "empty": 0.0}
    rows = missing.fill(df, medians).collect()
    assert [r.x for r in rows] == [1, 2, 2, 10] and [r.s for r in rows] == ["Unknown", "a", "b", "Unknown"] and rows[0].empty == 0
    assert missing.fit_medians(spark.range(1, 11).select(F.col("id").cast("double").alias("x"))) == {"x": 5.5}


def test_key_columns_match_whole_words(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], "operation_type int, actor_count int, user_id int, outlier_count int, bot int, bot_ratio int")
    assert missing.key_columns(df, exclude=("bot",)) == ["actor_count", "bot_ratio"]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, None)], "k int, v string")
    assert quality.dedupe_rows(df).count() == 3
    assert quality.duplicate_counts(df, "k").first().asDict() == {"n_rows": 5, "duplicate_rows": 2, "repeated_keys": 2}
    same, unique = quality.guarded_key_dedupe(df, "k")
    assert not unique and same.count() == 5
    assert quality.guarded_key_dedupe(df.where("k = 2"), "k")[1]


def test_span_is_elapsed_days(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 23:00:00' AS t UNION ALL SELECT timestamp_ntz'2024-01-03 01:00:00'")
    assert quality.temporal_range(df, "t").first().span_days == 1


def test_empty_hours_count_zero(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 23:30:00' AS t UNION ALL SELECT timestamp_ntz'2024-01-02 02:10:00' UNION ALL SELECT NULL")
    assert [(str(r.bucket)[-8:], r.n) for r in aggregates.hourly_volume(df, "t").orderBy("bucket").collect()] == [("23:00:00", 1), ("00:00:00", 0), ("01:00:00", 0), ("02:00:00", 1)]


def test_corrected_moments_of_a_constant(spark):
    df = spark.createDataFrame([(3.0,)] * 5, "x double")
    row = aggregates.numeric_summary(df).first()
    assert (row.skewness, row.kurtosis) == (0.0, 0.0)


def test_hash_rank_is_a_plain_rank(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("c"))
    for parts in (1, 7):
        rows = hash_rank(df.repartition(parts), "id", 42, ["c"]).collect()
        for c in range(3):
            assert sorted(r["rank"] for r in rows if r.c == c) == list(range(1, sum(r.c == c for r in rows) + 1))
    assert {(r.id, r["rank"]) for r in rows} == {(r.id, r["rank"]) for r in hash_rank(df.repartition(3), "id", 42, ["c"]).collect()}


def test_running_totals_over_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 5)], "k string, o int, v int")
    rows = running_totals(df, F.col("o"), [F.col("o")], {"t": F.col("v")}, ["k"]).collect()
    assert sorted((r.k or "", r.o, r.t) for r in rows) == [("", 1, 2), ("", 2, 5), ("a", 1, 5)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 60), st.integers(0, 40), st.sampled_from([0.2, 0.5, 0.8]))
def test_samples_have_exact_sizes(spark, a, b, share):
    df = spark.range(a + b).select("id", (F.col("id") >= a).cast("int").alias("y")).unionByName(spark.createDataFrame([(-1, None)], "id long, y int"))
    want = {0: round(a * share), 1: round(b * share)}
    got = sampling.stratified_sample(df, "y", "id", share).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got} == {k: v for k, v in want.items() if v}
    split = sampling.train_test_split(df, "y", "id").collect()
    assert sorted(r.id for r in split) == list(range(a + b))
    folds = sampling.folds(df, "y", "id", 3).collect()
    for y, n in ((0, a), (1, b)):
        sizes = [sum(r.y == y and r.fold == k for r in folds) for k in range(3)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_day_parts(spark):
    df = spark.createDataFrame([(h,) for h in (0, 6, 7, 12, 13, 18, 19, 23, 24)], "h int")
    out = [r[0] for r in df.select(encode.bin_right_closed(F.col("h"), *encode.DAY_PARTS)).collect()]
    assert out == ["Night", "Night", "Morning", "Morning", "Afternoon", "Afternoon", "Evening", "Evening", None]


def test_collapsed_quantiles_are_skipped(spark):
    df = spark.createDataFrame([(v,) for v in (1, 1, 1, 1, 2, 3)], "x int")
    same, made = encode.quantile_bin(df, "x", ("a", "b", "c", "d"), "bin")
    assert not made and same.columns == ["x"]
    out, made = encode.quantile_bin(spark.range(1, 9).toDF("x"), "x", ("a", "b"), "bin")
    assert made and [r.bin for r in out.orderBy("x").collect()] == ["a"] * 4 + ["b"] * 4


def test_binarise_reaches(spark):
    df = spark.createDataFrame([(4.0,), (5.0,), (6.0,), (None,)], "x double")
    assert [r[0] for r in df.select(encode.binarise(F.col("x"), 5)).collect()] == [0, 1, 1, None]


def test_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("é",), ("b",)], "s string")
    codes = encode.apply_codes(df, encode.fit_codes(df, ["s"]), ["s"]).collect()
    wide = encode.apply_wide_codes(df, encode.fit_wide_codes(df, "s"), "s").collect()
    assert {(r.s, r.s_code) for r in codes} == {(r.s, r.s_code) for r in wide} == {("a", 0), ("b", 1), ("é", 2), (None, None)}


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (4.0, 5.0)], "x double, c double")
    params = scale.fit_standard(df, ["x", "c"])
    assert set(params) == {"x"}
    values = [r.x_scaled for r in scale.apply_scale(df, params).collect()]
    assert abs(sum(values)) < 1e-9 and abs(sum(v * v for v in values) / 4 - 1) < 1e-9
    assert scale.fit_robust(df, ["x"])["x"] == (2.5, 1.5)
    assert [r.x_log for r in scale.log1p(spark.createDataFrame([(-1.0,), (0.0,)], "x double"), ["x"]).collect()] == [0, 0]


def test_actor_features(spark):
    df = spark.sql("""SELECT * FROM VALUES ('a', timestamp_ntz'2024-01-01 01:00:00', 1), ('a', timestamp_ntz'2024-01-01 02:00:00', 0),
        ('a', timestamp_ntz'2024-01-02 02:00:00', 0), (NULL, timestamp_ntz'2024-01-06 02:00:00', 1) AS t(actor, ts, y)""")
    rows = features.time_features(features.attach_actor(df, features.actor_table(df, "actor", "ts", "y"), "actor"), "ts").orderBy("ts").collect()
    assert (rows[0].actor_event_count, rows[0].actor_active_days, rows[0].actor_event_velocity) == (3, 2, 1.5)
    assert rows[3].actor_event_count is None and rows[3].is_weekend == 1 and rows[0].event_dayofweek == 0
    assert features.actor_table(df, "actor", "ts", granularity="timestamp").first().actor_active_days == 3


def test_csv_keeps_quotes_and_line_ends(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "hi"\nthere'), (None, "x")], "a string, b string")
    tables.write_csv(df, str(tmp_path / "t"))
    assert {tuple(r) for r in tables.read_raw_csv(spark, str(tmp_path / "t")).collect()} == {tuple(r) for r in df.collect()}


def test_large_csv_without_line_feeds_is_split(spark, tmp_path):
    df = spark.range(20_000).selectExpr("cast(id as string) as a", "concat('x, \"', id % 7, '\"') as b").coalesce(1)
    tables.write_csv(df, str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    spark.conf.set("spark.sql.files.minPartitionNum", "4")
    try:
        whole, split = (tables.read_raw_csv(spark, str(tmp_path / "t"), df.columns, line_feeds=t) for t in (True, False))
        assert whole.rdd.getNumPartitions() == 1 < split.rdd.getNumPartitions()
        assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect())) == sorted(map(tuple, df.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_missing_file_is_none(spark, tmp_path):
    assert tables.load_raw_csv(spark, f"{tmp_path}/none.csv") is None and pipelines.read_log(spark, f"{tmp_path}/none.csv") is None
    (tmp_path / "some.csv").write_text('a.b,A B\n1,"x ""y"""\n')
    assert tables.load_raw_csv(spark, f"{tmp_path}/some.csv").collect() == [("1", 'x "y"')]
    with pytest.raises(ValueError, match="a_b"):
        pipelines.read_log(spark, f"{tmp_path}/some.csv")


def test_load_prepared(spark):
    rows = [(1, "b", "p", 2.0, 0.5, 1), (2, "a", None, None, 0.5, 0), (3, "b", "q", 4.0, 0.5, None), (4, None, "q", 6.0, 0.1, 1)]
    df = spark.createDataFrame(rows, "id long, kind string, name string, x double, actor_bot_ratio double, label int")
    out, names = pipelines.load_prepared(df, "label", "id")
    assert names == ["x", "kind_code", "name_code"]
    got = {r.id: (r.features.toArray().tolist(), r.label) for r in out.collect()}
    # codes are ranks of sorted values; gaps get the median of the labelled rows
    assert got == {1: ([2.0, 1.0, 0.0], 1), 2: ([4.0, 0.0, 0.5], 0), 4: ([6.0, 0.5, 1.0], 1)}


def test_prepare_workload(spark, tmp_path):
    """From a raw CSV file to a table without nulls, doubles and unlabelled rows, and its reports."""
    lines = ["Event ID,ts,actor,action,value,sparse,label"]
    for i in range(240):
        ts = "soon" if i == 5 else f"2024-01-{1 + i % 28:02d} {i % 24:02d}:00:00"
        value = "" if i % 9 == 0 else "900" if i == 7 else str(20 + i % 13)
        lines.append(f"{i},{ts},{'' if i % 11 == 0 else 'u' + str(i % 6)},{'rare' if i == 3 else 'ab'[i % 2]},{value},{i if i % 4 == 0 else ''},{'' if i % 17 == 0 else int(i % 5 == 0)}")
    lines += lines[11:14]  # repeated rows
    path = tmp_path / "log.csv"
    path.write_text("\n".join(lines) + "\n")
    rules = typing_rules.TypingRules(datetimes=("ts",), identifiers=("Event ID", "actor"), categories=("action",), booleans=("value", "sparse", "label"))
    log = pipelines.read_log(spark, str(path), rules)
    done = pipelines.prepare(log, pipelines.LogColumns("event_id", "ts", "actor", "action", "label"))
    rows = done.table.toPandas()
    labelled = [i for i in range(240) if i % 17]
    counts = {v: sum(int(i % 5 == 0) == v for i in labelled) for v in (0, 1)}
    assert len(rows) == sum(round(0.8 * n) for n in counts.values()) and rows.event_id.is_unique
    assert "sparse" not in rows.columns and {"action_code", "value", "event_hour", "actor_event_count", "is_outlier", "label"} <= set(rows.columns)
    reports = {n: df.collect() for n, df in done.reports.items()}
    assert set(reports) == {"quality", "duplicates", "actors", "actions", "hours", "summary", "correlation", "bins", "subsets", "selected", "classes", "components", "severity", "outliers", "nulls"}
    assert reports["duplicates"][0].duplicate_rows == sum(i % 17 != 0 for i in (10, 11, 12))
    assert sum(r.n for r in reports["severity"]) == len(rows)
    subsets = {r.subset: r.n for r in reports["subsets"]}
    assert set(subsets) == {"bot_events", "human_events", "weekend_events", "high_activity"} and subsets["bot_events"] == rows.label.sum()
    assert subsets["weekend_events"] == (rows.is_weekend == 1).sum() and subsets["high_activity"] == (rows.actor_event_count >= rows.actor_event_count.quantile(0.75)).sum()
    scores, chosen = done.tables["components"].toPandas(), done.tables["selected"].toPandas()
    assert len(scores) == len(chosen) == len(rows) and list(scores.columns) == ["id", "label", *[f"PC_{r.component}" for r in reports["components"]]]
    spread = scores[[c for c in scores if c.startswith("PC_")]].var().to_numpy()  # a component's variance is its share of the whole
    share = [r.variance for r in reports["components"]]
    assert all(abs(spread[k] / spread[0] - share[k] / share[0]) < 1e-6 for k in range(len(share)))
    assert list(chosen.columns) == ["event_id", *[r.feature for r in reports["selected"]], "label"]
    assert {r["column"] for r in reports["nulls"]} <= {"event_hour", "event_dayofweek", "event_month", "event_year", "is_weekend"}
    classes = {r.label: r.asDict() for r in reports["classes"]}
    assert classes[1]["smote"] == classes[0]["smote"] == classes[0]["original"] > classes[1]["original"]
    if 7 in set(rows.event_id.astype(int)):
        assert rows.set_index(rows.event_id.astype(int)).loc[7, "is_outlier"] == 1
