"""Queries over typing, missing values, quality, duplicates, aggregates, samples, features, codes and scaling.

Each entry has the Spark job and, where SQL can express it, DuckDB SQL for the same rows. The test tables have no nulls,
so masks that depend on the id put some in; both sides share the mask's expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logforge.functions.heavy import top_values
from logforge.functions.lineage import scratch_dir
from logforge.operators import aggregates as ag
from logforge.operators import encode, features, missing, quality, sampling, scale, typing_rules
from logforge.sources import tables
from logforge.sources.tables import read_table

MASKED = [
    "event_id", "ts", "CASE WHEN event_id % 7 <> 0 THEN user_id END AS actor", "event_type AS action",
    "CASE WHEN event_id % 20 <> 0 THEN value END AS value", "CASE WHEN event_id % 3 = 0 THEN value END AS sparse",
    "CASE WHEN event_id % 11 <> 0 THEN event_type END AS category",
    "CASE WHEN event_type = 'error' THEN 1 WHEN event_id % 17 = 0 THEN NULL ELSE 0 END AS label",
]
MASKED_SQL = f"(SELECT {', '.join(MASKED)} FROM events)"
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def masked(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").selectExpr(*MASKED)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def repeated(spark: SparkSession, d: str) -> DataFrame:
    """Events, every tenth of them twice."""
    ev = read_table(spark, d, "events")
    return ev.unionByName(ev.where("event_id % 10 = 0"))


REPEATED_SQL = "(SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 10 = 0)"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# typing and missing values

@query("type_events", """
    SELECT CASE WHEN event_id % 13 <> 0 THEN date_trunc('second', ts) END AS "@timestamp",
           CASE WHEN event_id % 19 <> 0 THEN date_trunc('second', ts) END AS created_at,
           event_id::varchar AS event_id, event_type AS action,
           CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 END::double AS enabled
    FROM events""")
def type_events(spark, d):
    ms = "CAST((datediff(to_date(ts), date'1970-01-01') * 86400L + hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 1000 AS string)"
    raw = read_table(spark, d, "events").selectExpr(
        f"CASE WHEN event_id % 13 = 0 THEN 'abc' ELSE {ms} END AS `@timestamp`",
        "CASE WHEN event_id % 19 = 0 THEN 'soon' ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS created_at",
        "CAST(event_id AS string) AS `Event ID`", "event_type AS Action",
        "CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'False' WHEN 2 THEN '1' ELSE 'x' END AS enabled")
    return typing_rules.standardise_names(typing_rules.apply_types(raw))


_MASKED_COLUMNS = ("event_id", "ts", "actor", "action", "value", "sparse", "category", "label")
_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS null_count, count(*) AS n_rows FROM {MASKED_SQL}" for c in _MASKED_COLUMNS)


@query("null_profile", _PROFILE)
def null_profile(spark, d):
    return quality.null_profile(masked(spark, d))


@query("top_null_columns", f"""SELECT "column", null_count, round(100.0 * null_count / n_rows, 2) AS null_pct FROM ({_PROFILE})
    ORDER BY null_count DESC, "column" LIMIT 10""")
def top_null_columns(spark, d):
    return quality.top_null_columns(masked(spark, d))


@query("missing_rate", f"""SELECT sum(null_count)::bigint AS missing_cells, sum(n_rows)::bigint AS cells,
    round(100.0 * sum(null_count) / sum(n_rows), 2) AS missing_pct FROM ({_PROFILE})""")
def missing_rate(spark, d):
    return quality.missing_rate(masked(spark, d))


@query("drop_sparse_fill", f"""
    SELECT event_id::double AS event_id, ts, coalesce(actor, m.a)::double AS actor, action, coalesce(value, m.v) AS value,
           coalesce(category, 'Unknown') AS category, coalesce(label, m.l)::double AS label
    FROM {MASKED_SQL}, (SELECT median(actor) AS a, median(value) AS v, median(label) AS l FROM {MASKED_SQL}) m""")
def drop_sparse_fill(spark, d):
    dense = missing.drop_sparse(masked(spark, d))
    return missing.fill(dense, missing.fit_medians(dense))


@query("fill_mean", f"""SELECT event_id, round(coalesce(value, m.v), 6) AS value FROM {MASKED_SQL}, (SELECT avg(value) AS v FROM {MASKED_SQL}) m""")
def fill_mean(spark, d):
    return rounded(missing.fill_numeric(masked(spark, d).select("event_id", "value"), "mean", ["value"]), "value")


@query("dedupe_rows", "SELECT DISTINCT * FROM events")
def dedupe_rows(spark, d):
    return quality.dedupe_rows(repeated(spark, d))


@query("duplicate_counts", f"""SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {REPEATED_SQL})) AS duplicate_rows,
    count(*) - count(DISTINCT event_id) AS repeated_keys FROM {REPEATED_SQL}""")
def duplicate_counts(spark, d):
    return quality.duplicate_counts(repeated(spark, d), "event_id")


@query("guarded_key_dedupe", f"SELECT * FROM {REPEATED_SQL}")
def guarded_key_dedupe(spark, d):
    return quality.guarded_key_dedupe(repeated(spark, d), "event_id")[0]


# quality

_DESCRIBE = "count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS max"


@query("numeric_describe", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_DESCRIBE.format(c=c)} FROM lineitem" for c in LINE))
def numeric_describe(spark, d):
    return rounded(quality.numeric_describe(read_table(spark, d, "lineitem"), LINE), "mean", "std")


@query("numeric_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {_DESCRIBE.format(c=c)}, count(*) FILTER ({c} IS NULL) AS missing, round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis FROM lineitem" for c in LINE))
def numeric_summary(spark, d):
    return rounded(ag.numeric_summary(read_table(spark, d, "lineitem"), LINE), "mean", "std", "skewness", "kurtosis")


@query("label_completeness", f"""SELECT count(label) AS filled, count(*) - count(label) AS missing, round(100.0 * count(label) / count(*), 2) AS filled_pct FROM {MASKED_SQL}""")
def label_completeness(spark, d):
    return quality.label_completeness(masked(spark, d), "label")


@query("temporal_range", """SELECT min(ts) AS first, max(ts) AS last, floor(epoch(max(ts) - min(ts)) / 86400)::bigint AS span_days FROM events""")
def temporal_range(spark, d):
    return quality.temporal_range(read_table(spark, d, "events"), "ts")


@query("action_cardinality", """SELECT event_type AS value, count(*) AS n, (SELECT count(DISTINCT event_type) FROM events) AS n_distinct
    FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def action_cardinality(spark, d):
    return quality.category_profile(read_table(spark, d, "events"), "event_type")


@query("schema_diff", """
    WITH after AS (SELECT * EXCLUDE (props), hour(ts) AS event_hour, isodow(ts) AS event_dayofweek, month(ts) AS event_month, year(ts) AS event_year, isodow(ts) > 5 AS is_weekend FROM events),
         b AS (SELECT DISTINCT name FROM (UNPIVOT (SELECT any_value(COLUMNS(*)::varchar) FROM events) ON COLUMNS(*) INTO NAME name VALUE v)),
         a AS (SELECT DISTINCT name FROM (UNPIVOT (SELECT any_value(COLUMNS(*)::varchar) FROM after) ON COLUMNS(*) INTO NAME name VALUE v))
    SELECT change, "column", (SELECT count(*) FROM events) AS rows_before, (SELECT count(*) FROM after) AS rows_after FROM (
        SELECT 'added' AS change, name AS "column" FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'dropped', name FROM (FROM b EXCEPT FROM a))""")
def schema_diff(spark, d):
    ev = read_table(spark, d, "events")
    return quality.shape_diff(ev, features.time_features(ev.drop("props"), "ts"))


# aggregates

@query("events_per_actor", f"""SELECT actor, count(ts) AS event_count, sum(label)::bigint AS bot_events, round(avg(label), 6) AS bot_ratio
    FROM {MASKED_SQL} WHERE actor IS NOT NULL GROUP BY actor""")
def events_per_actor(spark, d):
    return rounded(ag.by_actor(masked(spark, d), "actor", "ts", "label").orderBy(F.desc("event_count"), "actor"), "bot_ratio")


@query("top_actors", f"""SELECT actor, count(ts) AS event_count FROM {MASKED_SQL} WHERE actor IS NOT NULL GROUP BY actor ORDER BY 2 DESC, 1 LIMIT 10""")
def top_actors(spark, d):
    return ag.top_actors(masked(spark, d), "actor", "ts")


@query("events_per_action", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def events_per_action(spark, d):
    return ag.counts(read_table(spark, d, "events"), "event_type").orderBy(F.desc("n"), "value")


@query("events_per_org", "SELECT c_mktsegment AS value, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY 1")
def events_per_org(spark, d):
    customer = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    # events are aggregated before they meet their organisations
    n = read_table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("k"))
    return n.join(customer, F.col("user_id") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("value")).agg(F.sum("k").alias("n")).orderBy(F.desc("n"), "value")


@query("hourly_volume_zero_filled", """
    WITH h AS (SELECT date_trunc('hour', ts) AS b, count(*) AS n FROM events WHERE day(ts) <> 5 GROUP BY 1)
    SELECT s.b::timestamp AS bucket, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(min(b), max(b), INTERVAL 1 HOUR)) AS b FROM h) s LEFT JOIN h USING (b)""")
def hourly_volume_zero_filled(spark, d):
    return ag.hourly_volume(read_table(spark, d, "events").where("day(ts) <> 5"), "ts")


@query("class_balance", f"""SELECT label, n, round(100.0 * n / sum(n) OVER (), 2) AS pct, round(max(n) OVER () / min(n) OVER (), 4) AS imbalance
    FROM (SELECT label, count(*) AS n FROM {MASKED_SQL} WHERE label IS NOT NULL GROUP BY label)""")
def class_balance(spark, d):
    return ag.class_balance(masked(spark, d), "label")


@query("grouped_stats", """SELECT o_orderpriority AS key, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median,
    round(stddev_samp(o_totalprice), 4) AS std, count(o_totalprice) AS n FROM orders GROUP BY 1""")
def grouped_stats(spark, d):
    return rounded(ag.grouped_stats(read_table(spark, d, "orders"), "o_orderpriority", "o_totalprice"), "mean", "median", "std", digits=4)


@query("value_counts", f"""SELECT 'action' AS "column", action AS value, count(*) AS n FROM {MASKED_SQL} GROUP BY 2
    UNION ALL SELECT 'category', category, count(*) FROM {MASKED_SQL} GROUP BY 2""")
def value_counts(spark, d):
    return ag.value_counts(masked(spark, d), ["action", "category"])


_PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS)


@query("correlation_pairs", _CORR)
def correlation_pairs(spark, d):
    return rounded(ag.correlation_pairs(read_table(spark, d, "lineitem"), LINE), "r")


@query("top_correlations", f"SELECT * FROM ({_CORR}) ORDER BY abs(r) DESC, a, b LIMIT 3")
def top_correlations(spark, d):
    return rounded(ag.top_correlations(read_table(spark, d, "lineitem"), LINE, 3), "r")


@query("histogram", """
    WITH e AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 20 AS w FROM events),
         n AS (SELECT least(floor((value - lo) / w), 19)::int AS bin, count(*) AS n FROM events, e GROUP BY 1)
    SELECT k::int AS bin, round(lo + k * w, 6) AS low, round(lo + (k + 1) * w, 6) AS high, coalesce(n, 0) AS n
    FROM e, (SELECT unnest(generate_series(0, 19)) AS k) LEFT JOIN n ON k = bin""")
def histogram(spark, d):
    return rounded(ag.histogram(read_table(spark, d, "events"), "value", 20), "low", "high")


@query("box_stats", """
    WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, median(value) AS m, quantile_cont(value, 0.75) AS q3 FROM events),
         f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
    SELECT round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3, min(value) FILTER (value BETWEEN lo AND hi) AS low_whisker,
           max(value) FILTER (value BETWEEN lo AND hi) AS high_whisker, count(*) FILTER (value NOT BETWEEN lo AND hi) AS n_beyond
    FROM events, f GROUP BY q1, m, q3""")
def box_stats(spark, d):
    return rounded(ag.box_stats(read_table(spark, d, "events"), "value"), "q1", "median", "q3")


@query("hour_counts", "SELECT hour(ts)::int AS hour, count(*) AS n FROM events GROUP BY 1")
def hour_counts(spark, d):
    return ag.hour_counts(read_table(spark, d, "events"), "ts")


@query("weekday_counts", "SELECT (isodow(ts) - 1)::int AS weekday, dayname(ts) AS name, count(*) AS n FROM events GROUP BY 1, 2")
def weekday_counts(spark, d):
    return ag.weekday_counts(read_table(spark, d, "events"), "ts")


@query("top_actions", "SELECT p_type AS value, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def top_actions(spark, d):
    part = read_table(spark, d, "part").select("p_partkey", "p_type")
    n = read_table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("k"))
    return top_values(n.join(part, F.col("l_partkey") == F.col("p_partkey")), F.col("p_type"), 15, F.col("k"))


# samples, in the order of a hash of the id

def by_hash(source: str, label: str | None = None, id_col: str = "event_id", seed: int = 42) -> str:
    """The rows of a source with their rank in hash order, within the label's classes, and the class's size."""
    over = f"PARTITION BY {label}" if label else ""
    where = f"WHERE {label} IS NOT NULL" if label else ""
    return f"""(SELECT *, row_number() OVER ({over} ORDER BY md5(concat_ws(':', {id_col}, {seed})), {id_col}) AS place, count(*) OVER ({over}) AS size FROM {source} {where})"""


_SPLIT = f"(SELECT * EXCLUDE (place, size), CASE WHEN place <= round_even(size * 0.2, 0) THEN 'test' ELSE 'train' END AS split FROM {by_hash(MASKED_SQL, 'label')})"


@query("stratified_sample", f"SELECT * EXCLUDE (place, size) FROM {by_hash(MASKED_SQL, 'label')} WHERE place <= round_even(size * 0.8, 0)")
def stratified_sample(spark, d):
    return sampling.stratified_sample(masked(spark, d), "label", "event_id", 0.8)


@query("random_sample", f"SELECT * EXCLUDE (place, size) FROM {by_hash('events')} WHERE place <= 2000")
def random_sample(spark, d):
    return sampling.random_sample(read_table(spark, d, "events"), "event_id", 2000)


@query("capped_sample", f"SELECT * EXCLUDE (place, size) FROM {by_hash(f'(SELECT * FROM {MASKED_SQL} WHERE actor + value + sparse + label IS NOT NULL AND category IS NOT NULL)')} WHERE place <= 1000")
def capped_sample(spark, d):
    return sampling.capped_sample(masked(spark, d), "event_id", 1000)


@query("train_test_split", f"SELECT * FROM {_SPLIT}")
def train_test_split(spark, d):
    return sampling.train_test_split(masked(spark, d), "label", "event_id")


@query("split_sizes", f"""
    WITH c AS (SELECT label, count(*) AS n FROM {MASKED_SQL} WHERE label IS NOT NULL GROUP BY label)
    SELECT label, 'test' AS split, round_even(n * 0.2, 0)::bigint AS n FROM c UNION ALL SELECT label, 'train', n - round_even(n * 0.2, 0)::bigint FROM c""")
def split_sizes(spark, d):
    return train_test_split(spark, d).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query("model_subsample", f"SELECT * EXCLUDE (place, size) FROM {by_hash(f"(SELECT * FROM {_SPLIT} WHERE split = 'train')")} WHERE place <= 2000")
def model_subsample(spark, d):
    return sampling.random_sample(train_test_split(spark, d).where("split = 'train'"), "event_id", 2000)


@query("folds", f"SELECT * EXCLUDE (place, size), ((place - 1) % 5)::int AS fold FROM {by_hash(MASKED_SQL, 'label')}")
def folds(spark, d):
    return sampling.folds(masked(spark, d), "label", "event_id")


@query("fold_sizes", f"""
    WITH c AS (SELECT label, count(*) AS n FROM {MASKED_SQL} WHERE label IS NOT NULL GROUP BY label)
    SELECT label, k::int AS fold, (n // 5 + (k < n % 5)::int)::bigint AS n FROM c, (SELECT unnest(generate_series(0, 4)) AS k)""")
def fold_sizes(spark, d):
    return folds(spark, d).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


# features

FEATURES_SQL = f"""(
    WITH m AS {MASKED_SQL},
    a AS (SELECT actor, count(*) AS n, count(DISTINCT ts::date) AS days, avg(label) AS ratio FROM m WHERE actor IS NOT NULL GROUP BY actor)
    SELECT m.*, hour(ts)::int AS event_hour, (isodow(ts) - 1)::int AS event_dayofweek, month(ts)::int AS event_month, year(ts)::int AS event_year,
           (isodow(ts) >= 6)::int AS is_weekend, n AS actor_event_count, days AS actor_active_days, ratio AS actor_bot_ratio,
           n / days AS actor_event_velocity, (category IS NOT NULL)::int AS is_programmatic, (value IS NOT NULL)::int AS is_integration_event
    FROM m LEFT JOIN a USING (actor))"""


def event_features(spark: SparkSession, d: str) -> DataFrame:
    ev = masked(spark, d)
    out = features.attach_actor(features.time_features(ev, "ts"), features.actor_table(ev, "actor", "ts", "label"), "actor")
    return out.select("*", features.programmatic_flag("category"), features.integration_flag("value"))


@query("actor_features", f"SELECT * EXCLUDE (value, sparse, actor_bot_ratio, actor_event_velocity), round(actor_bot_ratio, 6) AS actor_bot_ratio, round(actor_event_velocity, 6) AS actor_event_velocity FROM {FEATURES_SQL}")
def actor_features(spark, d):
    return rounded(event_features(spark, d).drop("value", "sparse"), "actor_bot_ratio", "actor_event_velocity")


@query("rare_semi_join", """
    WITH r AS (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) < 0.04 * (SELECT count(*) FROM part))
    SELECT p_partkey, p_brand, p_brand IN (SELECT p_brand FROM r) AS is_rare FROM part""")
def rare_semi_join(spark, d):
    part = read_table(spark, d, "part").select("p_partkey", "p_brand")
    n = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("k"))
    rare = n.crossJoin(F.broadcast(part.agg(F.count(F.lit(1)).alias("all")))).where("k < 0.04 * all").select("p_brand")  # a single row
    return features.flag_members(part, "p_brand", rare, "is_rare")


@query("append_union", f"SELECT * FROM {REPEATED_SQL}")
def append_union(spark, d):
    return repeated(spark, d)


@query("drop_flagged", f"SELECT event_id FROM {MASKED_SQL} WHERE NOT coalesce(value > 50, false)")
def drop_flagged(spark, d):
    return features.drop_flagged(masked(spark, d).withColumn("high", F.col("value") > 50), "high").select("event_id")


@query("row_subsets", " UNION ALL ".join(f"SELECT '{k}' AS subset, count(*) AS n FROM {FEATURES_SQL} f WHERE {w}" for k, w in (
    ("bot_events", "label = 1"), ("human_events", "label = 0"), ("weekend_events", "is_weekend = 1"), ("programmatic", "is_programmatic = 1"),
    ("high_activity", f"actor_event_count >= (SELECT quantile_cont(actor_event_count, 0.75) FROM {FEATURES_SQL})"))))
def row_subsets(spark, d):
    return missing.subset_counts(event_features(spark, d), "label")


@query("final_projection", f"SELECT action, actor, event_hour, label FROM {FEATURES_SQL} WHERE label IS NOT NULL")
def final_projection(spark, d):
    return missing.project(event_features(spark, d), ["action", "actor", "no_such_column", "event_hour"], "label").dropna(subset=["label"])


@query("drop_leakage", f"SELECT event_id, actor_event_count FROM {FEATURES_SQL}")
def drop_leakage(spark, d):
    return missing.drop_leakage(event_features(spark, d).select("event_id", "actor_event_count", "actor_bot_ratio"))


@query("drop_constant", f"SELECT event_id, event_hour FROM {FEATURES_SQL}")
def drop_constant(spark, d):
    return missing.drop_constant(event_features(spark, d).select("event_id", "event_hour", "event_year"))


_KEY = ("value", "event_hour", "actor_event_count", "actor_event_velocity")


@query("key_columns", f"""SELECT (row_number() OVER (ORDER BY v DESC, name) - 1)::int AS k, name FROM (
    UNPIVOT (SELECT {', '.join(f'var_samp({c}) AS {c}' for c in _KEY)} FROM {FEATURES_SQL}) ON {', '.join(_KEY)} INTO NAME name VALUE v) QUALIFY k < 3""")
def key_columns(spark, d):
    """The three key columns of largest variance."""
    names = missing.key_columns(event_features(spark, d), exclude=("label", "actor_bot_ratio"), most=3)
    return spark.createDataFrame(list(enumerate(names)), "k int, name string")


# codes and bins

@query("label_encode", f"""
    WITH a AS (SELECT action, dense_rank() OVER (ORDER BY action) - 1 AS code FROM (SELECT DISTINCT action FROM {MASKED_SQL} WHERE action IS NOT NULL)),
         c AS (SELECT category, dense_rank() OVER (ORDER BY category) - 1 AS code FROM (SELECT DISTINCT category FROM {MASKED_SQL} WHERE category IS NOT NULL))
    SELECT event_id, a.code::int AS action_code, c.code::int AS category_code FROM {MASKED_SQL} m LEFT JOIN a USING (action) LEFT JOIN c USING (category)""")
def label_encode(spark, d):
    ev = masked(spark, d)
    narrow, _ = encode.encodable(ev)
    return encode.apply_codes(ev, encode.fit_codes(ev, narrow), narrow).select("event_id", *[f"{c}_code" for c in narrow])


@query("label_encode_all", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name_code FROM customer")
def label_encode_all(spark, d):
    customer = read_table(spark, d, "customer").select("c_custkey", "c_name")
    return encode.apply_wide_codes(customer, encode.fit_wide_codes(customer, "c_name"), "c_name").select("c_custkey", "c_name_code")


@query("bin_quantile", """
    WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS e FROM orders)
    SELECT o_orderkey, CASE WHEN o_totalprice <= e[1] THEN 'low' WHEN o_totalprice <= e[2] THEN 'medium' WHEN o_totalprice <= e[3] THEN 'high' ELSE 'top' END AS price_bin FROM orders, q""")
def bin_quantile(spark, d):
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return encode.quantile_bin(orders, "o_totalprice", ("low", "medium", "high", "top"), "price_bin")[0].select("o_orderkey", "price_bin")


@query("bin_custom", """SELECT event_id, CASE WHEN hour(ts) <= 6 THEN 'Night' WHEN hour(ts) <= 12 THEN 'Morning' WHEN hour(ts) <= 18 THEN 'Afternoon' ELSE 'Evening' END AS day_part FROM events""")
def bin_custom(spark, d):
    return read_table(spark, d, "events").select("event_id", encode.bin_right_closed(F.hour("ts"), *encode.DAY_PARTS).alias("day_part"))


@query("bin_equal_width", """
    WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
    SELECT event_id, CASE WHEN value <= lo + (hi - lo) / 3 THEN 'a' WHEN value <= lo + 2 * ((hi - lo) / 3) THEN 'b' ELSE 'c' END AS width_bin FROM events, e""")
def bin_equal_width(spark, d):
    ev = read_table(spark, d, "events")
    return ev.select("event_id", encode.bin_right_closed(F.col("value"), encode.equal_width_edges(ev, "value", 3), ("a", "b", "c")).alias("width_bin"))


@query("binarise", f"SELECT event_id, (value >= (SELECT median(value) FROM {MASKED_SQL}))::int AS high FROM {MASKED_SQL}")
def binarise(spark, d):
    ev = masked(spark, d)
    return ev.select("event_id", encode.binarise(F.col("value"), missing.fit_medians(ev, ["value"])["value"]).alias("high"))


# scaling

_KEYS = "l_orderkey, l_linenumber"


@query("scale_standard", f"SELECT {_KEYS}, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 6) AS {c}_scaled" for c in LINE) + " FROM lineitem")
def scale_standard(spark, d):
    li = read_table(spark, d, "lineitem")
    return rounded(scale.apply_scale(li, scale.fit_standard(li, LINE)).select("l_orderkey", "l_linenumber", *[f"{c}_scaled" for c in LINE]), *[f"{c}_scaled" for c in LINE])


@query("scale_robust", f"SELECT {_KEYS}, " + ", ".join(f"round(({c} - (SELECT median({c}) FROM lineitem)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem), 6) AS {c}_robust" for c in LINE) + " FROM lineitem")
def scale_robust(spark, d):
    li = read_table(spark, d, "lineitem")
    return rounded(scale.apply_scale(li, scale.fit_robust(li, LINE), "_robust").select("l_orderkey", "l_linenumber", *[f"{c}_robust" for c in LINE]), *[f"{c}_robust" for c in LINE])


@query("log1p_sqrt", "SELECT event_id, round(ln(1 + greatest(value - 50, 0)), 6) AS v_log, round(sqrt(greatest(value - 50, 0)), 6) AS v_sqrt FROM events")
def log1p_sqrt(spark, d):
    ev = read_table(spark, d, "events").selectExpr("event_id", "value - 50 AS v")
    return rounded(scale.square_root(scale.log1p(ev, ["v"]), ["v"]).drop("v"), "v_log", "v_sqrt")


@query("scale_train_apply_test", """
    WITH p AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events WHERE event_id % 5 <> 0)
    SELECT event_id, round((value - m) / s, 6) AS value_scaled FROM events, p WHERE event_id % 5 = 0""")
def scale_train_apply_test(spark, d):
    ev = read_table(spark, d, "events").select("event_id", "value")
    params = scale.fit_standard(ev.where("event_id % 5 <> 0"), ["value"])
    return rounded(scale.apply_scale(ev.where("event_id % 5 = 0"), params).drop("value"), "value_scaled")


# sources and sinks

@query("csv_roundtrip", "SELECT event_id, ts, user_id, event_type, value FROM events")
def csv_roundtrip(spark, d):
    path = f"{scratch_dir(spark)}/logforge-csv-{spark.sparkContext.applicationId}"
    ev = read_table(spark, d, "events").drop("props")
    tables.write_csv(ev.select(*[F.col(c).cast("string").alias(c) for c in ev.columns]), path)
    raw = tables.read_raw_csv(spark, path, ev.columns)
    return raw.select(*[F.col(c).try_cast(t).alias(c) for c, t in ev.dtypes])


@query("report_tables", """SELECT event_type AS value, count(*)::varchar AS n FROM events GROUP BY 1""")
def report_tables(spark, d):
    path = f"{scratch_dir(spark)}/logforge-report-{spark.sparkContext.applicationId}"
    tables.write_report(ag.counts(read_table(spark, d, "events"), "event_type"), path)
    return tables.read_raw_csv(spark, path, ["value", "n"])


@query("feature_table", "SELECT event_id, event_type, value FROM events")
def feature_table(spark, d):
    path = f"{scratch_dir(spark)}/logforge-features-{spark.sparkContext.applicationId}"
    tables.write_features(read_table(spark, d, "events").select("event_id", "event_type", "value"), path, "event_type")
    return spark.read.parquet(path).select("event_id", "event_type", "value")
