"""Queries over selection, outliers, classifier measures and cluster quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logforge.jobs.prepare_queries import FEATURES_SQL, LINE, event_features, rounded
from logforge.operators import cluster_quality as cq
from logforge.operators import evaluate as ev
from logforge.operators import outliers as od
from logforge.operators import reduce as dr
from logforge.sources.tables import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# selection and components

@query("variance_filter", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def variance_filter(spark, d):
    li = read_table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", *dr.variance_filter(li, LINE, 1.0))


_F = " UNION ALL ".join(f"""SELECT '{c}' AS feature, (ssb / (k - 1)) / (ssw / (n - k)) AS f FROM (
    SELECT sum(s * s / n) - sum(s) * sum(s) / sum(n) AS ssb, sum(q) - sum(s * s / n) AS ssw, count(*) AS k, sum(n) AS n FROM (
        SELECT count({c}) AS n, sum({c}) AS s, sum({c} * {c}) AS q FROM lineitem GROUP BY l_returnflag))""" for c in LINE)


@query("anova_f_top_k", f"SELECT feature, round(f, 5) AS f FROM ({_F}) ORDER BY f DESC LIMIT 3")
def anova_f_top_k(spark, d):
    return rounded(dr.anova_top(read_table(spark, d, "lineitem"), LINE, "l_returnflag", 3), "f", digits=5)


@query("pca_variance")
def pca_variance(spark, d):
    emb = dr.to_vector(read_table(spark, d, "embeddings"), ["embedding"])
    return dr.Pca(emb, "features", 0.95).explained(emb)


@query("pca_scores")
def pca_scores(spark, d):
    return dr.pca_columns(read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LINE), LINE)[0]


@query("pca_2d")
def pca_2d(spark, d):
    emb = dr.to_vector(read_table(spark, d, "embeddings"), ["embedding"])
    return dr.Pca(emb, "features", 2).transform(emb).select("vec_id", "label", "PC_1", "PC_2")


_PCS = [f"PC_{k + 1}" for k in range(len(LINE))]


@query("bind_scores", f"""SELECT l_orderkey, l_linenumber, {', '.join(LINE)}, round({' + '.join(f'((({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_samp({c}) FROM lineitem)) ** 2)' for c in LINE)}, 6) AS norm FROM lineitem""")
def bind_scores(spark, d):
    """Scores beside the rows they belong to: all components together keep each row's distance from the mean."""
    norm = reduce(lambda a, b: a + b, [F.col(p) * F.col(p) for p in _PCS])
    return pca_scores(spark, d).select("l_orderkey", "l_linenumber", *LINE, F.round(norm, 6).alias("norm"))


@query("pca_axes", f"""WITH z AS (SELECT {', '.join(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}' for c in LINE)} FROM lineitem),
         r AS ({' UNION ALL '.join(f'SELECT covar_samp({a}, {b}) AS r FROM z' for a in LINE for b in LINE)})
    SELECT round(sum(r * r), 6) AS squares, 0.0::double AS apart, {len(LINE)}.0::double AS variance, true AS ordered FROM r""")
def pca_axes(spark, d):
    """What components must have, whatever their signs: no covariance, falling variances whose sum is the number of
    features, and squares that add up to those of the correlations."""
    c = pca_scores(spark, d)
    pairs = [(a, b) for i, a in enumerate(_PCS) for b in _PCS[i + 1 :]]
    row = c.agg(*[F.var_samp(p).alias(p) for p in _PCS], *[F.covar_samp(a, b).alias(f"{a}{b}") for a, b in pairs])
    squares = reduce(lambda a, b: a + b, [F.col(p) * F.col(p) for p in _PCS])
    apart = F.greatest(*[F.abs(f"{a}{b}") for a, b in pairs])
    ordered = reduce(lambda a, b: a & b, [F.col(a) >= F.col(b) for a, b in zip(_PCS, _PCS[1:])])
    return row.select(F.round(squares, 6).alias("squares"), F.abs(F.round(apart, 6)).alias("apart"), F.round(reduce(lambda a, b: a + b, map(F.col, _PCS)), 6).alias("variance"), ordered.alias("ordered"))


# outliers

KEYS = ["value", "actor_event_count"]
_FLAGGED = f"""(
    WITH f AS {FEATURES_SQL},
    p AS (SELECT quantile_cont(value, [0.2, 0.8]) AS v, quantile_cont(actor_event_count, [0.25, 0.75]) AS a, avg(value) AS vm, avg(actor_event_count) AS am,
                 sqrt(var_pop(value) * count(value) / count(*)) AS vs, sqrt(var_pop(actor_event_count) * count(actor_event_count) / count(*)) AS s FROM f),
    q AS (SELECT quantile_cont(value, 0.25) AS v1, quantile_cont(value, 0.75) AS v3, quantile_cont(actor_event_count, 0.25) AS a1, quantile_cont(actor_event_count, 0.75) AS a3 FROM f),
    r AS (SELECT actor, count(*) / (SELECT count(*) FROM f WHERE actor IS NOT NULL) < 0.007 AS rare FROM f WHERE actor IS NOT NULL GROUP BY actor)
    SELECT event_id, coalesce(value < v1 - 0.2 * (v3 - v1) OR value > v3 + 0.2 * (v3 - v1), false) AS outlier_iqr_value,
           coalesce(actor_event_count < a1 - 0.2 * (a3 - a1) OR actor_event_count > a3 + 0.2 * (a3 - a1), false) AS outlier_iqr_actor_event_count,
           coalesce(abs((value - vm) / vs) > 1.5, false) AS outlier_zscore_value, coalesce(abs((actor_event_count - am) / s) > 1.5, false) AS outlier_zscore_actor_event_count,
           coalesce(rare, false) AS outlier_rare_actor
    FROM f LEFT JOIN r USING (actor), p, q)"""
_NAMES = ["outlier_iqr_value", "outlier_iqr_actor_event_count", "outlier_zscore_value", "outlier_zscore_actor_event_count", "outlier_rare_actor"]
_SUM = " + ".join(f"{c}::int" for c in _NAMES)
_SCORED = f"""(SELECT *, {_SUM} AS outlier_score, {" + ".join(f"{c}::int" for c in _NAMES[:4])} AS agreement FROM {_FLAGGED})"""
_JUDGED = f"(SELECT *, agreement >= 2 AS validated, outlier_score > 0 AND agreement < 2 AS false_positive FROM {_SCORED})"


def flagged(spark: SparkSession, d: str) -> DataFrame:
    # widths that the tables' smooth values reach
    df = event_features(spark, d).select("event_id", "actor", *KEYS)
    out = od.zscore_flags(od.iqr_flags(df, KEYS, width=0.2), KEYS, limit=1.5)
    return od.rare_flags(out, "actor", 0.007)


def judged(spark: SparkSession, d: str) -> DataFrame:
    return od.confirm(od.validate(od.with_score(flagged(spark, d))))


@query("iqr_flags", f"SELECT event_id, outlier_iqr_value, outlier_iqr_actor_event_count FROM {_FLAGGED}")
def iqr_flags(spark, d):
    return flagged(spark, d).select("event_id", "outlier_iqr_value", "outlier_iqr_actor_event_count")


@query("zscore_flags", f"SELECT event_id, outlier_zscore_value, outlier_zscore_actor_event_count FROM {_FLAGGED}")
def zscore_flags(spark, d):
    return flagged(spark, d).select("event_id", "outlier_zscore_value", "outlier_zscore_actor_event_count")


@query("rare_flags", f"SELECT event_id, outlier_rare_actor FROM {_FLAGGED}")
def rare_flags(spark, d):
    return flagged(spark, d).select("event_id", "outlier_rare_actor")


@query("outlier_consensus", f"""SELECT event_id, outlier_score, CASE outlier_score WHEN 0 THEN 'normal' WHEN 1 THEN 'mild' WHEN 2 THEN 'strong' ELSE 'extreme' END AS outlier_type,
    agreement, validated, false_positive FROM {_JUDGED}""")
def outlier_consensus(spark, d):
    return judged(spark, d).select("event_id", "outlier_score", "outlier_type", "agreement", "validated", "false_positive")


@query("outlier_methods", f"""SELECT event_id, (outlier_iqr_value OR outlier_iqr_actor_event_count)::int + (outlier_zscore_value OR outlier_zscore_actor_event_count)::int AS agreement FROM {_FLAGGED}""")
def outlier_methods(spark, d):
    return od.validate(od.with_score(flagged(spark, d)), count="methods").select("event_id", "agreement")


@query("outlier_severity", f"""SELECT CASE outlier_score WHEN 0 THEN 'normal' WHEN 1 THEN 'mild' WHEN 2 THEN 'strong' ELSE 'extreme' END AS outlier_type, count(*) AS n FROM {_JUDGED} GROUP BY 1""")
def outlier_severity(spark, d):
    return od.severity_counts(judged(spark, d))


@query("outlier_confirm", f"SELECT event_id, outlier_score / 5 >= 0.5 AS confirmed FROM {_JUDGED}")
def outlier_confirm(spark, d):
    return od.confirm(judged(spark, d), "confidence").select("event_id", "confirmed")


@query("outlier_remove", f"SELECT event_id FROM {_JUDGED} WHERE NOT validated")
def outlier_remove(spark, d):
    return od.remove(judged(spark, d)).select("event_id")


@query("outlier_report", f"""
    WITH r AS (SELECT count(*) FILTER (outlier_score > 0)::double AS a, count(*) FILTER (false_positive)::double AS b, count(*) FILTER (validated)::double AS c,
        count(*) FILTER (validated AND outlier_score > 0)::double AS cs, {", ".join(f"count(*) FILTER (false_positive AND {c})::double AS {c}" for c in _NAMES)} FROM {_JUDGED})
    SELECT 'total_detected' AS metric, a AS value FROM r UNION ALL SELECT 'false_positives', b FROM r UNION ALL SELECT 'true_positives', a - b FROM r
    UNION ALL SELECT 'false_positive_rate', round(100 * b / a, 2) FROM r UNION ALL SELECT 'confirmed_outliers', c FROM r UNION ALL SELECT 'filtered_out', a - cs FROM r
    {" ".join(f"UNION ALL SELECT 'false_by_{c}', {c} FROM r" for c in _NAMES)}""")
def outlier_report(spark, d):
    return od.report(judged(spark, d))


@query("is_outlier", f"SELECT event_id, validated::int AS is_outlier FROM {_JUDGED}")
def is_outlier(spark, d):
    return od.final_flag(judged(spark, d)).select("event_id", "is_outlier")


@query("mahalanobis", """
    WITH p AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_samp(l_quantity) AS a, covar_samp(l_quantity, l_extendedprice) AS b, var_samp(l_extendedprice) AS c FROM lineitem),
         m AS (SELECT l_orderkey, l_linenumber, l_quantity - mx AS x, l_extendedprice - my AS y, a, b, c, a * c - b * b AS det FROM lineitem, p)
    SELECT l_orderkey, l_linenumber, round(sqrt((c * x * x - 2 * b * x * y + a * y * y) / det), 5) AS distance,
           sqrt((c * x * x - 2 * b * x * y + a * y * y) / det) > 2.5 AS outlier_mahalanobis FROM m""")
def mahalanobis(spark, d):
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(od.mahalanobis_flags(li, ["l_quantity", "l_extendedprice"], 2.5, "distance").drop("l_quantity", "l_extendedprice"), "distance", digits=5)


# measures of classifiers: a score that is a function of the row, against the error label

_EVENTS = "(SELECT event_id, (event_type = 'error')::int AS label, least(greatest(floor(value) / 100.0, 0), 1)::double AS score FROM events)"
_PREDICTED = f"(SELECT *, (score >= 0.5)::int AS predicted FROM {_EVENTS})"
_COUNTS = f"(SELECT count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 1 AND predicted = 1) AS tp FROM {_PREDICTED})"
_RUN = f"""(SELECT score, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS pos, sum(q) OVER () AS neg FROM (
    SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM {_EVENTS} GROUP BY score) WINDOW w AS (ORDER BY score DESC))"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    df = read_table(spark, d, "events").select("event_id", (F.col("event_type") == "error").cast("int").alias("label"),
                                               F.least(F.greatest(F.floor("value") / 100.0, F.lit(0.0)), F.lit(1.0)).alias("score"))
    return df.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("confusion", f"SELECT * FROM {_COUNTS}")
def confusion(spark, d):
    return ev.confusion(scored(spark, d))


@query("metrics_report", f"""SELECT *, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision,
    round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM {_COUNTS}""")
def metrics_report(spark, d):
    return ev.metrics(ev.confusion(scored(spark, d)))


@query("class_report", f"""SELECT 1::int AS class, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, tp + fn AS support FROM {_COUNTS}
    UNION ALL SELECT 0, round(tn / (tn + fn), 4), round(tn / (tn + fp), 4), round(2 * tn / (2 * tn + fp + fn), 4), tn + fp FROM {_COUNTS}""")
def class_report(spark, d):
    return ev.class_report(scored(spark, d))


@query("roc_points", f"SELECT score, round(tp / pos, 6) AS tpr, round(fp / neg, 6) AS fpr FROM {_RUN}")
def roc_points(spark, d):
    return rounded(ev.roc_points(scored(spark, d)), "tpr", "fpr")


@query("roc_auc", f"SELECT round(sum(q * (tp + tp - p) / 2.0) / (any_value(pos) * any_value(neg)), 6) AS auc FROM {_RUN}")
def roc_auc(spark, d):
    return rounded(ev.roc_auc(scored(spark, d)), "auc")


@query("pr_points", f"SELECT score, round(tp / pos, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM {_RUN}")
def pr_points(spark, d):
    return rounded(ev.pr_points(scored(spark, d)), "recall", "precision")


@query("average_precision", f"SELECT round(sum(p / pos * tp / (tp + fp)), 6) AS average_precision FROM {_RUN}")
def average_precision(spark, d):
    return rounded(ev.average_precision(scored(spark, d)), "average_precision")


_SWEEP = f"""(SELECT t AS threshold, coalesce(2 * count(*) FILTER (label = 1 AND score >= t) / nullif(count(*) FILTER (score >= t) + count(*) FILTER (label = 1), 0), 0) AS f1
    FROM {_EVENTS}, (SELECT 0.01::double + (0.99::double - 0.01::double) * k / 199 AS t FROM (SELECT unnest(generate_series(0, 199)) AS k)) GROUP BY t)"""


@query("threshold_sweep", f"SELECT round(threshold, 9) AS threshold, round(f1, 6) AS f1 FROM {_SWEEP}")
def threshold_sweep(spark, d):
    return rounded(ev.threshold_sweep(scored(spark, d)).withColumn("threshold", F.round("threshold", 9)), "f1")


@query("best_threshold", f"SELECT round(threshold, 9) AS threshold, round(f1, 6) AS f1 FROM {_SWEEP} ORDER BY f1 DESC, 1 LIMIT 1")
def best_threshold(spark, d):
    return ev.best_threshold(threshold_sweep(spark, d))


# cluster quality: embeddings by their label

_X = "(SELECT vec_id, label AS cluster, label % 4 AS y, unnest(embedding::double[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"
_CENTRES = f"(SELECT cluster, i, avg(v) AS m, count(*) AS n FROM {_X} GROUP BY ALL)"


def clustered(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"), (F.col("label") % 4).alias("y"), F.col("embedding").alias("x"))


_SILHOUETTE = """
    WITH e AS (SELECT vec_id, label AS cluster, embedding::double[] AS x FROM embeddings),
         d AS (SELECT a.vec_id, a.cluster AS own, b.cluster, sum(list_distance(a.x, b.x) ** {power}) AS s, count(*) AS n FROM e a, e b GROUP BY ALL),
         m AS (SELECT vec_id, max(s / nullif(n - 1, 0)) FILTER (own = cluster) AS a, min(s / n) FILTER (own <> cluster) AS b, max(n) FILTER (own = cluster) AS size FROM d GROUP BY vec_id)
    SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM m"""


@query("silhouette", _SILHOUETTE.format(power=2))
def silhouette(spark, d):
    return spark.createDataFrame([(round(cq.silhouette(clustered(spark, d)), 6),)], "silhouette double")


@query("silhouette_by_clusters", _SILHOUETTE.format(power=2))
def silhouette_by_clusters(spark, d):
    return rounded(cq.silhouette_by_clusters(clustered(spark, d), "vec_id"), "silhouette")


@query("silhouette_euclidean", _SILHOUETTE.format(power=1))
def silhouette_euclidean(spark, d):
    return rounded(cq.euclidean_silhouette(clustered(spark, d), "vec_id"), "silhouette")


@query("davies_bouldin", f"""
    WITH c AS {_CENTRES},
         s AS (SELECT cluster, avg(r) AS s FROM (SELECT cluster, vec_id, sqrt(sum((v - m) * (v - m))) AS r FROM {_X} JOIN c USING (cluster, i) GROUP BY ALL) GROUP BY 1),
         p AS (SELECT a.cluster AS a, b.cluster AS b, sqrt(sum((a.m - b.m) ** 2)) AS r FROM c a JOIN c b USING (i) WHERE a.cluster <> b.cluster GROUP BY ALL)
    SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a, max((x.s + y.s) / r) AS r FROM p JOIN s x ON x.cluster = a JOIN s y ON y.cluster = b GROUP BY a)""")
def davies_bouldin(spark, d):
    return rounded(cq.davies_bouldin(clustered(spark, d)), "davies_bouldin")


@query("calinski_harabasz", f"""
    WITH t AS (SELECT *, avg(v) OVER (PARTITION BY i) AS g, avg(v) OVER (PARTITION BY cluster, i) AS m FROM {_X})
    SELECT round((sum((m - g) ** 2) / (count(DISTINCT cluster) - 1)) / (sum((v - m) ** 2) / (count(DISTINCT vec_id) - count(DISTINCT cluster))), 6) AS calinski_harabasz FROM t""")
def calinski_harabasz(spark, d):
    return rounded(cq.calinski_harabasz(clustered(spark, d)), "calinski_harabasz")


_T = "(SELECT label % 4 AS y, label % 3 AS c, count(*) AS n FROM embeddings GROUP BY ALL)"


def two_ways(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select((F.col("label") % 4).alias("y"), (F.col("label") % 3).alias("c"))


@query("ari", f"""
    WITH t AS {_T}, i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) * (sum(n) - 1) / 2 AS n FROM t),
         a AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM t GROUP BY y)), b AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM t GROUP BY c))
    SELECT round((i - a * b / n) / ((a + b) / 2 - a * b / n), 6) AS ari FROM i, a, b""")
def ari(spark, d):
    return rounded(cq.adjusted_rand(two_ways(spark, d), "y", "c"), "ari")


@query("nmi", f"""
    WITH t AS {_T}, j AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS a, sum(n) OVER (PARTITION BY c) / sum(n) OVER () AS b FROM t),
         hy AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT sum(n) / (SELECT sum(n) FROM t) AS p FROM t GROUP BY y)), hc AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT sum(n) / (SELECT sum(n) FROM t) AS p FROM t GROUP BY c))
    SELECT round(sum(p * ln(p / (a * b))) / ((any_value(hy.h) + any_value(hc.h)) / 2), 6) AS nmi FROM j, hy, hc""")
def nmi(spark, d):
    return rounded(cq.normalised_mutual_information(two_ways(spark, d), "y", "c"), "nmi")


@query("purity", f"SELECT round(sum(m) / sum(n), 6) AS purity FROM (SELECT max(n) AS m, sum(n) AS n FROM {_T} GROUP BY c)")
def purity(spark, d):
    return rounded(cq.purity(two_ways(spark, d), "y", "c"), "purity")


@query("cluster_sizes", "SELECT label AS cluster, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM embeddings GROUP BY label")
def cluster_sizes(spark, d):
    return rounded(cq.cluster_sizes(clustered(spark, d)), "share")


@query("cluster_profile", f"""
    WITH c AS (SELECT 'f' || (i - 1) AS feature, cluster, m AS mean FROM {_CENTRES}),
         t AS (SELECT feature FROM c GROUP BY feature ORDER BY round(var_samp(mean), 12) DESC, feature LIMIT 12)
    SELECT feature, cluster, round(mean, 6) AS mean FROM c WHERE feature IN (FROM t)""")
def cluster_profile(spark, d):
    return rounded(cq.array_profile(clustered(spark, d), "x"), "mean")


@query("column_profile", """
    WITH c AS (SELECT l_returnflag AS cluster, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([avg(l_quantity), avg(l_extendedprice), avg(l_discount), avg(l_tax)]) AS mean FROM lineitem GROUP BY 1),
         t AS (SELECT feature FROM c GROUP BY feature ORDER BY var_samp(mean) DESC LIMIT 2)
    SELECT feature, cluster, round(mean, 5) AS mean FROM c WHERE feature IN (FROM t)""")
def column_profile(spark, d):
    return rounded(cq.cluster_profile(read_table(spark, d, "lineitem"), LINE, "l_returnflag", 2), "mean", digits=5)


@query("cluster_compare", f"""
    WITH t AS {_T}, u AS (SELECT label % 4 AS y, label % 5 AS c, count(*) AS n FROM embeddings GROUP BY ALL)
    SELECT 'three' AS algorithm, count(DISTINCT c) AS n_clusters, (SELECT round(sum(m) / sum(n), 6) FROM (SELECT max(n) AS m, sum(n) AS n FROM t GROUP BY c)) AS purity FROM t
    UNION ALL SELECT 'five', count(DISTINCT c), (SELECT round(sum(m) / sum(n), 6) FROM (SELECT max(n) AS m, sum(n) AS n FROM u GROUP BY c)) FROM u""")
def cluster_compare(spark, d):
    emb = read_table(spark, d, "embeddings").select((F.col("label") % 4).alias("y"), (F.col("label") % 3).alias("three"), (F.col("label") % 5).alias("five"))
    parts = [emb.agg(F.count_distinct(c).alias("n_clusters")).crossJoin(cq.purity(emb, "y", c)).select(F.lit(c).alias("algorithm"), "n_clusters", F.round("purity", 6).alias("purity")) for c in ("three", "five")]
    return reduce(DataFrame.unionByName, parts)
