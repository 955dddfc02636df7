"""Queries over neighbours, balancing, anomalies, models, clusterings, and the three workloads."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logforge.functions.lineage import materialise, scratch_dir
from logforge.jobs import pipelines
from logforge.jobs.prepare_queries import masked, rounded
from logforge.operators import anomaly, balance, cluster, knn, models, sampling, scale, typing_rules
from logforge.operators import reduce as dr
from logforge.sources.tables import read_prepared, read_table, write_csv
from logforge.streaming import filled, volume

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


DOC_FEATURES = ["n_chars", "n_words", "n_lines", "upper_share", "mark_share", "word_length"]


def documents(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, features of the text): label 1 for the smaller class, documents of low quality."""
    docs = read_table(spark, d, "documents").select("doc_id", "text", "n_chars")
    labels = read_prepared(read_table(spark, d, "labels").select("doc_id", "quality"), "quality")
    size = F.greatest(F.length("text"), F.lit(1))
    words = F.size(F.split("text", r"\s+"))
    share = lambda p: (F.length("text") - F.length(F.regexp_replace("text", p, ""))) / size
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("label"), F.col("n_chars").cast("double").alias("n_chars"), words.cast("double").alias("n_words"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"), share("[A-Z]").alias("upper_share"), share(r"[!|#$%&*]").alias("mark_share"), (size / words).alias("word_length"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    # texts are read once; fits go over their numbers
    return dr.to_vector(materialise(documents(spark, d)), DOC_FEATURES).select("id", "label", "features")


def dense(spark: SparkSession, d: str) -> DataFrame:
    return balance.matrix(materialise(documents(spark, d)), "id", "label", DOC_FEATURES)


def points(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


_E = "(SELECT vec_id AS id, embedding::double[] AS x, label FROM embeddings)"
_NEAR = f"""(SELECT query, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour)::int AS rank, neighbour, distance FROM (
    SELECT a.id AS query, b.id AS neighbour, list_distance(a.x, b.x) AS distance FROM {_E} a, {_E} b WHERE a.id <> b.id) QUALIFY rank <= 5)"""


@query("knn", f"SELECT query, rank, neighbour, round(distance, 6) AS distance FROM {_NEAR}")
def nearest(spark, d):
    p = points(spark, d)
    return rounded(knn.nearest(p, p, 5), "distance")


@query("knn_classify", f"""SELECT query, CASE WHEN sum(label % 2) * 2 > count(*) THEN 1 ELSE 0 END AS predicted, round(sum(label % 2) / count(*), 6) AS probability
    FROM {_NEAR} JOIN (SELECT vec_id AS neighbour, label FROM embeddings) USING (neighbour) GROUP BY query""")
def knn_classify(spark, d):
    p = points(spark, d)
    near = knn.nearest(p, p, 5)
    return rounded(knn.vote(near, p.select("id", (F.col("label") % 2).alias("label"))), "probability")


_SIZE = "greatest(length(text), 1)"
_SHARE = "(length(text) - length(regexp_replace(text, '{}', '', 'g'))) / " + _SIZE
_DOCS = f"""(SELECT doc_id AS id, [n_chars, len(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')), len(string_split(text, chr(10))), {_SHARE.format('[A-Z]')}, {_SHARE.format('[!|#$%&*]')},
        {_SIZE} / len(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'))]::double[] AS x, 1 - quality AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"""


def _drawn(part: int, *ids: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(ids)}, 42, {part})), 1, 13))::bigint"


#: The smaller class, synthetic points between a row and one of its five nearest of the class; {wanted}: (n, anchor, id).
_RESAMPLE = f"""
    WITH d AS {_DOCS}, c AS (SELECT label, count(*) AS n FROM d GROUP BY label), low AS (SELECT arg_min(label, (n, -label)) AS label, min(n) AS m, max(n) AS most FROM c),
         minor AS ({{minor}}),
         near AS (SELECT *, max(rank) OVER (PARTITION BY anchor) AS k FROM (
             SELECT a.id AS anchor, b.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS rank FROM minor a, minor b WHERE a.id <> b.id) WHERE rank <= 5),
         {{wanted}},
         made AS (SELECT w.id, a.x AS p, b.x AS q, {_drawn(2, 'n', 'w.anchor')} / 2.0 ** 52 AS share FROM wanted w JOIN near e ON e.anchor = w.anchor AND e.rank = {_drawn(1, 'n', 'w.anchor')} % e.k + 1
             JOIN minor a ON a.id = w.anchor JOIN minor b ON b.id = e.neighbour),
         every AS (SELECT id, x, label, false AS synthetic FROM d UNION ALL
             SELECT made.id, list_transform(list_zip(p, q), lambda z: z[1] + share * (z[2] - z[1])), low.label, true FROM made, low)
    SELECT id, label, synthetic, {', '.join(f'round(x[{k + 1}], 6) AS {c}' for k, c in enumerate(DOC_FEATURES))} FROM every"""


def _flat(df: DataFrame) -> DataFrame:
    return df.select("id", "label", "synthetic", *[F.round(F.col("x")[k], 6).alias(c) for k, c in enumerate(DOC_FEATURES)])


@query("smote", _RESAMPLE.format(
    minor="SELECT row_number() OVER (ORDER BY md5(concat_ws(':', id, 42)), id) - 1 AS id, x FROM d JOIN low USING (label)",
    wanted=f"wanted AS (SELECT n, {_drawn(0, 'n')} % m AS anchor, -n - 1 AS id FROM (SELECT unnest(range(most - m)) AS n, m FROM low))"))
def smote(spark, d):
    return _flat(balance.smote(dense(spark, d)))


@query("adasyn", _RESAMPLE.format(
    minor="SELECT id, x FROM d JOIN low USING (label)",
    wanted=f"""r AS (SELECT id, avg((other <> (SELECT label FROM low))::int) AS r FROM (
             SELECT a.id, b.label AS other, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS rank FROM minor a, d b WHERE a.id <> b.id) WHERE rank <= 5 GROUP BY id),
         g AS (SELECT id, round_even(CASE WHEN sum(r) OVER () > 0 THEN r / sum(r) OVER () ELSE 1.0 / m END * (most - m), 0)::bigint AS k FROM r, low),
         wanted AS (SELECT n, anchor, -{_drawn(3, 'n', 'anchor')} - 1 AS id FROM (SELECT id AS anchor, unnest(range(1, k + 1)) AS n FROM g WHERE k > 0))"""))
def adasyn(spark, d):
    return _flat(balance.adasyn(dense(spark, d)))


@query("smote_sizes", """WITH c AS (SELECT 1 - quality AS label, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1)
    SELECT label, (SELECT max(n) FROM c) AS n FROM c""")
def smote_sizes(spark, d):
    return smote(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("resample_report", f"""
    SELECT label, original, smote, adasyn FROM (SELECT 1 - quality AS label, count(*) AS original FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1)
    JOIN (SELECT label, count(*) AS smote FROM ({SQL['smote']}) GROUP BY 1) USING (label) JOIN (SELECT label, count(*) AS adasyn FROM ({SQL['adasyn']}) GROUP BY 1) USING (label)""")
def resample_report(spark, d):
    return balance.resample_report(dense(spark, d))


@query("stage_class_counts", """WITH c AS (SELECT 1 - quality AS label, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1)
    SELECT label, n AS original, (SELECT max(n) FROM c) AS smote FROM c""")
def stage_class_counts(spark, d):
    return resample_report(spark, d).select("label", "original", "smote")


@query("class_weights", """SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM (
    SELECT 1 - quality AS label, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1)""")
def class_weights(spark, d):
    return rounded(balance.class_weights(read_prepared(read_table(spark, d, "labels"), "quality").select((1 - F.col("quality")).alias("label")), "label"), "weight")


@query("isolation_forest")
def isolation_forest(spark, d):
    return anomaly.isolation_forest(points(spark, d))


@query("lof", f"""
    WITH e AS {_E},
         near AS (SELECT query, neighbour, distance FROM (SELECT a.id AS query, b.id AS neighbour, list_distance(a.x, b.x) AS distance FROM e a, e b WHERE a.id <> b.id)
             QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) <= 20),
         far AS (SELECT query AS neighbour, max(distance) AS kdist FROM near GROUP BY 1),
         lrd AS (SELECT query, 1.0 / (avg(greatest(distance, kdist)) + 1e-10) AS lrd FROM near JOIN far USING (neighbour) GROUP BY 1),
         s AS (SELECT near.query AS id, avg(b.lrd) / any_value(a.lrd) AS score FROM near JOIN lrd a ON a.query = near.query JOIN lrd b ON b.query = near.neighbour GROUP BY 1)
    SELECT id, round(score, 6) AS score, score > (SELECT quantile_cont(score, 0.95) FROM s) AS outlier_lof FROM s""")
def lof(spark, d):
    return rounded(anomaly.local_outlier_factor(points(spark, d)), "score")


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    split = materialise(sampling.train_test_split(vectors(spark, d), "label", "id"))
    return split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")


def _folds(spark: SparkSession, d: str, k: int) -> DataFrame:
    return materialise(sampling.folds(vectors(spark, d), "label", "id", k))


@query("train_models")
def train_models(spark, d):
    return models.train_and_compare(*_split(spark, d))[0]


@query("model_compare")
def model_compare(spark, d):
    train, test = _split(spark, d)
    cv = models.cross_validate(materialise(sampling.folds(train, "label", "id")), models.families())
    return models.compare_long(models.with_cv(models.train_and_compare(train, test)[0], cv))


@query("grid_search")
def grid_search(spark, d):
    return models.search_all(_folds(spark, d, 5))[1]


@query("cv_report")
def cv_report(spark, d):
    return models.cross_validate(_folds(spark, d, 5), models.families())


@query("learning_curve")
def learning_curve(spark, d):
    return models.learning_curve(_folds(spark, d, 5), models.estimators()["tree"], [round(0.1 + 0.9 * k / 7, 6) for k in range(8)])


@query("importance")
def importance(spark, d):
    train, test = _split(spark, d)
    fitted = models.train_and_compare(train, test, {"forest": models.estimators()["forest"]})[1]
    return models.importance(spark, fitted["forest"], DOC_FEATURES)


@query("retrain_compare")
def retrain_compare(spark, d):
    train, test = _split(spark, d)
    inner = materialise(sampling.train_test_split(train, "label", "id", seed=43))
    return models.retrain(inner.where("split = 'train'").drop("split"), inner.where("split = 'test'").drop("split"), test)


@query("model_roundtrip")
def model_roundtrip(spark, d):
    """Scores of the test rows by a model of each family, saved and loaded again."""
    train, test = _split(spark, d)
    parts = []
    for name, fitted in models.train_and_compare(train, test)[1].items():
        path = f"{scratch_dir(spark)}/logforge-model-{uuid.uuid4().hex}"
        models.save(fitted, DOC_FEATURES, path, spark)
        parts.append(models.scores(models.load(path, spark)[0], test).select(F.lit(name).alias("model"), "id", "label", "score", "predicted"))
    return reduce(DataFrame.unionByName, parts)


@query("rff_svm")
def rff_svm(spark, d):
    return models.train_and_compare(*_split(spark, d), {"svm": models.KernelSvm()})[0].unpivot(["model"], list(models.MEASURES), "metric", "value")


@query("kmeans_sweep")
def kmeans_sweep(spark, d):
    return cluster.kmeans_sweep(points(spark, d))[0]


@query("gmm_bic")
def gmm_bic(spark, d):
    return cluster.gmm_sweep(scaled_documents(spark, d))[0]


@query("ward_two_stage")
def ward_two_stage(spark, d):
    return cluster.ward_two_stage(points(spark, d))[0]


def _dbscan_sql(eps: float, least: int, source: str) -> str:
    return f"""
    WITH RECURSIVE e AS {source}, near AS (SELECT a.id AS a, b.id AS b FROM e a, e b WHERE a.id <> b.id AND list_distance(a.x, b.x) <= {eps}),
         core AS (SELECT id FROM e LEFT JOIN near ON a = id GROUP BY id HAVING count(b) + 1 >= {least}),
         inside AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
         reach AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, i.b FROM reach r JOIN inside i ON r.b = i.a),
         cores AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY 1)
    SELECT e.id, coalesce(any_value(c.cluster), min(o.cluster), -1) AS cluster FROM e LEFT JOIN cores c ON c.id = e.id LEFT JOIN near ON near.a = e.id LEFT JOIN cores o ON o.id = near.b GROUP BY 1"""


#: Features of documents, standardised: there the surveyed pairs of parameters differ.
_Z = f"""(SELECT id, [{', '.join(f'(x[{k}] - avg(x[{k}]) OVER ()) / nullif(stddev_pop(x[{k}]) OVER (), 0)' for k in range(1, len(DOC_FEATURES) + 1))}]::double[] AS x FROM {_DOCS})"""
_SWEEP = f"""
    WITH RECURSIVE z AS MATERIALIZED {_Z},
         p AS (SELECT * FROM (SELECT unnest([0.3, 0.5, 0.7, 1.0, 1.5])::double AS eps), (SELECT unnest([3, 5, 10]) AS least)),
         near AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_distance(a.x, b.x) AS d FROM z a, z b WHERE a.id <> b.id AND d <= 1.5),
         core AS MATERIALIZED (SELECT eps, least, z.id FROM p, z LEFT JOIN near ON a = z.id WHERE coalesce(d <= eps, true) GROUP BY ALL HAVING count(b) + 1 >= least),
         inside AS MATERIALIZED (SELECT c.eps, c.least, a, b FROM near JOIN core c ON c.id = a JOIN core o ON o.id = b AND o.eps = c.eps AND o.least = c.least WHERE d <= c.eps),
         cores(eps, least, id, cluster) USING KEY (eps, least, id) AS (
             SELECT eps, least, id, id FROM core
             UNION (SELECT DISTINCT ON (u.eps, u.least, u.id) u.eps, u.least, u.id, v.cluster FROM recurring.cores u JOIN inside i ON i.eps = u.eps AND i.least = u.least AND i.a = u.id
                 JOIN cores v ON v.eps = i.eps AND v.least = i.least AND v.id = i.b WHERE v.cluster < u.cluster ORDER BY u.eps, u.least, u.id, v.cluster)),
         edge AS (SELECT c.eps, c.least, near.a AS id, min(c.cluster) AS cluster FROM near JOIN cores c ON c.id = near.b WHERE d <= c.eps GROUP BY ALL),
         labels AS (SELECT p.eps, p.least, z.id, coalesce(c.cluster, e.cluster, -1) AS cluster FROM p CROSS JOIN z LEFT JOIN cores c ON c.eps = p.eps AND c.least = p.least AND c.id = z.id
             LEFT JOIN edge e ON e.eps = p.eps AND e.least = p.least AND e.id = z.id)"""


def scaled_documents(spark: SparkSession, d: str) -> DataFrame:
    """(id, x): the features of documents, standardised."""
    rows = dense(spark, d).select("id", *[F.col("x")[k].alias(c) for k, c in enumerate(DOC_FEATURES)])
    own = scale.fit_standard(rows, DOC_FEATURES)
    return scale.apply_scale(rows, own).select("id", F.array(*[F.col(f"{c}_scaled") for c in DOC_FEATURES]).alias("x"))


@query("dbscan", _dbscan_sql(0.5, 5, _Z))
def dbscan(spark, d):
    p = scaled_documents(spark, d)
    return cluster.dbscan_many(p, [(0.5, 5)]).drop("run")


@query("dbscan_sweep", _SWEEP + """
    SELECT eps, least, count(DISTINCT cluster) FILTER (cluster >= 0) AS n_clusters, count(*) FILTER (cluster < 0) AS noise FROM labels GROUP BY ALL""")
def dbscan_sweep(spark, d):
    return cluster.dbscan_sweep(scaled_documents(spark, d))[0].drop("silhouette")


@query("dbscan_clusters", _SWEEP + """,
         l AS MATERIALIZED (SELECT l.*, x FROM labels l JOIN z USING (id) WHERE cluster >= 0),
         many AS MATERIALIZED (SELECT l.* FROM l WHERE (eps, least) IN (SELECT (eps, least) FROM l GROUP BY eps, least HAVING count(DISTINCT cluster) > 1)),
         each AS (SELECT a.eps, a.least, a.id, a.cluster, b.cluster AS other, sum(list_distance(a.x, b.x) ** 2) AS s, count(*) AS n
             FROM many a JOIN many b ON a.eps = b.eps AND a.least = b.least GROUP BY ALL),
         ab AS (SELECT eps, least, id, max(CASE WHEN cluster = other THEN n END) AS n, max(CASE WHEN cluster = other THEN s / greatest(1, n - 1) END) AS a,
             min(CASE WHEN cluster <> other THEN s / n END) AS b FROM each GROUP BY ALL),
         widths AS (SELECT eps, least, avg(CASE WHEN n < 2 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS width FROM ab GROUP BY ALL),
         best AS (SELECT first(eps ORDER BY round(width, 9) DESC, eps, least) AS eps, first(least ORDER BY round(width, 9) DESC, eps, least) AS least FROM widths)
    SELECT id, cluster FROM labels WHERE (eps, least) = (SELECT (coalesce(eps, 0.5), coalesce(least, 5)) FROM best)""")
def dbscan_clusters(spark, d):
    """The clustering that the sweep chooses."""
    return cluster.dbscan_sweep(scaled_documents(spark, d))[1]


RULES = typing_rules.TypingRules(datetimes=("ts",), identifiers=("event_id", "actor"), categories=("action", "category"), booleans=("value", "sparse", "label"))


def _prepared(spark: SparkSession, d: str) -> pipelines.Prepared:
    # events come twice now and then, as in a real log, and as a raw CSV file
    ev = masked(spark, d)
    ev = ev.unionByName(ev.where("event_id % 10 = 0"))
    path = f"{scratch_dir(spark)}/logforge-log-{uuid.uuid4().hex}"
    write_csv(ev.select(*[F.col(c).cast("string").alias(c) for c in ev.columns]), path)
    log = pipelines.read_log(spark, path, RULES, ev.columns)
    return pipelines.prepare(log, pipelines.LogColumns("event_id", "ts", "actor", "action", "label"))


@query("prepare_pipeline")
def prepare_pipeline(spark, d):
    return _prepared(spark, d).table


@query("prepare_reports")
def prepare_reports(spark, d):
    """All reports of the workload in one form: the report, what identifies a row in it, and its values as JSON."""
    found = _prepared(spark, d).reports
    parts = [df.select(F.lit(n).alias("report"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row")) for n, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


@query("model_pipeline")
def model_pipeline(spark, d):
    """The workload on a prepared table of documents: numbers of the text, and its language and source, which are coded."""
    more = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    table, again = pipelines.model(materialise(documents(spark, d).join(more, "id")), "label", "id", f"{scratch_dir(spark)}/logforge-model-{uuid.uuid4().hex}")
    return table.unionByName(again, allowMissingColumns=True)


@query("cluster_pipeline")
def cluster_pipeline(spark, d):
    return pipelines.cluster_all(scaled_documents(spark, d).join(dense(spark, d).select("id", "label"), "id"), "label")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = read_table(spark, d, "events").schema
    # one file is a folder's only match, so the stream reads just this table
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_volume", """WITH h AS (SELECT date_trunc('hour', ts)::timestamp AS bucket, count(*) AS n FROM events GROUP BY 1), m AS (SELECT max(ts) AS last FROM events)
    SELECT bucket, n FROM h, m WHERE bucket + INTERVAL 1 HOUR <= last - INTERVAL 1 HOUR""")
def stream_volume(spark, d):
    base = f"{scratch_dir(spark)}/logforge-stream-{uuid.uuid4().hex}"
    volume.run_available(volume.volume(_event_stream(spark, d), "ts"), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("stream_volume_filled", """WITH m AS (SELECT max(ts) AS last FROM events), h AS (SELECT event_type AS series, date_trunc('hour', ts)::timestamp AS bucket, count(DISTINCT event_id) AS n FROM events GROUP BY ALL),
         spine AS (SELECT series, unnest(range(min(bucket), last, INTERVAL 1 HOUR)) AS bucket FROM h, m GROUP BY series, last)
    SELECT series, bucket, coalesce(n, 0) AS n FROM spine LEFT JOIN h USING (series, bucket), m WHERE bucket + INTERVAL 1 HOUR <= last - INTERVAL 1 HOUR""")
def stream_volume_filled(spark, d):
    """The volume of each type of event, with empty hours."""
    base = f"{scratch_dir(spark)}/logforge-stream-{uuid.uuid4().hex}"
    volume.run_available(filled.filled_volume(_event_stream(spark, d), "ts", "event_id", "event_type"), f"{base}/out", f"{base}/checkpoint")
    return filled.sum_volume(spark.read.parquet(f"{base}/out")).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
