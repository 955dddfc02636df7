"""The three workloads end to end: prepare a log, train and retrain on it, cluster it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logforge.functions.lineage import materialise
from logforge.functions.ordered import sketches
from logforge.operators import aggregates, anomaly, balance, cluster, encode, features, missing, models, outliers, quality, sampling, scale, typing_rules
from logforge.operators import cluster_quality as cq
from logforge.operators.missing import col
from logforge.operators.reduce import Pca, anova_top, to_vector
from logforge.sources import tables


@dataclass(frozen=True)
class LogColumns:
    """The roles that columns of a log play."""

    event_id: str
    ts: str
    actor: str
    action: str
    label: str


@dataclass(frozen=True)
class Prepared:
    """A table that models can read, reports on the way to it, and other tables of the same rows, by name."""

    table: DataFrame
    reports: dict[str, DataFrame]
    tables: dict[str, DataFrame]


def read_log(spark: SparkSession, path: str, rules: typing_rules.TypingRules = typing_rules.AUDIT_LOG, columns: list[str] | None = None,
             line_feeds: bool = True) -> DataFrame | None:
    """A raw CSV log with types and standard names; None where there is no file."""
    raw = tables.load_raw_csv(spark, path, columns, line_feeds)
    return None if raw is None else typing_rules.standardise_names(typing_rules.apply_types(raw, rules))


def prepare(raw: DataFrame, roles: LogColumns, fraction: float = 0.8, contamination: float = 0.05, keep: list[str] | None = None) -> Prepared:
    """A typed log to a table that models can read: sparse columns dropped, gaps filled, duplicates removed, a
    stratified sample taken, features derived, text coded, numbers scaled, outliers flagged by all detectors, columns
    selected. Reports: quality, duplicates, actors, actions, hours, summary, correlation, bins (rows by part of the day), subsets (rows of each),
    selected (the features that tell the label best, by analysis of variance), classes (before and after each resampler),
    components (principal ones, up to 95 % of the variance), severity, outliers, and nulls (columns with missing values that the
    table still has). Other tables: components (id, label and the rows' scores on them) and selected (event id, the selected
    features and the label).

    The label and what derives from it take no part in the outlier tests, and the label's ratio of an actor is no
    feature of the result. Event ids are numbers, or texts of numbers."""
    found = {"quality": quality.null_profile(raw)}
    labelled = raw.where(col(roles.label).isNotNull())
    dense = missing.drop_sparse(labelled)
    numbers = {c: v for c, v in missing.fit_medians(dense).items() if c not in (roles.event_id, roles.label)}
    filled = missing.fill(dense, numbers)
    found["duplicates"] = quality.duplicate_counts(filled, roles.event_id)
    clean = materialise(quality.guarded_key_dedupe(materialise(quality.dedupe_rows(filled)), roles.event_id)[0])
    found |= {"actors": aggregates.by_actor(clean, roles.actor, roles.ts, roles.label), "actions": aggregates.counts(clean, roles.action),
              "hours": aggregates.hourly_volume(clean, roles.ts)}
    taken = sampling.sample(clean, roles.event_id, fraction, roles.label)
    timed = features.time_features(taken, roles.ts)
    featured = materialise(features.attach_actor(timed, features.actor_table(timed, roles.actor, roles.ts), roles.actor))

    texts = [c for c in missing.string_columns(featured) if c != roles.event_id]
    narrow, _ = encode.encodable(featured, texts)
    coded = encode.apply_codes(featured, encode.fit_codes(featured, narrow), narrow) if narrow else featured
    numeric = [c for c in missing.numeric_columns(coded) if c not in (roles.event_id, roles.label)]
    scaled = materialise(scale.apply_scale(coded, scale.fit_standard(coded, numeric)))
    parted = scaled.withColumn("day_part", encode.bin_right_closed(F.col("event_hour"), *encode.DAY_PARTS))
    keys = missing.key_columns(scaled.select(*[col(c) for c in scaled.columns if not c.endswith("_scaled")]), exclude=(roles.label,))
    held = sketches(scaled, {c: col(c) for c in dict.fromkeys([*numeric, *keys])})  # summary, subsets and fences share them
    best = anova_top(scaled, numeric, roles.label)
    found |= {"summary": aggregates.numeric_summary(scaled, numeric, held), "correlation": aggregates.correlation_pairs(scaled, numeric),
              "bins": aggregates.counts(parted, "day_part"), "selected": best,
              "subsets": missing.subset_counts(scaled, roles.label, held)}

    wide = [c for c in scaled.columns if c.endswith("_scaled")]
    ident = col(roles.event_id).cast("long")
    x = scaled.select(ident.alias("id"), F.array(*[F.coalesce(col(c), F.lit(0.0)) for c in wide]).alias("x"), col(roles.label).cast("int").alias("label"))
    found["classes"] = balance.resample_report(x)
    v = to_vector(x, ["x"])
    axes = Pca(v, "features", 0.95)
    found["components"] = axes.explained(v)
    chosen = [r.feature for r in best.collect()]  # 20 at most
    more = {"components": axes.transform(v).drop("x", "features"), "selected": missing.project(scaled, [roles.event_id, *chosen], roles.label)}
    flagged = outliers.zscore_flags(outliers.iqr_flags(scaled, keys, held=held), keys)
    for c in dict.fromkeys([roles.action, *[n for n in narrow if n.endswith("type")]]):
        flagged = outliers.rare_flags(flagged, c)
    # the covariance of coded and scaled columns may be singular; key columns' is not where they differ
    flagged = outliers.mahalanobis_flags(flagged, keys)
    for scores, flag in ((anomaly.isolation_forest(x, contamination), "outlier_iforest"), (anomaly.local_outlier_factor(x, contamination=contamination), "outlier_lof")):
        own = scores.select(F.col("id").alias("__id"), flag)
        flagged = flagged.join(own, ident == F.col("__id"), "left").drop("__id").withColumn(flag, F.coalesce(flag, F.lit(False)))
    judged = materialise(outliers.final_flag(outliers.confirm(outliers.validate(outliers.with_score(flagged)))))
    found |= {"severity": outliers.severity_counts(judged), "outliers": outliers.report(judged)}
    wanted = keep or [roles.event_id, roles.action, roles.actor, *[f"{c}_code" for c in narrow], *[c for c in numeric if c in judged.columns], "is_outlier"]
    table = missing.project(judged, list(dict.fromkeys(wanted)), roles.label).dropna(subset=[roles.label])
    return Prepared(table, found | {"nulls": quality.nulls_left(table)}, more)


def load_prepared(df: DataFrame, target: str, id_col: str, leakage: tuple[str, ...] = ("actor_bot_ratio",)) -> tuple[DataFrame, list[str]]:
    """A prepared table as (id, label, features) and the features' names: rows with a label, all text columns coded
    however wide they are, gaps filled with medians, known leakage left out."""
    kept = tables.read_prepared(df, target, leakage)
    for c in [c for c in missing.string_columns(kept) if c != id_col]:
        kept = encode.apply_wide_codes(kept, encode.fit_wide_codes(kept, c), c).drop(c)
    names = [c for c in missing.numeric_columns(kept) if c not in (id_col, target)]
    filled = missing.fill(kept, missing.fit_medians(kept, names))
    rows = to_vector(filled, names).select(col(id_col).cast("long").alias("id"), "features", col(target).cast("int").alias("label"))
    return rows, names


def model(df: DataFrame, target: str, id_col: str, path: str | None = None, leakage: tuple[str, ...] = ("actor_bot_ratio",)) -> tuple[DataFrame, DataFrame]:
    """Measures of every model family on held-out rows beside those of cross-validation, and of a retrained forest. df is a
    prepared table, read as load_prepared() does: all text columns coded, gaps filled with medians, known leakage left out.
    Parameters are searched over the training rows' folds; splits are stratified; scalers and weights are fitted on
    training rows; the threshold is tuned on validation rows. With a path, the best model is saved, of whatever family."""
    rows, names = load_prepared(df, target, id_col, leakage)
    split = materialise(sampling.train_test_split(rows, "label", "id"))
    train, test = split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")
    folds = materialise(sampling.folds(train, "label", "id"))
    best, searched, known = models.search_all(folds)
    tuned = models.tuned(searched)
    scored = [models.scores(m, test).withColumn("model", F.lit(n)) for n, m in best.items()]
    table = models.measures_by(materialise(reduce(DataFrame.unionByName, scored)), ["model"])
    table = materialise(models.with_cv(table, models.cross_validate(folds, tuned, known=known)))
    if path is not None:
        first = table.orderBy(F.desc("f1"), "model").first()["model"]
        models.save(best[first], names, path, df.sparkSession)
    inner = materialise(sampling.train_test_split(train, "label", "id", seed=43))
    again = models.retrain(inner.where("split = 'train'").drop("split"), inner.where("split = 'test'").drop("split"), test)
    return table, again


def cluster_all(df: DataFrame, label: str | None = None) -> DataFrame:
    """(algorithm, metric, value) of k-means, a Gaussian mixture, Ward and DBSCAN. df: id, x and perhaps a label."""
    rows = materialise(df)
    found = {
        "kmeans": cluster.kmeans_sweep(rows)[1], "mixture": cluster.gmm_sweep(rows)[1],
        "ward": cluster.ward_two_stage(rows)[1], "dbscan": cluster.dbscan_sweep(rows)[1]}
    out: dict[str, dict[str, float]] = {}
    for name, labels in found.items():
        both = materialise(rows.join(labels, "id"))
        n, noise, rows_ = both.agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))), F.count_if(F.col("cluster") < 0), F.count(F.lit(1))).first()
        own = {"n_clusters": n, "noise": noise, "noise_fraction": noise / rows_ if rows_ else None}
        own["silhouette"] = cq.silhouette_by_clusters(both, "id").first()[0]
        own["davies_bouldin"] = cq.davies_bouldin(both).first()[0]
        own["calinski_harabasz"] = cq.calinski_harabasz(both).first()[0]
        if label is not None:
            own["ari"] = cq.adjusted_rand(both, label, "cluster").first()[0]
            own["nmi"] = cq.normalised_mutual_information(both, label, "cluster").first()[0]
            own["purity"] = cq.purity(both, label, "cluster").first()[0]
        out[name] = own
    return cluster.compare(out, df)
