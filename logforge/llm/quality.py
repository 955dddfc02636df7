"""Quality scores of documents: random Fourier features, ridge regression and isotonic calibration.

Statistics of a whole text are mapped by random cosines whose products approximate a Gaussian kernel (Rahimi and Recht
2007). Each partition of the training rows sums its part of the normal equations, by fold; the sums give the ridge
solution of all folds, and those that leave one fold out. The latter score the training rows, and isotonic regression
of their labels on these scores turns scores into probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logforge.llm.common import materialise, read_table

#: Labelled rows that the model is fitted on at most, chosen by a hash of the id.
MAX_TRAIN = 100_000
#: Random features, folds, ridge penalty for each row, and bins of scores for the calibration.
FEATURES, FOLDS, RIDGE, BINS = 192, 4, 1e-4, 500
_TRAIN_TASKS = 12
_SEED = 20071203
_WORD = re.compile(r"\w+")
#: What statistics() gives, in this order.
STATISTICS = (
    "log_bytes", "log_words", "upper", "digit", "space", "line_ends", "stops", "commas", "exclaims", "bars", "marks",
    "other_marks", "non_ascii", "word_length", "long_words", "distinct_words", "top_word", "doubled_words",
    "distinct_lines", "line_length", "ended_lines", "capital_lines", "compressed",
)
_CLASSES = np.zeros((10, 256))
for _k, _of in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".", b",", b"!", b"|", b"#$%&*@^~<>{}[]\\=+_`/", b"?;:'\"()-")):
    _CLASSES[_k, list(_of)] = 1


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text; zeros for a null or empty one."""
    data = (text or "").encode()
    if not data:
        return [0.0] * len(STATISTICS)
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = (_CLASSES @ counts) / n
    words = text.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    tally = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    return [
        np.log1p(n), np.log1p(len(words)), *shares, counts[128:].sum() / n,
        sizes.mean() if len(words) else 0.0, (sizes > 15).sum() / m, len(tally) / m,
        max(tally.values(), default=0) / m, sum(a == b for a, b in zip(words, words[1:])) / m,
        len(set(lines)) / k, np.log1p(n / k), sum(x.rstrip()[-1] in ".!?" for x in lines) / k,
        sum(x.lstrip()[0].isupper() for x in lines) / k, len(zlib.compress(data, 1)) / n,
    ]


def with_statistics(docs: DataFrame, text_col: str, out: str = "stats") -> DataFrame:
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(statistics(t), dtype=float) for t in texts], dtype=object)

    return docs.withColumn(out, stats(F.col(text_col)))


class Model:
    """Weights over random cosines of standardised statistics, and the steps of the calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int):
        rng = np.random.default_rng(_SEED)
        self.mean, self.scale = mean, scale
        # the kernel's width: about the distance of two rows of standardised statistics
        self.w = rng.normal(size=(len(mean), features)) / np.sqrt(len(mean))
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + len(mean) + 1)
        self.left_out: list[np.ndarray] = []  # weights of all folds but one
        self.knots = np.array([0.0]), np.array([0.5])

    def map(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.phase)) * np.cos(x @ self.w + self.phase)
        return np.hstack([np.ones((len(x), 1)), x / np.sqrt(x.shape[1]), waves])

    def raw(self, stats: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return self.map(stats) @ (self.weights if weights is None else weights)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.knots), 0.0, 1.0)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence of least weighted squared distance, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist()):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["stats"].to_numpy()).astype(float)


def fit(train: DataFrame, features: int = FEATURES, folds: int = FOLDS, ridge: float = RIDGE, bins: int = BINS) -> Model:
    """train: id, stats (array of double) and y (0 or 1). Rows are bounded by the caller, so that the sums of its
    fixed number of partitions may meet in the driver. Without rows, every score is 0.5; with one class, that class."""
    n = len(STATISTICS)
    spread = train.agg(F.count(F.lit(1)), *[F.avg(F.col("stats")[k]) for k in range(n)], *[F.stddev_pop(F.col("stats")[k]) for k in range(n)]).first()
    if not spread[0]:
        return Model(np.zeros(n), np.ones(n), features)
    scale = np.array(spread[n + 1 :], dtype=float)
    model = Model(np.array(spread[1 : n + 1], dtype=float), np.where(scale > 1e-9, scale, 1.0), features)
    size = len(model.weights)
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(folds)).cast("int")
    rows = train.select("stats", F.col("y").cast("double").alias("y"), fold.alias("fold"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((folds, size, size + 1))
        for batch in batches:
            for k, part in batch.groupby("fold"):
                z = model.map(_matrix(part))
                total[k] += z.T @ np.hstack([z, part["y"].to_numpy()[:, None]])
        yield pd.DataFrame({"sums": [total.astype("<f8").tobytes()]})

    parts = rows.mapInPandas(sums, "sums binary").toLocalIterator()  # one row for each of a fixed number of partitions
    total = np.zeros((folds, size, size + 1))
    for part in parts:
        total += np.frombuffer(part[0], "<f8").reshape(total.shape)

    def solve(s: np.ndarray) -> np.ndarray:
        penalty = ridge * max(1.0, s[0, 0]) * np.eye(size)
        penalty[0, 0] = 1e-9
        return np.linalg.solve(s[:, :size] + penalty, s[:, size])

    whole = total.sum(axis=0)
    model.weights = solve(whole)
    left_out = model.left_out = [solve(whole - part) for part in total]

    def held_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, part in batch.groupby("fold"):
                raw = np.clip(model.raw(_matrix(part), left_out[k]), -1, 2)
                yield pd.DataFrame({"bin": np.floor(raw * bins).astype("int32"), "raw": raw, "y": part["y"].to_numpy()})

    binned = rows.mapInPandas(held_out, "bin int, raw double, y double").groupBy("bin").agg(
        F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("raw").toPandas()  # at most 3 bins + 1 rows
    steps = isotonic(binned["y"].to_numpy(), binned["n"].to_numpy(dtype=float))
    model.knots = binned["raw"].to_numpy(), steps
    return model


def held_out_ids(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  max_train: int = MAX_TRAIN, threshold: float = 0.3) -> DataFrame:
    """For each row of docs: the id, held_out (its id's CRC-32 is divisible by 5; false for a null id), score (0 to 1)
    and predicted (1 if the score is at least `threshold`).

    The model is fitted on labelled rows that are not held out, at most about `max_train` of them, chosen by a hash of
    the id; scores depend on nothing but the text, which is taken whole, however long. Null labels and ids are not learned
    from; a label that repeats an id counts as often as it stands there, and all rows of an id are of one fold. Null and
    empty texts have statistics zero and a score as any other; repeated rows are scored each by itself, and equal texts
    alike. Without labels every score is 0.5; an empty table gives an empty table. Other columns of docs are not read.
    """
    scored = materialise(with_statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").select("id", "stats"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").where(~held_out_ids("id"))
    n = known.count()
    if n > max_train:
        known = known.where(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1 << 20)) < int(max_train / n * (1 << 20)))
    train = materialise(scored.join(known, "id").repartition(_TRAIN_TASKS, "id"))
    model = fit(train)

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(stats.to_numpy()).astype(float)) if len(stats) else np.zeros(0))

    return scored.select(F.col("id").alias(id_col), held_out_ids("id").alias("held_out"), score("stats").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
