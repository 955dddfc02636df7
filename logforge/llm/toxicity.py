"""Toxicity by a classifier chain.

Categories are predicted one after another; each category's linear model sees the probabilities of the categories
before it. In training these are out-of-fold predictions, made by models that did not see the row, so that later models
learn how far to trust them. The last category is toxicity as a whole.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Mapping
from importlib.resources import files

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logforge.llm.common import materialise, once, read_table, release

#: Labelled rows that the chain is fitted on at most, chosen by a hash of the id.
MAX_TRAIN = 20_000
#: Terms (words and beginnings of words) that models see, folds, and the least probability of a toxic document.
TERMS, FOLDS, THRESHOLD = 800, 3, 0.4
#: The least log-likelihood ratio of a term: under it, a difference of that size often comes by chance.
LEAST_GAIN = 3.0
#: The penalty of a term whose ratio is SURE_GAIN; terms of smaller ratios, up to a tenth, are penalised more.
DECAY, SURE_GAIN = 5e-5, 20.0
#: Beginnings of words, in characters, that are terms beside whole words.
PREFIXES = (4, 5, 6)
#: The weight of words at which a toxic document is of a category.
LEAST_WEIGHT = 2


def read_categories(text: str) -> dict[str, dict[str, int]]:
    """{category: {word: weight}} of a vocabulary: lines of category, language, word, weight; # begins a remark."""
    out: dict[str, dict[str, int]] = {}
    for line in text.splitlines():
        if line and not line.startswith("#"):
            category, _, word, weight = line.split("\t")
            own = out.setdefault(category, {})
            own[word.lower()] = max(int(weight), own.get(word.lower(), 0))
    return out


#: The categories before the whole, of the vocabulary that comes with this package: a toxic document is of one if it has
#: its words. Where it has none, as in a language that the lists lack, the chain's last model learns from the label alone.
CATEGORIES: Mapping[str, Mapping[str, int]] = read_categories(files(__package__).joinpath("vocabulary/toxicity.tsv").read_text("utf-8"))
_WORD = re.compile(r"[^\W\d_]+")
#: Texts that are scored at once.
_AT_ONCE = 512
#: Words whose terms a worker remembers.
_REMEMBERED = 100_000


def terms(text: str | None) -> set[str]:
    """The distinct terms of a whole text: its lower-cased words, and their beginnings with a star."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for n in PREFIXES for w in words if len(w) > n}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Rows:
    """Sparse 0/1 rows: the places of their terms."""

    def __init__(self, places: list[np.ndarray], width: int):
        self.n, self.width = len(places), width
        self.row = np.repeat(np.arange(self.n), [len(p) for p in places])
        self.place = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
        self.norm = 1 / np.sqrt(np.maximum(1, np.bincount(self.row, minlength=self.n)))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.place], self.n) * self.norm

    def gather(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, (errors * self.norm)[self.row], self.width)


class Linear:
    """Logistic regression on terms and a few dense columns."""

    def __init__(self, width: int, extra: int):
        self.weights, self.extra, self.bias, self.share = np.zeros(width), np.zeros(extra), 0.0, 0.0

    def fit(self, rows: _Rows, dense: np.ndarray, y: np.ndarray, use: np.ndarray, decay: np.ndarray, rounds: int = 200, rate: float = 0.15) -> Linear:
        """Full-batch Adam on the rows that `use` marks."""
        weight = use / max(1, use.sum())
        share = min(max(float((y * weight).sum()), 1e-4), 1 - 1e-4)
        self.share, self.bias = float((y * weight).sum()), float(np.log(share / (1 - share)))
        if share <= 1e-4 or share >= 1 - 1e-4:
            return self  # one class: its share is all there is to learn
        params = np.concatenate((self.weights, self.extra, [self.bias]))
        first, second = np.zeros_like(params), np.zeros_like(params)
        w, e = len(self.weights), len(self.extra)
        decay = np.concatenate((decay, np.full(e, DECAY)))
        for t in range(1, rounds + 1):
            error = (_sigmoid(rows.dot(params[:w]) + dense @ params[w : w + e] + params[-1]) - y) * weight
            grad = np.concatenate((rows.gather(error), dense.T @ error, [error.sum()]))
            grad[:-1] += decay * params[:-1]
            first = 0.9 * first + 0.1 * grad
            second = 0.99 * second + 0.01 * grad * grad
            params -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        self.weights, self.extra, self.bias = params[:w], params[w : w + e], float(params[-1])
        return self

    def predict(self, rows: _Rows, dense: np.ndarray) -> np.ndarray:
        """Probabilities; a row without any known term has the label's share in training."""
        known = np.bincount(rows.row, minlength=rows.n) > 0
        return np.where(known, _sigmoid(rows.dot(self.weights) + dense @ self.extra + self.bias), self.share)


class Chain:
    """The models of the categories in their order, and the places of the terms that they see."""

    def __init__(self, categories: list[str], gains: dict[str, float]):
        self.categories, self.places = categories, {t: k for k, t in enumerate(gains)}
        self.decay = DECAY * np.minimum(10, SURE_GAIN / np.array(list(gains.values()), dtype=float))
        self.models: list[Linear] = []

    def fit(self, rows: _Rows, labels: np.ndarray, fold: np.ndarray, folds: int) -> Chain:
        dense = np.zeros((rows.n, 0))
        for k in range(len(self.categories)):
            y = labels[:, k].astype(float)
            self.models.append(Linear(rows.width, k).fit(rows, dense, y, np.ones(rows.n), self.decay))
            if k + 1 < len(self.categories):
                own = np.zeros(rows.n)
                for f in range(folds):  # each row by a model that did not see it
                    out = Linear(rows.width, k).fit(rows, dense, y, (fold != f).astype(float), self.decay).predict(rows, dense)
                    own = np.where(fold == f, out, own)
                dense = np.hstack([dense, own[:, None]])
        return self

    def find(self, text: str | None) -> np.ndarray:
        """The places of a whole text's terms; what a word gives is remembered, as most words come again."""
        known, found = self.__dict__.setdefault("words", {}), set()
        if len(known) > _REMEMBERED:
            known.clear()
        for w in set(_WORD.findall((text or "").lower())):
            own = known.get(w)
            if own is None:
                own = known[w] = tuple(p for t in terms(w) if (p := self.places.get(t)) is not None)
            if own:
                found.update(own)
        return np.array(sorted(found), dtype=np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "words"}

    def predict(self, texts) -> np.ndarray:
        rows = _Rows([self.find(t) for t in texts], len(self.places))
        dense = np.zeros((rows.n, 0))
        for model in self.models:
            dense = np.hstack([dense, model.predict(rows, dense)[:, None]])
        return dense


def choose_terms(train: DataFrame, limit: int = TERMS) -> dict[str, float]:
    """The terms, and their ratios, whose share differs most between toxic and other rows, by the log-likelihood ratio; ties by the term.
    train: terms (array of string) and y."""
    total = train.agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = float(total.pos or 0), float((total.n or 0) - (total.pos or 0))
    if not pos or not neg:
        return {}
    df = train.select("y", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("y").cast("double").alias("a"), F.sum(F.lit(1) - F.col("y")).cast("double").alias("b")).where("a + b >= 3")
    both = F.col("a") + F.col("b")

    def part(x, expected):
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    gain = (part(F.col("a"), both * pos / (pos + neg)) + part(F.col("b"), both * neg / (pos + neg))
            + part(pos - F.col("a"), (pos + neg - both) * pos / (pos + neg)) + part(neg - F.col("b"), (pos + neg - both) * neg / (pos + neg)))
    df = df.withColumn("gain", F.round(gain, 6)).where(F.col("gain") >= LEAST_GAIN)
    return {r.term: r.gain for r in df.orderBy(F.desc("gain"), "term").limit(limit).select("term", "gain").collect()}


def fit_chain(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
              categories: Mapping[str, Mapping[str, int]] = CATEGORIES, max_train: int = MAX_TRAIN) -> Chain:
    """A chain for the categories and, last, the label, fitted on at most about max_train labelled documents, chosen by
    a hash of the id; categories: {category: {word in lower case: weight}}.

    Null ids, labels and texts are not learned from; without both classes, or from empty tables, every probability is
    the label's share, 0 without labels. A row that repeats an id counts as often as it stands there, and all rows of an
    id are of one fold. Terms of equal gain are taken in their order, so ties don't depend on partitions."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    n = known.count()
    if n > max_train:
        known = known.where(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 20)) < int(max_train / n * (1 << 20)))
    words = {c: dict(w) for c, w in categories.items()}
    names = [*words, label_col]
    # at most about max_train ids and labels are broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(known), "id")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for batch in (b.iloc[k : k + 256] for b in batches for k in range(0, len(b), 256)):  # few rows' terms at a time
            found = [terms(t) for t in batch["text"]]
            marks = [[int(y and sum(words[c][w] for w in own & words[c].keys()) >= LEAST_WEIGHT) for c in words] + [int(y)] for y, own in zip(batch["y"], found)]
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "marks": marks, "terms": [sorted(f) for f in found]})

    train = materialise(rows.mapInPandas(featured, "id long, y int, marks array<int>, terms array<string>"))
    chain = Chain(names, choose_terms(train))
    places = chain.places
    held = train.sparkSession.sparkContext.broadcast(places)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "marks": batch["marks"],
                                "places": [[held.value[t] for t in own if t in held.value] for own in batch["terms"]]})

    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    got = train.mapInPandas(placed, "id long, marks array<int>, places array<int>").select("id", "marks", "places", fold.alias("fold")).orderBy("id").toPandas()  # bounded by max_train
    marks = np.stack(got["marks"].to_numpy()) if len(got) else np.zeros((0, len(names)), dtype=int)
    return chain.fit(_Rows([np.asarray(p, dtype=np.int64) for p in got["places"]], len(places)), marks, got["fold"].to_numpy(), FOLDS)


def score_toxicity(docs: DataFrame, chain: Chain, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a struct of each category's probability, which replaces a column of that name. Texts without a
    known term, such as null and empty ones, get the labels' shares in training. Each whole text, however long, is scored
    by itself, so repeated rows, null ids and an empty table need no care; a chain without terms gives shares to all."""
    held = docs.sparkSession.sparkContext.broadcast(chain)  # bounded by TERMS and the categories
    key = ("toxicity", uuid.uuid4().hex)
    schema = ", ".join(f"`{c}` double" for c in chain.categories)

    @F.pandas_udf(schema)
    def scored(texts: pd.Series) -> pd.DataFrame:
        own = once(key, lambda: held.value, alone=True)
        parts = [own.predict(texts.iloc[k : k + _AT_ONCE]) for k in range(0, len(texts), _AT_ONCE)]
        return pd.DataFrame(np.vstack(parts) if parts else np.zeros((0, len(own.categories))), columns=own.categories)

    return docs.withColumn(out, scored(F.col(text_col)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: the probability of each category, score of the whole, and toxic (score >= THRESHOLD)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit_chain(docs, read_table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, chain)
    return scored.select("doc_id", *[F.col(f"toxicity.{c}").alias(c) for c in CATEGORIES], F.col("toxicity.toxic").alias("score")).withColumn(
        "toxic", F.col("score") >= THRESHOLD)
