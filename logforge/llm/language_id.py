"""Language identification by nearest centroids.

A text is a vector of its letters' n-grams, hashed to a fixed width, weighted by TF-IDF and brought to length one. Each
language has several centroids, found by clustering its texts by cosine. A text's language is that of the nearest
centroid; it is rejected where it is much farther away than that language's texts are from theirs.

Document frequencies are counted over all rows that may be learned from. Centroids are fitted on at most PER_LANGUAGE
distinct texts of each language, which a hash of the text draws.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logforge.llm.common import materialise, once, read_table

#: Lengths of n-grams of letters, and the number of places that they are hashed to.
GRAMS, WIDTH = (1, 2, 3), 1 << 13
#: Distinct labelled texts that a language's centroids are fitted on at most.
PER_LANGUAGE = 2_000
#: Centroids of a language at most, and rounds of clustering.
CENTROIDS, ROUNDS = 4, 8
#: A text is rejected if its distance is over the mean of its language's texts by so many standard deviations.
DEVIATIONS = 6.0
UNKNOWN = "und"
#: Characters that are counted at once, and texts whose vectors are held at once.
_SLICE, _BATCH = 1 << 20, 256
_MIX = np.uint32(0x9E3779B1)


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _slices(text: str) -> Iterator[str]:
    """The text in parts of about _SLICE characters, cut at spaces where there are some."""
    at = 0
    while len(text) - at > _SLICE:
        cut = text.rfind(" ", at + 1, at + _SLICE)
        cut = at + _SLICE if cut < 0 else cut
        yield text[at:cut]
        at = cut
    yield text[at:]


def grams(text: str | None, width: int = WIDTH) -> np.ndarray | None:
    """How often each place of n-grams occurs in the lower-cased words of a whole text; None if it has no letter."""
    letters = once(("letters",), _letters)
    counts, some = np.zeros(width, np.int64), False
    for part in _slices(text or ""):
        codes = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[codes]
        if not is_letter.any():
            continue
        some = True
        codes = np.where(is_letter, codes, 0)
        codes = codes[is_letter | np.append(True, is_letter[:-1])]  # one gap between words
        codes = np.concatenate((np.zeros(int(codes[0] != 0), np.uint32), codes, np.zeros(int(codes[-1] != 0), np.uint32))).astype(np.uint32)
        hashed = np.zeros(len(codes), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            if len(codes) < n:
                break
            hashed = (hashed[: len(codes) - n + 1] + codes[n - 1 :] + np.uint32(n)) * _MIX
            hashed ^= hashed >> np.uint32(15)
            if n in GRAMS:
                own = hashed if n > 1 else hashed[codes != 0]
                counts += np.bincount(own & np.uint32(width - 1), minlength=width)
    return counts if some else None


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The TF-IDF vector of length one."""
    out = (np.log1p(counts) * idf).astype(np.float32)
    return out / np.linalg.norm(out)


class Model:
    """Languages in order, the IDF of each place, and the centroids: whose they are, where, and how far a text may lie."""

    def __init__(self, idf: np.ndarray, owners: list[str], centroids: np.ndarray, radii: np.ndarray | None = None):
        self.idf, self.owners, self.centroids = idf, owners, centroids
        self.radii = np.full(len(owners), 1.0) if radii is None else radii

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, cosine, margin) of each vector; the margin is to the nearest centroid of another language."""
        cosines = vectors @ self.centroids.T
        best = cosines.argmax(axis=1)
        top = np.take_along_axis(cosines, best[:, None], 1)[:, 0]
        languages = np.array(self.owners)
        rest = np.where(languages[None, :] == languages[best][:, None], 0.0, cosines).max(axis=1)
        return best, top, top - rest

    def predict(self, texts) -> list[tuple]:
        """(nearest, score, margin, rejected) of each text: the nearest language, None without letters or languages."""
        texts, out = list(texts), []
        for at in range(0, len(texts), _BATCH):
            found = [grams(t, len(self.idf)) if self.owners else None for t in texts[at : at + _BATCH]]
            some = [f for f in found if f is not None]
            if not some:
                out += [(None, 0.0, 0.0, True)] * len(found)
                continue
            best, top, margin = self.nearest(np.stack([weighted(f, self.idf) for f in some]))
            rows = iter([(self.owners[b], float(min(max(c, 0.0), 1.0)), float(m), bool(1 - c > self.radii[b])) for b, c, m in zip(best, top, margin)])
            out += [(None, 0.0, 0.0, True) if f is None else next(rows) for f in found]
        return out


def _frequencies(texts: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """How many of all texts each place occurs in, and how many have letters: sums of the partitions' sums."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = np.zeros(width, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                if (found := grams(text, width)) is not None:
                    sums += found > 0
                    n += 1
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"place": np.append(at, -1), "n": np.append(sums[at], n)})

    rows = texts.mapInPandas(counted, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # width + 1 rows at most
    out = np.zeros(width + 1, np.int64)
    for r in rows:
        out[r.place] = r.n
    return out[:width], int(out[width])


def _drawn(train: DataFrame, per_language: int) -> DataFrame:
    """(language, text): at most so many distinct texts of each language, those whose hash is smallest. Rows whose hash
    is too high to be drawn go before copies are merged and the rest is ranked, so no language is ranked whole."""
    sizes = train.groupBy("language").agg(F.approx_count_distinct("text", 0.02).alias("n"))  # a row for each language
    span = F.lit(float(1 << 31))
    share = F.least(F.lit(1.0), F.lit(1.5 * per_language + 200) / F.col("n"))
    place = F.shiftright(F.xxhash64("text"), 32).cast("double") + span  # 0 to 2^32
    few = train.join(F.broadcast(sizes), "language").where(place < share * span * 2).select("language", "text")
    few = few.groupBy("language", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    # about one and a half times per_language rows of each language
    rank = F.row_number().over(Window.partitionBy("language").orderBy("h"))
    return few.withColumn("rank", rank).where(F.col("rank") <= per_language)


def _sums(drawn: DataFrame, model: Model) -> dict[int, tuple[int, float, float, np.ndarray]]:
    """For each centroid the texts of its language that it is nearest to: how many, the sums of their distances and of
    their squares, and of their vectors. Partitions' sums are added up by centroid."""
    held = drawn.sparkSession.sparkContext.broadcast(model)  # some centroids for each language
    width = len(model.idf)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        languages = np.array(model.owners)
        sums: dict[int, list] = {}
        for batch in batches:
            for language, text in zip(batch["language"], batch["text"]):
                if (found := grams(text, width)) is None:
                    continue
                x = weighted(found, model.idf)
                at = np.flatnonzero(languages == language)
                cosines = model.centroids[at] @ x
                k = int(cosines.argmax())
                s = sums.setdefault(int(at[k]), [0, 0.0, 0.0, np.zeros(width)])
                far = 1.0 - float(cosines[k])
                s[0], s[1], s[2] = s[0] + 1, s[1] + far, s[2] + far * far
                s[3] += x
        yield pd.DataFrame([(k, n, d, q, v.tobytes()) for k, (n, d, q, v) in sums.items()], columns=["k", "n", "far", "square", "vector"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        vector = np.sum([np.frombuffer(v) for v in rows["vector"]], axis=0)
        return pd.DataFrame([(rows["k"].iloc[0], rows["n"].sum(), rows["far"].sum(), rows["square"].sum(), vector.tobytes())], columns=rows.columns)

    schema = "k int, n long, far double, square double, vector binary"
    rows = drawn.mapInPandas(summed, schema).groupBy("k").applyInPandas(added, schema).collect()  # a row for each centroid
    return {r.k: (r.n, r.far, r.square, np.frombuffer(r.vector)) for r in rows}


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, rounds: int = ROUNDS,
        deviations: float = DEVIATIONS, width: int = WIDTH) -> Model:
    """A model of train (text, language). Rows without text, language or letters teach nothing, repeated texts of a
    language count once for its centroids. A language of few texts has fewer centroids; without any row there is no
    language."""
    train = train.where("text is not null and language is not null")
    frequency, n = _frequencies(train, width)
    idf = np.log((1 + n) / (1 + frequency)) + 1.0
    drawn = materialise(_drawn(train, per_language))
    seeds = drawn.where(F.col("rank") <= 8 * centroids).orderBy("language", "rank").collect()  # a few for each language
    owners, first = [], []
    for r in seeds:
        if owners.count(r.language) < centroids and (found := grams(r.text, width)) is not None:
            owners.append(r.language)
            first.append(weighted(found, idf))
    model = Model(idf, owners, np.array(first, np.float32).reshape(-1, width))
    for _ in range(rounds):
        if not owners:
            break
        moved = model.centroids.copy()
        for k, (_, _, _, vector) in _sums(drawn, model).items():  # a centroid without texts stays
            moved[k] = vector / np.linalg.norm(vector)
        same = np.allclose(moved, model.centroids, atol=1e-6)
        model = Model(idf, owners, moved)
        if same:
            break
    last = _sums(drawn, model) if owners else {}
    for language in set(owners):
        own = [k for k, o in enumerate(owners) if o == language]
        n, far, square = (sum(last[k][j] for k in own if k in last) for j in range(3))
        mean = far / n
        model.radii[own] = min(1.0, mean + deviations * math.sqrt(max(0.0, square / n - mean * mean)))
    return model


_SCHEMA = "nearest string, score double, margin double, rejected boolean"


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """docs with a column `out`, in place of one of that name: a struct of lang (the nearest language, `und` where the text
    is rejected), nearest (whether it is rejected or not), score (the cosine to the nearest centroid, 0 to 1), margin (how much
    nearer it is than any centroid of another language) and rejected.

    A text that is null or has no letter is rejected, its nearest is `und` and its score 0, as are those of all texts where
    the model has no language. Ties go to the first language in order. Whole texts are read, a part at a time; each row
    is judged by its text alone, so repeated rows, null ids and empty tables need no care."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # some centroids for each language

    @F.pandas_udf(_SCHEMA)
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(held.value.predict(texts), columns=["nearest", "score", "margin", "rejected"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c != out]
    got = docs.withColumn("__lf_language", found(F.col(f"`{text_col}`")))
    lang = F.when(F.col("__lf_language.rejected"), F.lit(UNKNOWN)).otherwise(F.col("__lf_language.nearest")).alias("lang")
    nearest = F.coalesce("__lf_language.nearest", F.lit(UNKNOWN)).alias("nearest")
    rest = [F.col(f"__lf_language.{n}").alias(n) for n in ("score", "margin", "rejected")]
    return got.select(*kept, F.struct(lang, nearest, *rest).alias(out))


def held_out_ids(id_col: str) -> Column:
    """Whether a row is held out of learning. A null id is not, but nor is its row learned from."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = docs.where(F.col("doc_id").isNotNull() & ~held_out_ids("doc_id"))
    model = fit(learned.select("text", F.col("lang").alias("language")))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out_ids("doc_id").alias("held_out"), F.col("language.nearest").alias("lang_pred"), F.col("language.score").alias("score"),
                        F.col("language.margin").alias("margin"), F.col("language.rejected").alias("rejected"))
