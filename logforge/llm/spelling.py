"""Spelling variant grouping by a symmetric-delete join.

Every word emits a key for itself and for each distinct string that it becomes by one deletion. Words that are one edit
apart share a key, so an equi-join finds them; the exact distance is then verified. A word's form is its most frequent
near word, where that one is much more frequent; roots come from following forms, by joins that double the distance
followed in each round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logforge.llm.common import hot_keys, materialise, read_table, spread_join

#: A run of letters, and the letters that are lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run loses a letter where this divides the checksum of its document's id and itself.
SLIPS = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A form has at least so many times the word's occurrences.
RATIO = 2
#: Of the rolling hash behind the keys; odd, so that it has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = SLIPS) -> DataFrame:
    """(word) for every run of letters of every text, A-Z lower-cased. With slips, a run whose checksum with the
    document's id is divisible by that number loses one letter: misspellings at known places. A null text has none, a null
    id counts as an empty one."""
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.translate(F.col(f"`{text_col}`"), _UPPER, _LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    if slips is None:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % slips == 0, cut).otherwise(F.col("run")).alias("word"))


def deletion_keys(word: str) -> np.ndarray:
    """The 64-bit hashes of a word and of all that it becomes by one deletion, each once. A rolling hash gives each in
    constant time, so a word of any length costs work and memory in proportion to it."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    codes = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    codes ^= codes >> np.uint64(29)
    powers = np.full(len(codes), _BASE, np.uint64)
    powers[:1] = 1
    before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * np.cumprod(powers), dtype=np.uint64)))
    without = before[:-1] + (before[-1] - before[1:]) * np.uint64(_BACK)
    return np.unique(np.append(without, before[-1])).view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _keys(words: pd.Series) -> pd.Series:
    return words.map(deletion_keys)


def near_words(counts: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of words of counts (word, n), in both directions, that are exactly one inserted,
    deleted or replaced letter apart. Those that share a key are no more than the letters of the alphabet times their
    length, however large the corpus: a key is a string, and the words are what one insertion makes of it.

    Both sides are merged: Spark takes a word's keys for one, and would broadcast them all."""
    keyed = counts.select("word", "n", F.explode(_keys("word")).alias("key"))
    other = keyed.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key")
    met = keyed.drop("n").join(other.hint("merge"), "key").where((F.col("word") != F.col("near")) & (F.abs(F.length("word") - F.length("near")) <= 1))
    # two words may share more than one key
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n").distinct()


def _roots(forms: DataFrame, rows: int) -> DataFrame:
    """(word, root) of forms (word, form): where following forms ends. Forms at least double the count, so there is no
    circle, and after k rounds 2^k steps have been followed."""
    found = materialise(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        table = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        # many words may have one root
        sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        step = spread_join(found, table, ["root"], hot_keys(sizes, ["root"], rows), ["word"])
        step = materialise(step.select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        found = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return found


def group_spellings(found: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each distinct word of the column word of at least so many letters and
    occurrences. n_near: how many of these words are one edit away (0 if none); form: the one of them with the largest n,
    ties by the order of code points, if its n is at least ratio times the word's, else null as is form_n; root: where
    following forms ends, the word itself without a form.

    Null and empty words are none; repeated rows add to n; an empty table gives an empty table. Words of any length are
    taken whole."""
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: forms of like counts could name each other")
    counts = found.where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.where(F.col("n") >= least_count))
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("first")
    best = near_words(counts).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), first)
    own = counts.join(best.hint("merge"), "word", "left").withColumn("near_n", -F.col("first.less"))
    chosen = F.col("near_n") >= F.col("n") * ratio
    forms = materialise(own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                   F.when(chosen, F.col("first.near")).alias("form"), F.when(chosen, F.col("near_n")).alias("form_n")))
    return forms.join(_roots(forms, forms.count()).hint("merge"), "word")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return group_spellings(words(docs)).select("word", "form", "root", "n", "n_near", "form_n")


def op11_sql() -> str:
    """The same in DuckDB. Near words are found by another way: by their forms with one letter hidden, and by what a longer
    word becomes without a letter."""
    return f"""
        WITH RECURSIVE
        crc AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) r(i)),
        texts AS (SELECT doc_id, translate(text, '{_UPPER}', '{_LOWER}') AS text FROM documents WHERE text IS NOT NULL),
        runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '{RUN}')) AS run FROM texts),
        each AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
        bytes AS (
            SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
                lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::bigint] ELSE [(192 + (unicode(x) >> 6))::bigint, (128 + (unicode(x) & 63))::bigint] END)) AS b FROM each),
        summed AS (
            SELECT run, n, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::bigint)) AS h FROM bytes, crc),
        slipped AS (
            SELECT CASE WHEN h % {SLIPS} = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM summed),
        w AS (SELECT word, sum(n)::bigint AS n FROM slipped WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
        cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
        cuts AS (SELECT DISTINCT word, n, i, word[: i - 1] || word[i + 1 :] AS less, word[: i - 1] || '*' || word[i + 1 :] AS hidden FROM cut),
        near AS (
            SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b USING (hidden) WHERE a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cuts a JOIN w b ON b.word = a.less
            UNION SELECT b.word, a.word, a.n FROM cuts a JOIN w b ON b.word = a.less),
        best AS (
            SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
        forms AS (
            SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form,
                   CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
        path AS (
            SELECT word, word AS at FROM forms
            UNION ALL SELECT p.word, f.form FROM path p JOIN forms f ON f.word = p.at WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, p.at AS root, f.n, f.n_near, f.form_n
        FROM forms f JOIN path p USING (word) JOIN forms l ON l.word = p.at AND l.form IS NULL"""
