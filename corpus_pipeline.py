"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Each
takes whole texts, however long, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logforge.llm import byte_bpe, decontaminate, line_dedup, simhash, toxicity
from logforge.llm.common import materialise, read_table

#: Documents that travel to a Python worker together. They are long, and workers don't give back what a batch took.
BATCH = 1_000


def _in_small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject. Null and empty texts have no terms and stay; repeated rows stay
    or go together; null ids are judged as others."""
    _in_small_batches(spark)
    chain = toxicity.fit_chain(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, chain, out="__lf_toxicity")
    return scored.where(F.col("__lf_toxicity.toxic") < toxicity.THRESHOLD).drop("__lf_toxicity")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the chunks of two lines or more that an earlier one has; n_chars is counted anew (null for a
    null text). Empty texts and blank lines stay as they are; rows that agree in id and text keep and lose the same
    chunks; the first occurrence is that of the smallest id, null ids last, and stays whole."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id. Null and empty texts, whose fingerprint is
    zero, are a group like others; rows without an id stay; of rows that agree in id and text one stays."""
    _in_small_batches(spark)
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands. Null and empty texts hold none and stay, as do repeated rows and null
    ids; with an empty benchmark all stay."""
    _in_small_batches(spark)
    found = decontaminate.find_leaks(docs, read_table(spark, sf_dir, "benchmark"), out_col="__lf_leaks")
    return found.where(F.size("__lf_leaks") == 0).drop("__lf_leaks")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, with digests of them and of what they decode to. A null text is encoded as an empty one,
    which has no ids; every row, repeated or without an id, has a row."""
    _in_small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_checked(docs, path, public_tokenizers.PATTERN, keep=["doc_id"]).select(
        "doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("byte_bpe", encode),
]

#: SQL has no expression for the classifier chain and the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
