"""From documents to tokens: quality, near-duplicates, decontamination, personal data, encoding.

Every stage takes all that the one before kept and decides on that alone. A stage is written as
Parquet in the shared checkpoint folder and read again by the next one; the table before it is
removed then.

Defined results: a null or empty text is scored like any text and, if it stays, has no tokens; rows
without an id are never compared and stay in near-duplicates; of rows that repeat an id one stays there.
An empty table gives no rows. The first four stages return the columns that ``docs`` came with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.llm import byte_bpe, decontam, gam, odd_sketch, pii
from wirefold.llm.shared import Scratch, fresh, settings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model does not reject."""
    settings(spark)
    score = fresh(docs, "_quality")
    model = gam.learn(docs, _table(spark, sf_dir, "labels"))
    return gam.scored(docs, model, score=score).where(F.col(score) >= 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: a similarity of 0.8 or more on word shingles."""
    settings(spark)
    return odd_sketch.one_of_each(docs, bound=odd_sketch.FOUR_FIFTHS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    settings(spark)
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, and n_chars as the text then has."""
    settings(spark)
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"),
                                                   F.col("n_chars")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to."""
    settings(spark)
    return byte_bpe.digest(byte_bpe.encode(docs.select("doc_id", "text")))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("personal_data", personal_data),
          ("encoding", encoding)]
ORACLE_SQL = None            # a fitted model and a tokenizer have no SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
