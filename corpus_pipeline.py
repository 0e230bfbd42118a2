"""A corpus pipeline: language ID, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  ``run`` writes each stage's result to the shared folder and reads it for the next.
"""

from __future__ import annotations

import warnings

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.llm import bpe, decontaminate, jaccard_join, langid, secrets
from srcloom.llm.storage import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null and empty texts, and texts without letters.

    That doesn't depend on what could be learned: without any labelled text a warning says so, and texts
    with letters stay.  Repeated rows go or stay together; an empty table gives no rows; columns that are
    named like the prediction's stay as they are.
    """
    prototypes = langid.fit(docs.where(~langid.held_out()))
    rows = docs.select(F.struct("*").alias("row"), "text")
    if not prototypes:
        warnings.warn("no labelled text to learn languages from: only texts without letters go", stacklevel=2)
        return rows.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select("row.*")
    return langid.predict(rows, prototypes).where(F.col("lang_pred") != "und").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, that with the least doc_id.

    Of rows with equal doc_id in such a class one stays; null and empty texts and rows without doc_id
    anywhere in their class all stay; an empty table gives no rows.
    """
    return jaccard_join.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts stay; repeated rows go or stay together; an empty table or benchmark drops nothing.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts and counts n_chars of changed texts anew; no document goes.

    Null and empty texts stay as they are; repeated rows are masked alike; an empty table gives no rows.
    """
    return secrets.masked(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens and digests of the ids and of the decoded texts, a row for each row of docs.

    Null and empty texts have no tokens; repeated rows have equal results; an empty table gives no rows.
    """
    return bpe.bpe_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("secret scans", mask_secrets),
    ("BPE encoding and decoding", tokenize),
]
#: SQL can express neither the trained models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes when the next one is written."""
    own = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = own.put(docs, f"{k}")
            if k:
                own.drop(f"{k - 1}")
    return docs
