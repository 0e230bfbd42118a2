"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from srcloom.llm import bpe, chat, decontaminate, hard_negatives, jaccard_join, jpeg, langid, licenses, runs, secrets, site_style, token_files, url_filter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.main_text(_read(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.canonical_chats(_read(spark, sf_dir, "conversations"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_features(jpeg.stored_media(_read(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_bpe, op3_url_filter, op4_main_text, op5_token_files, op6_secrets, op7_decontamination, op8_chat, op9_jaccard_join, op10_jpeg_media, op11_hard_negatives, op12_license_scan, op13_periodic_runs)}
ORACLES: dict[str, str] = {"op3_url_filter": url_filter.SQL, "op11_hard_negatives": hard_negatives.SQL}
