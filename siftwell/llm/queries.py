"""The operators' queries, each over its whole table with production parameters, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import lexicon, media, mixing, near_copies, posters, quality, secrets, token_counts, token_ids, toxicity, url_filter
from .spark_io import spread, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(spread(table(spark, sf_dir, "documents")))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.pack_documents(spread(table(spark, sf_dir, "documents")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.encode_documents(spread(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.find_toxic(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spread(table(spark, sf_dir, "documents")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(spread(table(spark, sf_dir, "documents")))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(posters.posters(spread(table(spark, sf_dir, "pages"))))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_report(spread(table(spark, sf_dir, "pages")), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(spread(table(spark, sf_dir, "documents")))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.jaccard_join(spread(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_token_ids, op3_bpe, op4_toxicity, op5_token_counts, op6_secrets, op7_media, op8_urls, op9_quality, op10_ngram_jaccard)}
ORACLE_SQL = {"op1_mixing": mixing.oracle(), "op8_urls": url_filter.oracle(), "op9_quality": quality.oracle()}
