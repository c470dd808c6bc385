"""The corpus pipeline: documents pass five stages, each written as Parquet and read again as the next one's input.

Rows of run(): (doc_id, n_tokens, token_ids, round_trip) of each document that the first four stages keep.

Defined cases, for every stage: an empty table gives an empty result; columns besides those of documents go along, whatever
their names, up to the last stage; a null doc_id is kept and never has a near copy; null and empty texts go in the first stage (given
to another one alone they have no near copies, no secrets and no tokens); of rows with the same doc_id and text one stays; of a group of near copies the least doc_id stays,
then the least hash of its text; rows that share a doc_id go through the mix together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import lexicon, mixing, near_copies, quality, secrets
from siftwell.llm.spark_io import shared_folder, spread, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents outside their language's and source's bounds go; a null language or source counts as '', null and empty texts go."""
    return quality.quality_filter(spread(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each connected group of near copies stays, the one of the least doc_id."""
    return near_copies.near_filter(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: secrets are masked in the texts; no document goes."""
    return secrets.redact(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: over-represented sources are thinned to their share."""
    return mixing.mix_filter(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: texts become token ids, decoded again as a check."""
    return lexicon.encode_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_to_weights),
    ("BPE encoding and decoding", bpe_encoding),
]
#: The secret scan and the encoding can't be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage keeps is written to the shared folder, and read from there until the next one is.

    The last such table stays, as the result reads it: remove pipeline-* from the folder when the result has been written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:  # the stage before last is no longer read
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return docs
