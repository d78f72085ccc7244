"""The corpus pipeline: five stages, each a DataFrame function of (spark, docs, sf_dir), written and read again in between.

All stages but the last return the columns of documents. Null texts count as empty; extra columns of documents stay as
they are, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pledgelens.llm.common import materialise
from pledgelens.llm.minhash import keep_one
from pledgelens.llm.mixing import keep_by_rate, label_domains
from pledgelens.llm.pieces import encode_and_decode
from pledgelens.llm.quality import fit_quality, score_quality
from pledgelens.llm.secrets import find_secrets, redact

#: SQL can express none of the learned and signature stages; tests/llm compare the stages with brute force on a small table.
ORACLE_SQL: str | None = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _shielded(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`stage` of doc_id and text, with all other columns under names that no operator uses; then all columns as before."""
    names = {c: c if c in ("doc_id", "text") else f"_column_{i}" for i, c in enumerate(docs.columns)}
    done = stage(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())))
    return done.select(*(F.col(n).alias(c) for c, n in names.items()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = fit_quality(docs.select("doc_id", "text"), _labels(spark, sf_dir))
    return _shielded(docs, lambda d: score_quality(d, model).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return _shielded(docs, keep_one)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; n_chars follows the text where it changes."""
    if "n_chars" not in docs.columns:
        return _shielded(docs, lambda d: redact(find_secrets(d)))
    at, kind = f"_column_{docs.columns.index('n_chars')}", docs.schema["n_chars"].dataType
    return _shielded(docs, lambda d: redact(find_secrets(d)).withColumn(at, F.when(F.size("spans") > 0, F.length("text").cast(kind)).otherwise(F.col(at))))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay by their fitted rates."""
    return _shielded(docs, lambda d: keep_by_rate(d, label_domains(_labels(spark, sf_dir))))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids of each document and the SHA-256 of the text that they decode to."""
    done = encode_and_decode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing to target weights", mixture),
    ("SentencePiece encoding and decoding", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
