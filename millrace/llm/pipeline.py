"""The corpus pipeline: five stages, each one an operator of this package.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before kept; all but the last return the columns of documents. run() writes each
stage's result to the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, common, mixing, neardup, pii, quality


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns outside its held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = common.unused("_score", docs.columns)
    scored = quality.classify(docs, labels, name=name)
    return scored.where(F.col(name) >= quality.THRESHOLD).drop(name)


def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five-word shingles, similarity 0.8): that of the smallest id."""
    return neardup.one_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; n_chars counts the masked text."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(docs, ("doc_id", "lang", "source"))


STAGES = [
    ("quality classifier", classify),
    ("near duplicates", dedupe),
    ("personal data", redact),
    ("source mix", mix),
    ("byte-level BPE", encode),
]

#: No SQL for the stages' models, hashes and merges; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
