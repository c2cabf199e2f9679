"""The corpus pipeline: quality, near duplicates, benchmark leaks, personal data, tokens.

Each stage works on all that its predecessor kept; stages are written as Parquet and read again. Null or empty texts are
documents like others (the classifier scores them); rows that share a doc_id are judged as each stage's operator defines.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrapanel.llm import bpe, decontamination, pii, quality, simhash_golay
from terrapanel.llm.common import shared_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant scores at 0.5 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingle sets with a cosine similarity of 0.8 or more."""
    return simhash_golay.drop_near_duplicates(docs, measure="cosine")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it replaced."""
    return pii.redact(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with digests of ids and decoded text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digest(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_discriminant", keep_quality),
    ("simhash_near_dedup", drop_copies),
    ("benchmark_decontamination", drop_leaks),
    ("pii_sanitisation", redact),
    ("byte_bpe", tokenise),
]

#: The stages aren't expressible in SQL (a fitted model, fingerprints, BPE); they are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = table(spark, sf_dir, "documents")
    base = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return done
        done.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(done.schema).parquet(f"{base}/{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
