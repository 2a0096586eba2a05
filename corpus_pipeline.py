"""A corpus pipeline: language ID, near-duplicate removal, secret redaction, source mixing, packing.

Defined cases: null, empty and white texts have no letters and go in the first stage; very long texts are read whole by all;
rows that repeat are one document from the second stage on, told by doc_id and text; a null doc_id is a document like others; ties go to the
least doc_id; an empty table gives no rows; other columns, whatever their names, are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import jaccard, language, mixing, packing, secrets
from tideline.llm.common import stored
from tideline.llm.tokens import default_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or a clear language go."""
    return language.reject_unclear(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents of five-word shingle similarity 0.8 or more, the one with the least doc_id stays."""
    return jaccard.keep_first(docs, k=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, more than once if need be, to their sources' target weights."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and the sequences they are packed in."""
    return packing.pack(docs, default_path())


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: Tokenizing, character models and hash thresholds cannot be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
