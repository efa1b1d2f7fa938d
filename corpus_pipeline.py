"""Corpus pipeline: documents to packed training sequences, stage by stage.

Every stage is one operator of ``orderlens.llm`` over all that its predecessor kept; its
output is written as Parquet and read again as the next stage's input.  All stages but the
last return the columns of ``documents``.

1. quality rules: failing lines go, and documents that are rejected;
2. line dedup: lines that repeat an earlier line of the corpus go, documents stay;
3. SimHash near-dedup: one document of each component stays;
4. secret scans: secrets are replaced, documents stay;
5. packing: pieces of sequences with their ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import queries
from orderlens.llm.line_cleaning import clean_documents
from orderlens.llm.line_dedup import drop_repeated_lines
from orderlens.llm.secret_scan import redact_documents
from orderlens.llm.simhash_vptree import deduplicate_documents
from orderlens.llm.vector_packing import pack_documents
from orderlens.session import ensure_checkpoint_dir

END_ID = 0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate_documents(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, queries.tokenizer_file(queries.BYTE_BPE), END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

# The tokenizer, the fingerprints and the lexer are beyond SQL; tests hold the pipeline
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
