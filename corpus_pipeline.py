"""A training-data pipeline: quality rules, near-copies, secrets, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but
the last return the columns of documents; the last returns doc_id with the
document's tokens and digests of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundloom.llm import bpe, mixing, quality, secrets, simhash
from groundloom.llm.common import kept, load


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or that boilerplate lines leave depleted, go; such lines go from the text of the others."""
    return quality.clean_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies the document with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return secrets.redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it, so a source has about its target of words."""
    return mixing.take(docs)


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and the digests of ids and of the text decoded from them; one row for each row of docs."""
    return bpe.round_trip(docs.select("doc_id", "text")).select("doc_id", "ids", *bpe.digests())


STAGES = [
    ("quality rules", quality_rules),
    ("near-copies", near_copies),
    ("secret scans", secret_scans),
    ("source mix", source_mix),
    ("byte pairs", byte_pairs),
]

#: Random rounding and byte-pair encoding have no SQL form. tests/llm checks the operators against brute force, and of the stages ids and counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids and digests of what the stages make of documents, one row for each row that the mix takes; empty tables give no rows."""
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept(docs, f"stage{k}")
    return docs
