"""From raw documents to packed training sequences, in five stages.

Every stage takes what the one before it kept, written as Parquet and read again; all but the last return the
columns of ``documents``.  Every row is a document of its own in all of them, also under a null or repeated doc_id; columns of
any name travel along, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorebook.llm import jaccard_join, packing, quality_gam, quality_rules, suffix_dedup
from scorebook.llm.common import read_table, stage
from scorebook.llm.queries import tokenizer_file


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, trained on the labelled ones among them, rejects go.  Null and empty texts are scored
    like any other; equal texts share their score."""
    return quality_gam.keep_documents(docs, read_table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's and source's robust ellipsoid go.  Null and empty texts
    have no words and go; a null language or source is one of its own; equal rows share their verdict."""
    return quality_rules.keep_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the least doc_id stays, nulls
    first: one row of each group.  Texts without words are in no group and stay."""
    return jaccard_join.one_of_each(docs, size=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are taken out of the texts.  No row goes; null texts stay null."""
    return suffix_dedup.dedup_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 ids; a null or empty text is one piece of one id."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("jaccard_join", near_copies),
    ("suffix_dedup", repeated_strings),
    ("best_fit_packing", packed),
]

#: The trained model and the packing cannot be written in SQL; tests/llm/test_joins.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep of ``documents``.  Staged tables lie in the shared checkpoint folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
