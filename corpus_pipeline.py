"""Training-data pipeline over the table of documents.

Each stage is a function of (session, documents, folder of the tables). All but
the last return the columns of documents; what a stage returns is written as
Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lithomesh.llm import content_sort, jaccard_join, packing, quality, secrets
from lithomesh.plans.storage import materialise


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, does not reject.

    Null, empty and very long texts are scored like others, repeated rows alike; an
    empty table stays empty, and without labels of both kinds all rows stay.
    """
    ranker = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.good_documents(docs, ranker)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the largest id.

    Null and empty texts are equal; a null id loses to any other; of repeated rows one
    stays; an empty table stays empty.
    """
    return content_sort.distinct_documents(docs, keep="largest")


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Null and empty texts and null ids are in no group and stay; rows that repeat the
    smallest id all stay; an empty table stays empty.
    """
    return jaccard_join.group_firsts(docs)


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and ``n_chars`` set where a text changed.

    Null and empty texts stay as they are, repeated rows change alike; an empty table
    stays empty.
    """
    return secrets.redact(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, as ids, with their places in sequences.

    A null or empty text is one piece of one id; repeated rows are packed each; an
    empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("n-gram Jaccard join", unlike_documents),
    ("secret scans", redacted_documents),
    ("packing", packed_documents),
]

#: Tokenising and the classifier cannot be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
