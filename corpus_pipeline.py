"""Corpus pipeline: quality rules, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept. Stages but the last return
the columns of documents: rejected documents go and the others lose their boilerplate lines, one document
of each group of near duplicates (five words, similarity 0.8 or more) stays, and personal data is masked
in the text.

Cases: null and empty texts fail the quality rules and go; rows that are there twice are near
duplicates; null ids and sources are kept as they are; other columns go along; an empty table gives no
sequences. docs should be a stored table, as the stages' outputs are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from supplylens.llm import jaccard, packing, pii, quality
from supplylens.llm.common import durable, forget, read

WORDS, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, length_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, WORDS, PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs, length_col="n_chars")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("best-fit packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = durable(stage(spark, docs, sf_dir), f"stage{k}")
        forget(*before)
        before = [docs]
    return docs


#: Weak supervision and packing can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
