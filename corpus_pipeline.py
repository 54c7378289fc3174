"""From raw documents to a training mix: each stage works on what the one before it kept, written as Parquet in between.

A null or empty text is a text like any other to the classifiers and to the search for duplicates, where all wordless texts are one group;
it has no word that could be contaminated, and the mix, which goes by words, takes it as often as every text of its source at least.
Rows with equal or null ids are rows
each: repeated rows are one group of duplicates, of which one stays; ties go to the smaller id, rows without an id last. All columns
of the documents, further ones among them, go through unchanged; the mix adds ``copy``, with underscores before it where the
documents have such a column. Without labels of both classes a classifier keeps all documents; an empty table gives an empty mix, and an
empty benchmark drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loglark.llm import decontaminate, mix, quality, simhash, toxicity
from loglark.llm.text import table
from loglark.session import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mixed(docs)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", no_near_duplicates),
    ("decontamination", not_contaminated),
    ("mix", to_weights),
]

#: SQL cannot express the classifiers; tests hold the pipeline against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
