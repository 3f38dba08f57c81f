"""Corpus pipeline: the stages, in order, that turn ``documents`` into training sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as a
table and read again as the next stage's ``docs``.  All but the last return the columns of
``documents``; the last returns one row for each document in the sequence files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import decontaminate, mixing, quality, similar, tokens
from corvid.llm.shared import read_table, stored, work_dir

#: Shares of the languages in the tokens of the mix.
LANGUAGE_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.12}


def labelled_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain): the documents of the labelled table with their language."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain"))
    return docs.join(read_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network rejects go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return similar.drop_near_duplicates(docs, n=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated until the languages have their target shares; none is lost."""
    return mixing.mix(docs, labelled_languages(spark, sf_dir), LANGUAGE_WEIGHTS, texts=read_table(spark, sf_dir, "documents"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become token ids in files of equal-length sequences."""
    return tokens.tokenize_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token ids", token_stage),
]

#: SQL cannot express the classifiers; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = work_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return docs
