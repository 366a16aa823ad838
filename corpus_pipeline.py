"""A corpus pipeline of five stages over ``documents``; part of hitlake.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again as the
next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlake.lineage import remove, shared_folder
from hitlake.llm import decontaminate, jaccard, language, packing, substrings
from hitlake.llm.text import table
from hitlake.shipping import ship

LEAST_SCORE = 0.05
NEAR = jaccard.Rule(k=5, percent=80)
PASSAGE = 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those with no letters or near no language's profile go."""
    ship(spark)
    return language.accepted(docs, language.learn(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near duplicates; rows that repeat an id stay or go together."""
    ship(spark)
    found = jaccard.classes(docs, NEAR)
    others = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of PASSAGE words or more that stand in an earlier one; empty ones go."""
    ship(spark)
    return substrings.strip(docs, PASSAGE).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    ship(spark)
    leaks = decontaminate.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All ids of all documents in power-of-two pieces."""
    ship(spark)
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("packing", pack)]

#: SQL does not express the tokenizer and the language profiles; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's rows; what lies between stages is in the cluster's shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    last = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove(spark, f"{folder}/{last}")  # what a later stage has taken in is read no more
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
