"""The corpus pipeline: five stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import decontaminate, jaccard, langid, linededup, mixing
from lattica.llm.common import stage


#: Below one half the machines speak rather against the language they name; texts of two languages that score more stay.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language that scores ``LEAST_SCORE`` or more; a text without a letter has none.

    Every stage takes nulls in any column, empty tables, repeated rows, texts
    of any length and further columns of any name; what they do with them is
    told in the module of their operator.
    """
    return langid.identify(docs, langid.train(docs), keep=docs.columns, least_score=LEAST_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, alike, earlier in the corpus; one that loses all its lines goes."""
    return linededup.apply(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id; those without words all stay."""
    return jaccard.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages; one without words is clean."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources by target weights, one row for each copy; null sources are one, and texts without words are taken like others."""
    return mixing.emit(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("mixture", mixture)]

#: Language models, MinHash lines and winnowing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with a written table between any two."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(spark, step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
