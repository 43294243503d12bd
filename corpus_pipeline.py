"""A training corpus from ``documents`` in five stages: language, near copies, benchmark leaks, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept, and returns a
DataFrame; all but the last return the columns of ``documents``.  Between two stages the rows are written
as Parquet and read again, so a lost executor repeats one stage at most.

Defined cases: every stage takes nulls in any column, empty and very long texts, repeated rows and
an empty table, as its operator's module says; columns beyond those of ``documents`` pass through all
stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, ngram_join, packing, secrets, workspace


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no language: null text and texts without a letter.

    The classifier learns from documents that are not held out; an ambiguous document is kept.
    """
    model = language.fit(docs.filter(~language.held_out()))
    return language.predict(docs, model).filter("lang_pred != 'und'").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return ngram_join.first_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows the text."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document, with its ids."""
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("ngram_join", one_of_each),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: A trained classifier, a randomised match and a tokenizer can't be written in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = workspace.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
