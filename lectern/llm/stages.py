"""The pipeline's stages: (spark, docs, sf_dir) to the documents that go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, jaccard, langid, packing, pii
from lectern.llm.queries import vocabulary_path
from lectern.llm.storage import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters, and those of which no language has a third, go.

    A document with a notice or a quotation in another language is kept.
    """
    return langid.keep(docs, langid.train(docs, F.lit(True)), 0.34)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-gram Jaccard similarities of 0.8 connect."""
    return jaccard.keep(docs, 5, 0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked in their text."""
    return pii.mask(docs, pii.train(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 ids."""
    return packing.pack(docs, vocabulary_path(), 2048)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("sequences", sequences),
]
