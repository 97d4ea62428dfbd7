"""The training corpus as a pipeline of stages over ``documents``.

Each stage reads what the one before it kept, as Parquet. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.llm import langid, neardup, packing, quality, substrings
from edgewright.llm.common import dropped, scratch, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified rules reject go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that the corpus's labels teach, go."""
    return langid.keep(docs, langid.training_rows(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, similar by 0.8 or more, the document with the smallest id stays."""
    return neardup.keep(docs, similarity=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that a document with a smaller id has go from the text; n_chars follows, and no document does."""
    return substrings.without_repeats(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of fixed length."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", packed),
]

#: Certified thresholds and token ids are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; of what they store on the way, only the result stays."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last = docs
        with scratch(lambda: docs):
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(last)
    return docs
