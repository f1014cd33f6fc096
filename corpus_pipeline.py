"""A corpus made ready for training: five stages, each over all that the stage before it kept.

Cases, for every stage: a null or empty text has no language and goes in the first stage, as do texts without a letter;
ties are settled by doc_id and then by a hash of the text, so results don't hang on the order of rows; of rows that repeat a
doc_id with equal text one stays, and with other texts each is judged by its own; a null doc_id is the last choice to stay;
very long texts are read whole, in blocks; an empty table gives no rows; further columns go through the
first four stages unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrivena.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing
from scrivena.plans.staging import stage
from scrivena.sources.tables import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go.  Ambiguous ones stay."""
    return language_id.with_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for the case of A-Z: the largest doc_id."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, texts that links of 0.8 or more on five words connect: the least doc_id."""
    return jaccard_join.one_of_each_class(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in the benchmark; all, if that is empty."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bucket, batch and slot; a long document has several pieces."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_duplicates", near),
    ("decontamination", benchmark),
    ("packing", packing_plan),
]

#: SQL can express neither the language classifier nor the optimal buckets; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each returns is written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
