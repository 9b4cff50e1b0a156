"""A corpus from raw documents: five stages, each written as Parquet before the next one reads it.

Quality rules, language identification, near-duplicate removal, benchmark decontamination, then
encoding. The first four return rows of `documents` as they came in, with whatever other columns these
have; the last one returns ids and what they decode to as digests. Rows with a null or empty text
fail the quality rules. Rows without an id, or that share one, are judged each by its own text; of
repeated rows one is left. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixhound.llm import bpe, decontaminate, dedup, language, quality
from fixhound.llm.stores import written

#: A document whose language is less sure than this is rejected.
SURE = 0.5


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """Every row whole in `row`, where its columns clash with none of a stage, beside those a stage reads."""
    return docs.select(F.struct("*").alias("row"), *columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't far from every language's usual text."""
    judged = quality.judge(_packed(docs, "text"), quality.references(docs))
    # written, since the verdict has many steps and a filter would be computed beside each of them
    return written.table(judged.select("row", "kept"), "verdicts").where("kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known.

    The classifier is fitted on the documents that came this far.
    """
    named = language.predict(_packed(docs, "text"), language.fit(docs))
    fits = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE)
    return named.where(fits).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one that the class is named after."""
    return dedup.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows get a number, so one goes for its own text, whether or not it has an id or shares it.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = written.table(_packed(docs, "text").withColumn("doc_id", F.monotonically_increasing_id()), "numbered")
    leaked = written.table(decontaminate.contaminated(rows, items).select("doc_id").distinct(), "leaks")
    return rows.join(leaked, "doc_id", "left_anti").select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids, and digests of the ids and of the decoded text."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("encoding", encoding),
]

#: SQL can't express the later stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written.table(stage(spark, docs, sf_dir), name)
    return docs
