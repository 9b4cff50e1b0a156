"""The jobs' tables as projections of the test tables.

`orders` stands for fixes and commits, `lineitem` for file changes, `customer` for CVEs and
their classes; `benchmark` for seeds, `documents` for files, their source for the
repository, `labels` for what is known of files, `events` for commits of files.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixhound.operators.search import file_texts
from fixhound.operators.spread import shared_folder
from fixhound.plans.matching import Inputs
from fixhound.sources.pair_index import PairIndex

# The report's filter values in terms of the test tables.
REPORT_FILTERS = {"language": "R", "cwe_id": "BUILDING", "min_score": 55}


# The test tables' columns, so that no job is spent on looking at files first.
SCHEMAS = {
    "benchmark": "item_id BIGINT, text STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "customer": "c_custkey BIGINT, c_mktsegment STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "lineitem": "l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_returnflag STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, "
    "o_orderpriority STRING",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def fix_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders = load(spark, sf_dir, "orders")
    customer = load(spark, sf_dir, "customer")
    return {
        "file_change": load(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("hash"),
            F.col("l_linenumber").alias("filename"),
            F.col("l_quantity").alias("num_lines_added"),
            F.col("l_returnflag").alias("programming_language"),
        ),
        "commits": orders.select(F.col("o_orderkey").alias("hash")),
        "fixes": orders.select(
            F.col("o_custkey").alias("cve_id"),
            F.col("o_orderkey").alias("hash"),
            F.col("o_orderpriority").alias("repo_url"),
            (F.col("o_totalprice") / 5000).alias("score"),
        ),
        "cve": customer.select(F.col("c_custkey").alias("cve_id")),
        "cwe_classification": customer.select(
            F.col("c_custkey").alias("cve_id"), F.col("c_mktsegment").alias("cwe_id")
        ),
    }


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as sheet rows without results; the sheet has no column for the type."""
    return load(spark, sf_dir, "benchmark").select(
        (F.col("item_id") + 2).alias("row_index"),
        F.concat(F.lit("CVE-"), F.col("item_id").cast("string")).alias("cve_id"),
        F.col("text").alias("code"),
        F.lit("").alias("found"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("repo_name"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"),
        F.col("text").alias("content"),
    )


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as a second corpus."""
    return load(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("file_id"),
        F.col("role").alias("repo_name"),
        F.col("text").alias("content"),
    )


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars are the text lengths of a source; it is flagged if more than a fifth of its
    labelled documents are. One aggregation for both."""
    documents = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labels = load(spark, sf_dir, "labels").select("doc_id", "toxic")
    return (
        documents.join(labels, "doc_id", "left")
        .groupBy(F.col("source").alias("repo_name"))
        .agg(
            F.sum("n_chars").alias("stars"),
            (5 * F.sum("toxic") > F.count("toxic")).alias("flagged"),
        )
    )


def readmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of a source is its README, its language the description.

    The first number is found on two narrow columns; only the texts so named are kept, so
    no text takes part in an aggregation.
    """
    documents = load(spark, sf_dir, "documents")
    first = documents.groupBy("source").agg(F.min("doc_id").alias("file_id"))
    named = documents.select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("repo_name"),
        F.col("text").alias("content"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("description"),
    )
    return file_texts(first, named, "repo_name", "description").select(
        "repo_name", "description", F.col("content").alias("readme")
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user are the commits of the file with the same number."""
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"),
        F.col("event_id").alias("commit_id"),
        F.col("event_id").cast("string").alias("sha"),
        F.col("ts").alias("committed_at"),
    )


def plain_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(
        seeds(spark, sf_dir),
        files(spark, sf_dir),
        repos(spark, sf_dir),
        commits(spark, sf_dir),
    )


# Of each session and folder of tables: patterns and index belong to their corpus and serve all queries.
_PATTERNS: dict[tuple[str, str], DataFrame] = {}
_INDEXES: dict[tuple[str, str], PairIndex] = {}


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """The tables with the seeds' patterns, which are taken from the corpus when first asked for
    and kept as a table; `plain_inputs` takes them anew."""
    plain = plain_inputs(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PATTERNS:
        _PATTERNS[key] = plain.patterns()
    return replace(plain, given_patterns=_PATTERNS[key])


def corpus_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The corpus as it arrives: two thirds of the files, then the others."""
    whole = files(spark, sf_dir)
    return [whole.where("file_id % 3 > 0"), whole.where("file_id % 3 = 0")]


def new_index(spark: SparkSession, name: str) -> PairIndex:
    return PairIndex(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def index(spark: SparkSession, sf_dir: str) -> PairIndex:
    """The stored index of the corpus, built when it is first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        built = new_index(spark, "pair-index")
        for part in corpus_parts(spark, sf_dir):
            built.append(part)
        _INDEXES[key] = built
    return _INDEXES[key]
