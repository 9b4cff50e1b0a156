"""The queries of this subpackage over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, dedup, embedding_links, language, pages, periodic_runs, piece_counts, pitman_yor, quality, token_files, toxicity
from .checks import CHECKS as CHECKS


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(folds: int, one: int) -> Column:
    """Whether the CRC-32 of the id as text falls into fold `one` of `folds`; never null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == one, F.lit(False))


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language.fit(docs.where(~_fold(3, 1)))
    predicted = language.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", _fold(3, 1).alias("held_out"), "lang_pred", "score")


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = pitman_yor.score(docs.select("doc_id", "text", (~_fold(7, 2)).alias("train")))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op4_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(_read(spark, sf_dir, "documents"))


def op5_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_read(spark, sf_dir, "pages"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.classes(_read(spark, sf_dir, "documents"))


def op8_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    judged = quality.judge(docs.select("doc_id", "text"), quality.references(docs))
    return judged.drop("text")


def op9_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.token_counts(_read(spark, sf_dir, "documents"))


def op10_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~_fold(4, 2)))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        _fold(4, 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
        "passages",
    )


def _id_hash() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; the words of a tenth of the texts, by id, become periodic from some word on."""
    planted = _id_hash() % 10 == 0
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = docs.select("doc_id", "text", F.when(planted, words).alias("words"), F.floor(_id_hash() / 10).cast("bigint").alias("g"))
    n = F.size("words").cast("bigint")
    at = split.withColumn("at", F.when(n > 0, F.col("g") % n))
    period = F.lit(1) + F.floor((n - F.col("at")) / (F.lit(3) + F.col("g") % 8)).cast("bigint")
    repeated = F.transform(F.col("words"), lambda w, i: F.when(i < F.col("at"), w).otherwise(F.get(F.col("words"), (F.col("at") + (i - F.col("at")) % F.col("period")).cast("int"))))
    return at.withColumn("period", period).select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.detect(with_repeats(_read(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("least"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    first = found.select("doc_id", "n_words", "runs", "collapsed", longest.alias("r"))
    return first.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("r.before")).alias("start"),
        F.col("r.length").alias("length"),
        (-F.col("r.least")).alias("period"),
        F.floor(F.lit(1000) * F.col("r.length") / -F.col("r.least")).cast("bigint").alias("exponent_milli"),
        digest(F.array_join(lines, "")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
        "n_words",
    )


def op12_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_links.link_classes(_read(spark, sf_dir, "embeddings"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return found.select("vec_id", "n_links", "component_id", kept.alias("kept"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.best_phrases(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_benchmark_leaks, op2_language_id, op3_pitman_yor, op4_wavelet_files, op5_page_texts, op6_bpe_round_trip, op7_near_duplicates, op8_quality_divergence, op9_piece_counts, op10_toxic_passages, op11_periodic_runs, op12_embedding_links, op13_collocations)
}
