"""Which files hold a seed's text, wholly or in large part.

The measure is the share of the seed's distinct word shingles that a file holds. It suits
short seeds and long files better than Jaccard's, which is given as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixhound.functions.grams import SHINGLE_WORDS, distinct_ngrams, with_words
from fixhound.operators.patterns import meet_grams
from fixhound.operators.search import file_texts
from fixhound.operators.spread import durable, hot_key_join


def seed_sets(seeds: DataFrame) -> DataFrame:
    """Distinct shingle sets of the seeds. Copies become one row with their number."""
    split = with_words(seeds.select("row_index", "code"), "code")
    return (
        split.select(
            "row_index",
            F.array_sort(distinct_ngrams(F.col("words"), SHINGLE_WORDS)).alias("shingles"),
        )
        .where(F.size("shingles") > 0)
        .groupBy("shingles")
        .agg(F.min("row_index").alias("seed"), F.count("*").alias("n_seeds"))
    )


def prefix_rows(sets: DataFrame, min_share: float) -> DataFrame:
    """The shingles by which a set must be looked up: `seed, pattern`.

    A file that holds at least t = ceil(min_share * n) of n shingles misses at most n - t,
    so it holds one of any n - t + 1. The ones that fewest seeds have are taken: text common
    to many seeds is left out, and no match is lost.
    """
    rows = sets.select("seed", F.size("shingles").alias("n"), F.explode("shingles").alias("pattern"))
    shared_by = rows.groupBy("pattern").agg(F.count("*").alias("n_sets"))
    rarest_first = Window.partitionBy("seed").orderBy("n_sets", "pattern")
    needed = F.col("n") - F.ceil(F.col("n") * F.lit(min_share)) + 1
    return (
        hot_key_join(rows, shared_by, "pattern", "inner", ["seed"])
        .withColumn("place", F.row_number().over(rarest_first))
        .where(F.col("place") <= needed)
        .select("seed", "pattern")
    )


def similar_pairs(seeds: DataFrame, files: DataFrame, min_share: float = 0.5) -> DataFrame:
    """All pairs of a distinct seed text and a distinct file text above the share.

    Copies on either side stand as one text, named by its lowest number, with a count; a
    text copied a million times is compared once and yields one row.
    """
    sets = durable(seed_sets(seeds))
    digested = files.withColumn("digest", F.sha2("content", 256))
    met = meet_grams(digested, prefix_rows(sets, min_share), SHINGLE_WORDS, "digest")
    candidates = durable(
        met.select("seed", "file_id", "digest")
        .distinct()
        .groupBy("seed", "digest")
        .agg(F.min("file_id").alias("file_id"), F.count("*").alias("n_files"))
        .drop("digest")
    )
    texts = with_words(file_texts(candidates, files), "content").select(
        "file_id", distinct_ngrams(F.col("words"), SHINGLE_WORDS).alias("file_shingles")
    )
    compared = hot_key_join(candidates, texts, "file_id", "inner", ["seed"])
    shared = F.size(F.array_intersect("shingles", "file_shingles"))
    return (
        hot_key_join(compared, sets, "seed", "inner", ["file_id"], sample=candidates)
        .select(
            F.col("seed").alias("row_index"),
            "n_seeds",
            "file_id",
            "n_files",
            shared.alias("shared"),
            F.size("shingles").alias("seed_shingles"),
            F.size("file_shingles").alias("file_shingles"),
        )
        .where(F.col("shared") >= F.col("seed_shingles") * F.lit(min_share))
        .withColumn("share", F.col("shared") / F.col("seed_shingles"))
        .withColumn(
            "jaccard",
            F.col("shared")
            / (F.col("seed_shingles") + F.col("file_shingles") - F.col("shared")),
        )
    )
