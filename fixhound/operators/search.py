"""Pattern search over a corpus of files, for all seeds at once.

Hits are found once per distinct pattern, however many seeds share it, and are capped
before they meet the seeds. Seeds and files are therefore never multiplied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixhound.functions.grams import phrase, with_words
from fixhound.operators.patterns import PAIR, meet_grams
from fixhound.operators.spread import (
    durable,
    fits_broadcast,
    hot_key_join,
)

HITS_PER_PATTERN = 10
RUN_WORDS = 4


def hit_places(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """Places where a pattern occurs: `pattern, file_id, repo_name`.

    Patterns have any number of words in any case. They are looked up by their first two
    words, and the next two are compared on the spot. Only those that go on are compared
    with the words of the file; they come once per file. The lengths at hand are asked for
    first, so the corpus is read for those only.
    """
    split = with_words(patterns.select("pattern").distinct(), "pattern")
    keyed = split.select(
        F.array_join("words", " ").alias("pattern"),
        F.col("pattern").alias("full"),
        F.size("words").alias("n"),
    )
    singles, longest = keyed.agg(F.count_if(F.col("n") == 1), F.max("n")).first()
    parts = []
    if singles:
        parts.append(meet_grams(files, keyed.where("n = 1"), 1))
    if not singles or longest > 1:
        width = min(RUN_WORDS, max(PAIR, longest or 0))
        paired = meet_grams(files, keyed.where("n > 1"), PAIR, width=width)
        parts += _checked_to_the_end(paired, files) if (longest or 0) > RUN_WORDS else [paired]
    return union_hits(
        *[p.select(F.col("full").alias("pattern"), "file_id", "repo_name") for p in parts]
    )


def pattern_hits(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """Files that hold a pattern: `pattern, file_id, repo_name`, once per pair."""
    return hit_places(patterns, files).distinct()


def _checked_to_the_end(paired: DataFrame, files: DataFrame) -> list[DataFrame]:
    """Hits by the first words whose pattern the file holds to its last word."""
    paired = durable(paired.distinct())
    long = paired.where(F.col("n") > RUN_WORDS)
    texts = with_words(file_texts(long, files), "content").select(
        "file_id", phrase(F.col("words")).alias("text")
    )
    whole = F.concat(F.lit(" "), "pattern", F.lit(" "))
    checked = hot_key_join(long, texts, "file_id", "inner", ["full"])
    return [paired.where(F.col("n") <= RUN_WORDS), checked.where(F.col("text").contains(whole))]


def file_texts(hits: DataFrame, files: DataFrame, *columns: str) -> DataFrame:
    """`file_id`, `content` and further columns of the files that `hits` refers to.

    Each file comes once. `hits` should be durable: it is counted first, so that a small
    list goes to the scan and the other texts are never shuffled.
    """
    wanted = hits.select("file_id").distinct()
    if fits_broadcast(wanted):
        wanted = F.broadcast(wanted)
    return files.select("file_id", "content", *columns).join(wanted, "file_id", "left_semi")


def capped(places: DataFrame, limit: int = HITS_PER_PATTERN) -> DataFrame:
    """The first `limit` files of each pattern in file order, numbered from 1.

    Takes places, not files: a dense rank gives all places in a file the same number, and
    Spark applies its limit before the shuffle as well. A pattern found in a third of all
    files therefore sends only its first files from each task, and repeats go afterwards.
    """
    in_order = Window.partitionBy("pattern").orderBy("file_id")
    numbered = places.withColumn("hit_no", F.dense_rank().over(in_order))
    return numbered.where(F.col("hit_no") <= limit).distinct()


def seed_hits(
    patterns: DataFrame, files: DataFrame, limit: int = HITS_PER_PATTERN
) -> DataFrame:
    """Capped hits of every pattern of every seed, in list order of patterns and hits."""
    first = capped(hit_places(patterns, files), limit)
    return hot_key_join(patterns, first, "pattern", "inner", ["row_index"]).select(
        "row_index", "pattern_no", "pattern", "hit_no", "file_id", "repo_name"
    )


def union_hits(*sources: DataFrame) -> DataFrame:
    """All hits of several sources. The same file may come once per pattern."""
    merged = sources[0]
    for source in sources[1:]:
        merged = merged.unionByName(source)
    return merged
