"""Search patterns: from seed texts, and from captured pattern lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixhound.functions.grams import (
    distinct_ngrams,
    exploded_ngrams,
    gram_columns,
    ngrams,
    with_words,
)
from fixhound.functions.text import MAX_PATTERNS, listed_text, strip, unfenced
from fixhound.operators.spread import (
    fits_broadcast,
    hot_key_join,
    spread_join,
    spread_scan,
)

PAIR = 2
GRAM_SALTS = 16


def with_pattern_list(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Add `patterns`: at most five from a JSON list; any other reply is an empty list.

    The reply is read inside one more pair of brackets, so text after the list makes the
    whole reply invalid. Each step is a column of its own and is computed once.
    """
    kept = replies.columns
    text = replies.withColumn("_text", strip(F.col(reply)))
    split = text.withColumn("_lines", F.split("_text", "\n"))
    body = split.select(*kept, unfenced(F.col("_text"), F.col("_lines")).alias("_body"))
    wrapped = body.select(*kept, F.concat(F.lit("["), "_body", F.lit("]")).alias("_json"))
    read = wrapped.select(
        *kept,
        F.from_json(
            "_json", "array<array<string>>", {"allowSingleQuotes": "false"}
        ).alias("_lists"),
        F.try_variant_get(F.try_parse_json("_json"), "$[0]", "array<variant>").alias("_values"),
    )
    items = F.arrays_zip(
        F.slice(F.get("_lists", F.lit(0)), 1, MAX_PATTERNS).alias("text"),
        F.slice("_values", 1, MAX_PATTERNS).alias("value"),
    )
    is_list = (F.size("_lists") == 1) & F.col("_values").isNotNull()
    listed = F.when(is_list, F.transform(items, listed_text))
    return read.select(
        *kept, F.coalesce(listed, F.array().cast("array<string>")).alias("patterns")
    )


def pattern_rows(lists: DataFrame, patterns: str = "patterns") -> DataFrame:
    """One row per list item, numbered from 1 in list order.

    The outer form keeps Spark from computing the list a second time to test its size.
    """
    rows = lists.select("row_index", F.posexplode_outer(patterns).alias("_at", "pattern"))
    return rows.where(F.col("pattern").isNotNull()).select(
        "row_index", (F.col("_at") + 1).alias("pattern_no"), "pattern"
    )


def captured_patterns(replies: DataFrame) -> DataFrame:
    """Patterns of captured replies `(row_index, reply)`."""
    return pattern_rows(with_pattern_list(replies))


def seed_patterns(seeds: DataFrame, files: DataFrame, limit: int = MAX_PATTERNS) -> DataFrame:
    """What a seed is searched by: the rarest word pairs of its whole text, or its only word.

    Headers and licenses that many files hold are thus passed over, wherever they stand.
    """
    words = with_words(seeds.select("row_index", "code"), "code").where(F.size("words") == 1)
    single = words.select(
        "row_index", F.lit(1).alias("pattern_no"), F.get("words", F.lit(0)).alias("pattern")
    )
    return rare_seed_patterns(seeds, files, limit).drop("n_files").unionByName(single)


def seed_phrases(seeds: DataFrame, n: int) -> DataFrame:
    """All runs of n words of a seed, in reading order."""
    split = with_words(seeds.select("row_index", "code"), "code")
    return pattern_rows(split.select("row_index", ngrams(F.col("words"), n).alias("patterns")))


def meet_grams(
    files: DataFrame,
    keyed: DataFrame,
    n: int = PAIR,
    keep: str = "repo_name",
    width: int | None = None,
) -> DataFrame:
    """Join the n-word runs of whole files to `keyed`, a seed-sized frame.

    The column `pattern` of `keyed` holds at least n words between single spaces. Its first
    n words are joined on; those up to `width` are compared as well. The result has
    `file_id`, `keep` and the columns of `keyed`, as often as the run occurs in the file.

    A measured, small `keyed` goes to the files, and no word of the corpus is shuffled. A
    larger one meets them in a shuffle in which every run is spread over salts, since
    common word pairs occur in a large part of all files. Only narrow columns ride along;
    the text stays behind in the scan stage.
    """
    columns = gram_columns(width or n)
    on, rest = columns[:n], columns[n:]
    texts = spread_scan(files.select("file_id", keep, "content"))
    runs = exploded_ngrams(texts, "content", len(columns))
    parts = F.split("pattern", " ")
    split = keyed.select(
        "*",
        *[F.get(parts, i).alias(w if w in on else f"_{w}") for i, w in enumerate(columns)],
    )
    if fits_broadcast(keyed, "pattern"):
        met = runs.join(F.broadcast(split), on)
    else:
        met = spread_join(runs, split, on, ["file_id"], GRAM_SALTS)
    for word in rest:
        met = met.where(F.col(f"_{word}").isNull() | (F.col(f"_{word}") == F.col(word)))
    return met.select("file_id", keep, *keyed.columns)


def file_counts(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """In how many files each wanted word pair occurs: `pattern, n_files`.

    The pairs of seeds include the commonest ones, so most of the corpus takes part. A file
    drops its repeats before its pairs are unfolded, and all that is shuffled is one count
    per pair and task.
    """
    texts = with_words(spread_scan(files.select("file_id", "content")), "content")
    pairs = texts.select(F.explode(distinct_ngrams(F.col("words"), PAIR)).alias("pattern"))
    keys = wanted.select("pattern").distinct()
    count = F.count("*").alias("n_files")
    if fits_broadcast(keys, "pattern"):
        return pairs.join(F.broadcast(keys), "pattern").groupBy("pattern").agg(count)
    return pairs.groupBy("pattern").agg(count).join(keys, "pattern", "left_semi")


def rare_seed_patterns(
    seeds: DataFrame, files: DataFrame, limit: int = MAX_PATTERNS
) -> DataFrame:
    """The `limit` word pairs of a seed that occur in the fewest files, rarest first.

    Pairs found in no file are left out, as a search for them finds nothing. Equal counts
    keep reading order.
    """
    split = with_words(seeds.select("row_index", "code"), "code")
    own = split.select(
        "row_index",
        F.posexplode(distinct_ngrams(F.col("words"), PAIR)).alias("at", "pattern"),
    )
    rarest_first = Window.partitionBy("row_index").orderBy("n_files", "at")
    return (
        hot_key_join(own, file_counts(files, own), "pattern", "inner", ["row_index"])
        .withColumn("pattern_no", F.row_number().over(rarest_first))
        .where(F.col("pattern_no") <= limit)
        .select("row_index", "pattern_no", "pattern", "n_files")
    )
