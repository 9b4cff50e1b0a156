"""Code copied with other names: winnowed fingerprints of texts whose identifiers are folded.

A text becomes tokens: words, numbers, single other signs. The words that most files hold, such as a
language's keywords and common calls, stay; every other word becomes one mark, every number another, so
renaming changes nothing. Each run of RUN tokens is hashed, and of every WINDOW neighbouring hashes the
least is a fingerprint. Two texts with RUN + WINDOW - 1 folded tokens in common share one.

The corpus is read twice, for its words and for its prints. Prints are written once; everything after
works on them, never on texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixhound.operators.spread import durable, fits_broadcast, hot_key_join

WORD = r"[\p{L}_][\p{L}\p{N}_]*"
TOKEN = WORD + r"|\p{N}+|[^\p{L}\p{N}_\x09-\x0D\x20]"
#: How many words stay as they are; they are sent to all tasks.
KEPT_WORDS = 500
RUN = 8
WINDOW = 6
MIN_SHARE = 0.5


def common_words(files: DataFrame, limit: int = KEPT_WORDS) -> list[str]:
    """The `limit` words that most files hold, ties by word."""
    found = F.array_distinct(F.regexp_extract_all("content", F.lit(WORD), F.lit(0)))
    held = files.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n_files"))
    return [row.word for row in held.orderBy(F.desc("n_files"), "word").limit(limit).collect()]


def _folded(token: Column, kept: list[str]) -> Column:
    return (
        F.when(token.isin(kept), token)
        .when(token.rlike(r"^\p{N}"), F.lit("0"))
        .when(token.rlike(r"^[\p{L}_]"), F.lit("v"))
        .otherwise(token)
    )


def _hashed(run: Column) -> Column:
    return F.conv(F.substring(F.md5(run), 1, 15), 16, 10).cast("bigint")


def _joined(df: DataFrame, name: str, shift: int, join) -> DataFrame:
    """Each item joined with that `shift` places on; as many fewer items.

    Whole lists are moved at a time: cutting a piece out for every place would copy the list as often.
    """
    count = F.greatest(F.size(name) - F.lit(shift), F.lit(0))
    paired = F.zip_with(F.slice(name, F.lit(1), count), F.slice(name, F.lit(shift + 1), count), join)
    return df.withColumn(name, paired)


def with_prints(df: DataFrame, text: str, kept: list[str]) -> DataFrame:
    """Replace `text` by `n_tokens` and `prints`, its distinct fingerprints in ascending order.

    Null and blank texts have no token and no print. A text below RUN tokens is one run, one below
    RUN + WINDOW - 1 tokens one window. Runs of 8 are put together from those of 2 and 4, windows
    of 6 from those of 2 and 4.
    """
    others = [c for c in df.columns if c != text]
    read = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    folded = df.select(*others, F.transform(read, lambda t: _folded(t, kept)).alias("_tokens"))
    runs = folded.select(*others, F.size("_tokens").alias("n_tokens"), "_tokens", F.col("_tokens").alias("_runs"))
    for shift in (1, 2, 4):
        runs = _joined(runs, "_runs", shift, lambda left, right: F.concat(left, F.lit(" "), right))
    short = F.when(F.col("n_tokens") > 0, F.array(F.array_join("_tokens", " "))).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.col("n_tokens") >= RUN, F.col("_runs")).otherwise(short)
    hashed = runs.select(*others, "n_tokens", F.transform(whole, _hashed).alias("_runs"))
    least = hashed.withColumn("_least", F.col("_runs"))
    for shift in (1, 2, 2):
        least = _joined(least, "_least", shift, lambda left, right: F.least(left, right))
    single = F.slice(F.array_sort("_runs"), 1, 1)
    prints = F.when(F.size("_runs") >= WINDOW, F.array_sort(F.array_distinct("_least"))).otherwise(single)
    return least.select(*others, "n_tokens", prints.alias("prints"))


def file_prints(files: DataFrame, kept: list[str]) -> DataFrame:
    """`file_id, n_tokens, prints` of all files."""
    return with_prints(files.select("file_id", "content"), "content", kept)


def _distinct_sets(prints: DataFrame, key: str, name: str, count: str) -> DataFrame:
    """Texts with the same prints are one: `name` (the least key), `count`, `prints`.

    `prints` is durable: a condition on prints that are yet to be made would be moved below each of
    their steps, with a copy of all that goes before.
    """
    texts = prints.where(F.size("prints") > 0)
    digests = texts.select(key, F.sha2(F.array_join("prints", " "), 256).alias("digest"))
    heads = digests.groupBy("digest").agg(F.min(key).alias(key), F.count("*").alias(count)).drop("digest")
    return heads.join(texts.select(key, "prints").dropDuplicates([key]), key).withColumnRenamed(key, name)


def _met(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """Rows `(file_id, print)` of the corpus with the few rows of the seeds for their print."""
    if fits_broadcast(keyed):
        return rows.join(F.broadcast(keyed), "print")
    return hot_key_join(rows, keyed, "print", "inner", ["file_id"])


def renamed_copies(seeds: DataFrame, files: DataFrame, kept: list[str] | None = None, min_share: float = MIN_SHARE) -> DataFrame:
    """Pairs of a seed and a file that holds at least `min_share` of its fingerprints.

    `row_index, n_seeds, file_id, n_files, shared, seed_prints, file_prints, share`: texts with the
    same prints stand as one, named by the lowest number, with their count. Row numbers and file ids are
    distinct; seeds without a token match nothing.

    A file that lacks too many prints is never looked at: of n prints, those that fewest files hold are
    looked up, one more than a match may lack (prefix filter), so prints that very many files hold
    are met only where a seed has no others.
    """
    words = common_words(files) if kept is None else kept
    prints = durable(file_prints(files, words))
    sets = durable(_distinct_sets(prints, "file_id", "file_id", "n_files"))
    asked_for = durable(with_prints(seeds.select("row_index", "code"), "code", words))
    own = durable(_distinct_sets(asked_for, "row_index", "seed", "n_seeds"))
    rows = sets.select("file_id", F.explode("prints").alias("print"))
    asked = own.select("seed", F.size("prints").alias("n"), F.explode("prints").alias("print"))
    held = _met(rows, asked.select("print").distinct()).groupBy("print").agg(F.count("*").alias("n_files"))
    order = Window.partitionBy("seed").orderBy("n_files", "print")
    needed = F.col("n") - F.ceil(F.col("n") * F.lit(min_share)) + 1
    rare = asked.join(held, "print", "left").fillna(0, ["n_files"]).withColumn("place", F.row_number().over(order))
    looked_up = durable(rare.where((F.col("place") <= needed) & (F.col("n_files") > 0)).select("seed", "print"))
    pairs = durable(_met(rows, looked_up).select("seed", "file_id").distinct())
    compared = hot_key_join(pairs, sets.withColumnRenamed("prints", "_held"), "file_id", "inner", ["seed"])
    both = hot_key_join(compared, own, "seed", "inner", ["file_id"], sample=pairs)
    shared = F.size(F.array_intersect("prints", "_held"))
    return (
        both.select(
            F.col("seed").alias("row_index"),
            "n_seeds",
            "file_id",
            "n_files",
            shared.alias("shared"),
            F.size("prints").alias("seed_prints"),
            F.size("_held").alias("file_prints"),
        )
        .where(F.col("shared") >= F.col("seed_prints") * F.lit(min_share))
        .withColumn("share", F.col("shared") / F.col("seed_prints"))
    )
