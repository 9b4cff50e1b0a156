"""Word n-grams of whole texts.

`with_words` puts the words in their own column first: a text is then split once, however
often the n-gram expressions refer to its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE_WORDS = 3


def raw_words(text: Column) -> Column:
    """Lower-case words; white space at an end of the text leaves an empty one there."""
    return F.split(F.lower(text), r"\s+")


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.array_remove(raw_words(text), "")


def with_words(df: DataFrame, text: str, name: str = "words") -> DataFrame:
    return df.withColumn(name, words(F.col(text)))


def ngrams(word_list: Column, n: int) -> Column:
    """All runs of n words in reading order, joined by single spaces."""
    count = F.greatest(F.size(word_list) - F.lit(n - 1), F.lit(0))
    grams = F.slice(word_list, F.lit(1), count)
    for shift in range(1, n):
        grams = F.zip_with(
            grams,
            F.slice(word_list, F.lit(shift + 1), count),
            lambda left, right: F.concat(left, F.lit(" "), right),
        )
    return grams


def distinct_ngrams(word_list: Column, n: int) -> Column:
    return F.array_distinct(ngrams(word_list, n))


def phrase(word_list: Column) -> Column:
    """Words as one text with a space on either side, so `contains` meets whole words."""
    return F.concat(F.lit(" "), F.array_join(word_list, " "), F.lit(" "))


def gram_columns(n: int) -> list[str]:
    return [f"w{i}" for i in range(1, n + 1)]


def exploded_ngrams(df: DataFrame, text: str, n: int) -> DataFrame:
    """One row per run of n words, a column per word: `w1` to `wn` in place of `text`.

    The shifted word lists are zipped and unfolded inside generated code, and no text is
    put together, which costs half of what building the n-grams first does. Runs come as
    often as they occur, and one at an end of the text may hold an empty or a null word.
    """
    kept = [c for c in df.columns if c != text]
    split = df.select(*kept, raw_words(F.col(text)).alias("w1"))
    shifts = [
        F.slice("w1", F.lit(i), F.size("w1")).alias(f"w{i}") for i in range(2, n + 1)
    ]
    zipped = split.select(*kept, "w1", *shifts)
    return zipped.select(*kept, F.inline(F.arrays_zip(*gram_columns(n))))
