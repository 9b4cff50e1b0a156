"""A scanner verdict learned from captured answers: multinomial Bayes on a repository's words.

Fitting and scoring are aggregates and joins. The model is a row per word; what a word says that no
answered repository uses is one number for all such words. Words meet the model where they are read: it is
sent to the texts, in parts if it is large, so only sums are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixhound.functions.grams import with_words
from fixhound.functions.text import is_flagged
from fixhound.operators import spread
from fixhound.operators.spread import durable, fits_broadcast, hot_key_join, measured_bytes

#: Texts are read once for each part of the model; one of more parts meets them in a shuffle.
MOST_PARTS = 4


@dataclass(frozen=True)
class VerdictModel:
    """words: `word, weight`, by how much a word speaks for a scanner (log of the likelihoods' ratio).

    unseen: the weight of a word that isn't in the table; prior: the weight of no word at all.
    """

    words: DataFrame
    unseen: float
    prior: float


def word_counts(texts: DataFrame) -> DataFrame:
    """`repo_name, word, n` of `texts` `(repo_name, text)`, counted inside each row first."""
    split = with_words(texts.select("repo_name", "text"), "text")
    return split.select("repo_name", F.explode("words").alias("word")).groupBy("repo_name", "word").agg(
        F.count("*").alias("n")
    )


def fit_verdicts(texts: DataFrame, answers: DataFrame) -> VerdictModel | None:
    """Fit on the texts of repositories with an answer `(repo_name, answer)`.

    Counts are smoothed by one. None if the answers know only one of the two verdicts. A repository with
    several answers counts as a scanner if any of them says so; without a text it counts for the prior.
    """
    known = answers.where(F.col("answer").isNotNull()).groupBy("repo_name").agg(
        F.max(is_flagged(F.col("answer"))).alias("scanner")
    )
    known = durable(known)
    yes, no = known.agg(F.count_if("scanner"), F.count_if(~F.col("scanner"))).first()
    if not yes or not no:
        return None
    few = fits_broadcast(known.select(F.col("repo_name").cast("string").alias("name")), "name")
    split = with_words(texts.select("repo_name", "text").join(F.broadcast(known) if few else known, "repo_name"), "text")
    each = split.select("scanner", F.explode("words").alias("word"))
    words = durable(each.groupBy("word").agg(F.count_if("scanner").alias("yes"), F.count_if(~F.col("scanner")).alias("no")))
    size, in_yes, in_no = words.agg(F.count("*"), F.coalesce(F.sum("yes"), F.lit(0)), F.coalesce(F.sum("no"), F.lit(0))).first()
    scale = F.log(F.lit((in_no + size + 1) / (in_yes + size + 1)))
    weight = F.log((F.col("yes") + 1) / (F.col("no") + 1)) + scale
    unseen, prior = words.sparkSession.range(1).select(scale, F.log(F.lit(yes / no))).first()
    return VerdictModel(words.select("word", weight.alias("weight")), unseen, prior)


def _said(texts: DataFrame, model: VerdictModel) -> DataFrame:
    """`repo_name, said`: what the words of each row of `texts` say, in any number of rows."""
    unseen = F.lit(model.unseen)
    parts = max(1, -(-measured_bytes(model.words, "word") // spread.BROADCAST_BYTES))
    if parts > MOST_PARTS:
        # the words that most repositories use are spread
        joined = hot_key_join(word_counts(texts), model.words, "word", "left", ["repo_name"])
        return joined.select("repo_name", (F.col("n") * F.coalesce("weight", unseen)).alias("said"))
    each = with_words(texts.select("repo_name", "text"), "text").select("repo_name", F.explode("words").alias("word"))
    part = F.pmod(F.xxhash64("word"), F.lit(parts))
    said = each.join(F.broadcast(model.words.where(part == 0)), "word", "left").select(
        "repo_name", F.coalesce("weight", unseen).alias("said")
    )
    for k in range(1, parts):
        # the first part took these words for unseen ones
        more = each.join(F.broadcast(model.words.where(part == k)), "word")
        said = said.unionByName(more.select("repo_name", (F.col("weight") - unseen).alias("said")))
    return said


def learned_verdicts(texts: DataFrame, model: VerdictModel | None) -> DataFrame:
    """`repo_name, score, flagged` of every row of `texts`; a scanner has a score above 0.

    What can't be told stays: without a model, or for a null or empty text, nothing is flagged and
    the score is null.
    """
    if model is None:
        return texts.select("repo_name", F.lit(None).cast("double").alias("score"), F.lit(False).alias("flagged"))
    scored = _said(texts, model).groupBy("repo_name").agg((F.sum("said") + F.lit(model.prior)).alias("score"))
    return texts.select("repo_name").join(scored, "repo_name", "left").select(
        "repo_name", "score", F.coalesce(F.col("score") > 0, F.lit(False)).alias("flagged")
    )


def drop_learned(entries: DataFrame, verdicts: DataFrame, answers: DataFrame) -> DataFrame:
    """Keep entries whose repository isn't a scanner: by its captured answer, else by the verdict,
    else in any case."""
    answered = answers.where(F.col("answer").isNotNull()).groupBy("repo_name").agg(
        F.max(is_flagged(F.col("answer"))).alias("said")
    )
    both = verdicts.select("repo_name", "flagged").join(answered, "repo_name", "full")
    scanners = both.where(F.coalesce("said", "flagged")).select("repo_name").distinct()
    return hot_key_join(entries, scanners, "repo_name", "left_anti", ["row_index"])
