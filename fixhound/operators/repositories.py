"""Repositories of a seed: grouping of hits, attributes, filters, ranks.

A seed has at most five patterns with ten hits each, so a group here has at most 50 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixhound.functions.grams import (
    SHINGLE_WORDS,
    distinct_ngrams,
    with_words,
)
from fixhound.functions.text import (
    commit_url,
    empty_if_null,
    is_accepted,
    is_flagged,
    readme_sample,
    repo_url,
    snippet,
)
from fixhound.operators.search import file_texts
from fixhound.operators.spread import fits_broadcast, hot_key_join

CANDIDATES_PER_SEED = 10
MATCHES_PER_SEED = 5
# The share of a seed's shingles that a similar file holds at least.
MIN_SHARE = 0.5


def group_hits(hits: DataFrame) -> DataFrame:
    """One row per seed and repository; its first hit supplies the other values."""
    first = F.min(F.struct("pattern_no", "hit_no", "file_id"))
    return (
        hits.groupBy("row_index", "repo_name")
        .agg(first.alias("first"), F.count("*").alias("n_hits"))
        .select("row_index", "repo_name", "first.*", "n_hits")
    )


def hit_samples(hits: DataFrame, files: DataFrame, url: Column) -> DataFrame:
    """The snippets and addresses of all hits of a repository, in order of the hits."""
    texts = file_texts(hits, files).select("file_id", snippet(F.col("content")).alias("code"))
    located = hot_key_join(hits, texts, "file_id", "inner", ["row_index", "pattern_no"])
    item = F.struct("pattern_no", "hit_no", F.col("code"), url.alias("url"))
    return (
        located.groupBy("row_index", "repo_name")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .select(
            "row_index",
            "repo_name",
            F.col("items.code").alias("code_samples"),
            F.col("items.url").alias("file_urls"),
        )
    )


def with_repository(entries: DataFrame, repos: DataFrame) -> DataFrame:
    """Attach what is known of each repository; an unknown one stays, with no stars."""
    joined = hot_key_join(entries, repos, "repo_name", "left", ["row_index"])
    return joined.withColumn("stars", F.coalesce("stars", F.lit(0)))


def with_readme(repos: DataFrame, readmes: DataFrame) -> DataFrame:
    """Description and README sample; both are "" where missing."""
    return repos.join(readmes, "repo_name", "left").select(
        "repo_name",
        empty_if_null(F.col("description")).alias("description"),
        readme_sample(F.col("readme")).alias("readme"),
    )


def star_filter(
    repos: DataFrame,
    min_stars: int = 0,
    exclude_forks: bool = False,
    exclude_archived: bool = False,
) -> DataFrame:
    """Repositories with enough stars; null counts as no stars, no fork and not archived."""
    keep = F.coalesce("stars", F.lit(0)) >= min_stars
    if exclude_forks:
        keep &= ~F.coalesce("fork", F.lit(False))
    if exclude_archived:
        keep &= ~F.coalesce("archived", F.lit(False))
    return repos.where(keep)


def top_starred(repos: DataFrame, limit: int) -> DataFrame:
    return repos.orderBy(F.desc("stars"), "repo_name").limit(limit)


def drop_flagged(entries: DataFrame) -> DataFrame:
    """Keep repositories that are not scanners; an unknown one is kept."""
    return entries.where(~F.coalesce(F.col("flagged"), F.lit(False)))


def drop_flagged_by_answers(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """The same with captured answers `(repo_name, answer)`: a left anti join."""
    scanners = answers.where(is_flagged(F.col("answer"))).select("repo_name").distinct()
    return hot_key_join(entries, scanners, "repo_name", "left_anti", ["row_index"])


def best_per_seed(entries: DataFrame, limit: int, rank: str = "rank") -> DataFrame:
    """The `limit` entries with most stars; ties keep the order in which they were found."""
    order = Window.partitionBy("row_index").orderBy(F.desc("stars"), "pattern_no", "hit_no")
    return entries.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= limit)


def similar_by_share(
    entries: DataFrame, seeds: DataFrame, files: DataFrame, min_share: float = MIN_SHARE
) -> DataFrame:
    """`similar`: the first hit holds at least `min_share` of the shingles of the whole seed.

    `entries` must be durable, as for the other rule. The seeds' shingles join the narrow
    entries first. Both go to the scan of the texts if they are small; otherwise shingles of
    files meet them in one shuffle. Seeds without a shingle, of one or two words, are similar
    to their hits: these were found by all their words.
    """
    texts = with_words(file_texts(entries, files), "content").select(
        "file_id", distinct_ngrams(F.col("words"), SHINGLE_WORDS).alias("file_shingles")
    )
    own = with_words(seeds.select("row_index", "code"), "code").select(
        "row_index", distinct_ngrams(F.col("words"), SHINGLE_WORDS).alias("shingles")
    )
    wanted = entries.join(own, "row_index")
    length = wanted.select(F.array_join("shingles", " ").alias("text"))
    if fits_broadcast(length, "text"):
        joined = texts.join(F.broadcast(wanted), "file_id")
    else:
        spread_by = ["row_index", "repo_name"]
        joined = hot_key_join(wanted, texts, "file_id", "inner", spread_by, sample=entries)
    shared = F.size(F.array_intersect("shingles", "file_shingles"))
    whole = F.when(F.size("shingles") == 0, F.lit(1.0))
    share = F.coalesce(whole, F.try_divide(shared, F.size("shingles")))
    return joined.select(*entries.columns, share.alias("share")).withColumn(
        "similar", F.coalesce(F.col("share") >= min_share, F.lit(False))
    )


def similar_by_answers(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """`similar` from captured answers `(file_id, answer)`; without one it is true."""
    joined = hot_key_join(entries, answers, "file_id", "left", ["row_index", "repo_name"])
    return joined.select(*entries.columns, is_accepted(F.col("answer")).alias("similar"))


def latest_commits(commits: DataFrame) -> DataFrame:
    """The newest commit of each file: `file_id, sha`. Only the newest leaves a map task."""
    return commits.groupBy("file_id").agg(
        F.max_by("sha", F.struct("committed_at", "commit_id")).alias("sha")
    )


def with_commit(
    entries: DataFrame, commits: DataFrame, sample: DataFrame | None = None
) -> DataFrame:
    """`commit_sha` and `commit_url` of the first hit; null for a file without commits.

    Commits of other files are dropped before the newest are looked for.
    """
    wanted = (entries if sample is None else sample).select("file_id").distinct()
    if fits_broadcast(wanted):
        wanted = F.broadcast(wanted)
    newest = latest_commits(commits.join(wanted, "file_id", "left_semi"))
    spread_by = ["row_index", "repo_name"]
    joined = hot_key_join(entries, newest, "file_id", "left", spread_by, sample=sample)
    return joined.withColumnRenamed("sha", "commit_sha").withColumn(
        "commit_url", commit_url(F.col("repo_name"), F.col("commit_sha"))
    )


def with_head_fallback(lookups: DataFrame, commits: DataFrame) -> DataFrame:
    """Commit of `(file_id, repo_name, failed, head_sha)`: the branch head if the lookup
    failed, the newest commit otherwise, null if there is none."""
    joined = lookups.join(latest_commits(commits), "file_id", "left")
    sha = F.when(F.col("failed"), F.col("head_sha")).otherwise(F.col("sha"))
    return joined.select(
        "file_id",
        "repo_name",
        sha.alias("commit_sha"),
        commit_url(F.col("repo_name"), sha).alias("commit_url"),
    )


def results(
    matches: DataFrame, files: DataFrame, commits: DataFrame, heads: DataFrame | None = None
) -> DataFrame:
    """The published fields of each match, with its rank per seed; `matches` is durable.

    `heads` holds the branch heads `(file_id, head_sha)` of files whose commit lookup failed; they
    take the place of a commit. A file without commits keeps null in both commit fields.
    """
    shown = file_texts(matches, files, "file_path").select(
        "file_id",
        empty_if_null(F.col("file_path")).alias("file_path"),
        snippet(empty_if_null(F.col("content"))).alias("code_snippet"),
    )
    located = hot_key_join(matches, shown, "file_id", "inner", ["row_index", "repo_name"])
    dated = with_commit(located, commits, sample=matches)
    if heads is not None:
        wanted = F.broadcast(matches.select("file_id").distinct()) if fits_broadcast(matches) else matches
        failed = heads.join(wanted, "file_id", "left_semi").dropDuplicates(["file_id"])
        dated = hot_key_join(dated, failed, "file_id", "left", ["row_index", "repo_name"], sample=matches)
        dated = dated.withColumn("commit_sha", F.coalesce("head_sha", "commit_sha")).withColumn(
            "commit_url", commit_url(F.col("repo_name"), F.col("commit_sha"))
        )
    return dated.select(
        "row_index",
        "rank",
        "repo_name",
        "stars",
        repo_url(F.col("repo_name")).alias("url"),
        "commit_url",
        "file_path",
        "code_snippet",
        "commit_sha",
    )
