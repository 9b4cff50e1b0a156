"""Matching of all seeds against a corpus, as one job.

The corpus is read to count the seeds' word pairs, for the hits, and for the texts of first
hits; with a stored index, for the last only. Patterns and capped hits are made durable in between; all
after them grows with the seeds. Captured replies and answers take the place of the rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixhound.operators import repositories as repo
from fixhound.operators.indexed import indexed_hits, search_patterns
from fixhound.operators.patterns import seed_patterns
from fixhound.operators.search import seed_hits
from fixhound.operators.sheet import has_code
from fixhound.operators.spread import durable
from fixhound.sources.pair_index import PairIndex


@dataclass(frozen=True)
class Inputs:
    """The tables of the search job; their columns are in `fixhound.schemas`.

    The others are optional. index: of the files. given_patterns: `(row_index, pattern_no, pattern)`; seeds
    without one are searched by their rarest pairs. scanner_answers: `(repo_name, answer)`, in
    place of the repositories' flags. similar_answers: `(file_id, answer)`, in place of the shingles.
    heads: `(file_id, head_sha)`, the branch heads of files whose commit lookup failed.
    """

    seeds: DataFrame
    files: DataFrame
    repos: DataFrame
    commits: DataFrame
    index: PairIndex | None = None
    given_patterns: DataFrame | None = None
    scanner_answers: DataFrame | None = None
    similar_answers: DataFrame | None = None
    heads: DataFrame | None = None

    def patterns(self) -> DataFrame:
        seeds, given = has_code(self.seeds), self.given_patterns
        if given is None:
            return durable(self._rare(seeds))
        asked = given.join(seeds.select("row_index"), "row_index", "left_semi")
        others = seeds.join(given.select("row_index"), "row_index", "left_anti")
        columns = ["row_index", "pattern_no", "pattern"]
        if others.isEmpty():
            return durable(asked.select(columns))
        return durable(asked.select(columns).unionByName(self._rare(others).select(columns)))

    def _rare(self, seeds: DataFrame) -> DataFrame:
        return seed_patterns(seeds, self.files) if self.index is None else search_patterns(self.index, seeds)

    def hits(self, patterns: DataFrame) -> DataFrame:
        if self.index is None:
            return seed_hits(patterns, self.files)
        return indexed_hits(self.index, patterns)


def candidates(inputs: Inputs, patterns: DataFrame | None = None) -> DataFrame:
    """One row per seed and repository with a hit, with the repository's attributes."""
    found = patterns if patterns is not None else inputs.patterns()
    grouped = durable(repo.group_hits(inputs.hits(found)))
    return repo.with_repository(grouped, inputs.repos)


def shortlist(entries: DataFrame, scanner_answers: DataFrame | None = None) -> DataFrame:
    """The ten candidates per seed that are compared: scanners go before the cap."""
    if scanner_answers is None:
        kept = repo.drop_flagged(entries)
    else:
        kept = repo.drop_flagged_by_answers(durable(entries), scanner_answers)
    return durable(repo.best_per_seed(kept, repo.CANDIDATES_PER_SEED))


def top_matches(compared: DataFrame) -> DataFrame:
    """The five best of the candidates found similar."""
    return repo.best_per_seed(compared.where("similar"), repo.MATCHES_PER_SEED)


def matches(inputs: Inputs, min_share: float = repo.MIN_SHARE) -> DataFrame:
    """At most five repositories per seed whose first hit holds `min_share` of its shingles, or
    has been answered to be similar."""
    listed = shortlist(candidates(inputs), inputs.scanner_answers)
    if inputs.similar_answers is not None:
        return top_matches(repo.similar_by_answers(listed, inputs.similar_answers))
    return top_matches(repo.similar_by_share(listed, inputs.seeds, inputs.files, min_share))


def matches_in_rounds(
    inputs: Inputs, listed: DataFrame, min_share: float = repo.MIN_SHARE, limit: int = repo.MATCHES_PER_SEED
) -> DataFrame:
    """The same matches, comparing no candidate after a seed's last match; `listed` is durable.

    Returns the compared candidates with `share` and `similar`. In each round, a seed that
    lacks n matches has its next n candidates compared, which are needed in any case; a seed
    that has all its matches takes part no more. Candidates past the fifth match are thus never
    read. Each round is a pass over the files, so this pays where texts are dear to compare.
    """
    done = None
    progress = listed.select("row_index", F.lit(0).alias("last"), F.lit(limit).alias("lacking")).distinct()
    while True:
        due = listed.join(progress, "row_index").where(
            (F.col("rank") > F.col("last")) & (F.col("rank") <= F.col("last") + F.col("lacking"))
        )
        due = durable(due.select(*listed.columns))
        if done is not None and due.isEmpty():
            return done
        compared = repo.similar_by_share(due, inputs.seeds, inputs.files, min_share)
        done = durable(compared if done is None else done.unionByName(compared))
        progress = done.groupBy("row_index").agg(
            F.max("rank").alias("last"), (F.lit(limit) - F.count_if("similar")).alias("lacking")
        )


def funnel(inputs: Inputs, min_share: float = repo.MIN_SHARE) -> DataFrame:
    """Repositories left per seed after each stage, from one pass over the candidates."""
    entries = durable(candidates(inputs))
    listed = shortlist(entries)
    compared = repo.similar_by_share(listed, inputs.seeds, inputs.files, min_share)
    stages = entries.groupBy("row_index").agg(
        F.count("*").alias("found"),
        F.count_if(~F.coalesce("flagged", F.lit(False))).alias("kept"),
    )
    checks = compared.groupBy("row_index").agg(
        F.count("*").alias("compared"), F.count_if("similar").alias("validated")
    )
    counted = inputs.seeds.select("row_index").join(stages, "row_index", "left")
    return counted.join(checks, "row_index", "left").na.fill(0)
