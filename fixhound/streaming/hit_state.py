"""Hits that are kept between runs, so a later run looks at new files only.

A pattern is kept with the corpus version that it was looked for in and with its first hits in
file order. The next run looks for known patterns in later versions of the index, and for new
patterns in all of them. A pattern one of whose kept hits lies in a changed file starts afresh, since a
hit that the cap had cut off may take its place. The hits equal those of a full search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixhound.operators import repositories as repo
from fixhound.operators.indexed import indexed_places, search_patterns
from fixhound.operators.search import HITS_PER_PATTERN, capped
from fixhound.operators.sheet import fine_rows, has_code, pending, update_found, with_errors
from fixhound.operators.spread import durable, fits_broadcast, hot_key_join
from fixhound.plans.matching import Inputs, shortlist, top_matches
from fixhound.plans.publish import detail_rows, summary_cells
from fixhound.sources.pair_index import PairIndex
from fixhound.sources.snapshots import SheetStore, append_details

_HITS = "pattern STRING, mark BIGINT, file_id BIGINT, repo_name STRING, hit_no INT"
_SHARES = "row_index BIGINT, code_digest STRING, file_id BIGINT, file_version BIGINT, share DOUBLE"


class HitState:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self._hits = SheetStore(spark, f"{path.rstrip('/')}/hits")
        self._shares = SheetStore(spark, f"{path.rstrip('/')}/shares")

    def _kept(self, store: SheetStore, schema: str) -> DataFrame:
        return store.read() if store.version() else self.spark.createDataFrame([], schema)

    def hits(self) -> DataFrame:
        """A row per kept hit, and one without a file for a pattern that has none."""
        return self._kept(self._hits, _HITS)

    def shares(self) -> DataFrame:
        return self._kept(self._shares, _SHARES)

    def marked(self, index: PairIndex, patterns: DataFrame) -> DataFrame:
        """`pattern, mark`: after which version a pattern must still be looked for."""
        kept = self.hits()
        files = kept.where("file_id IS NOT NULL").select("file_id").distinct()
        if fits_broadcast(files):
            files = F.broadcast(files)
        newest = index.names().join(files, "file_id", "left_semi").groupBy("file_id").agg(
            F.max("version").alias("newest")
        )
        dated = hot_key_join(kept, newest, "file_id", "left", ["pattern"])
        marks = dated.groupBy("pattern").agg(
            F.max("mark").alias("kept_mark"),
            F.coalesce(F.max(F.col("newest") > F.col("mark")), F.lit(False)).alias("stale"),
        )
        joined = patterns.select("pattern").distinct().join(marks, "pattern", "left")
        fresh = F.coalesce("stale", F.lit(True))
        return joined.select("pattern", F.when(fresh, F.lit(0)).otherwise(F.col("kept_mark")).cast("bigint").alias("mark"))

    def hits_of(self, index: PairIndex, patterns: DataFrame, limit: int = HITS_PER_PATTERN) -> DataFrame:
        """Capped hits of every pattern of every seed, equal to `indexed_hits`; they are kept."""
        version = index.version()
        marks = durable(self.marked(index, patterns))
        # two lookups: what is known opens later versions only
        new = indexed_places(index, marks.where("mark = 0"))
        known = marks.where((F.col("mark") > 0) & (F.col("mark") < version))
        later = indexed_places(index, known)
        old = self.hits().where("file_id IS NOT NULL").select("pattern", "file_id", "repo_name")
        old = old.join(marks.where("mark > 0").select("pattern"), "pattern", "left_semi")
        first = durable(capped(new.unionByName(later).unionByName(old), limit))
        looked = marks.select("pattern").withColumn("mark", F.lit(version).cast("bigint"))
        now = looked.join(first, "pattern", "left").select("pattern", "mark", "file_id", "repo_name", "hit_no")
        rest = self.hits().join(looked.select("pattern"), "pattern", "left_anti")
        self._hits.save(now.unionByName(rest))
        return hot_key_join(patterns, first, "pattern", "inner", ["row_index"]).select(
            "row_index", "pattern_no", "pattern", "hit_no", "file_id", "repo_name"
        )

    def compared(self, index: PairIndex, entries: DataFrame, seeds: DataFrame, files: DataFrame, min_share: float) -> DataFrame:
        """`similar_by_share`, reading only texts of files that a seed wasn't compared with yet.

        If `files` has a column `version`, only the versions that hold such files are read.
        """
        wanted = entries.select("file_id").distinct()
        versions = index.names().join(wanted, "file_id", "left_semi").groupBy("file_id").agg(
            F.max("version").alias("file_version")
        )
        digests = seeds.select("row_index", F.sha2("code", 256).alias("code_digest"))
        dated = entries.join(digests, "row_index").join(versions, "file_id")
        key = ["row_index", "code_digest", "file_id", "file_version"]
        joined = durable(dated.join(self.shares(), key, "left"))
        todo = joined.where("share IS NULL")
        read = [r.file_version for r in todo.select("file_version").distinct().collect()]
        fresh = joined.where("share IS NOT NULL")
        if read:
            texts = files.where(F.col("version").isin(read)) if "version" in files.columns else files
            # whether a file is similar is decided for all alike below
            new = repo.similar_by_share(todo.drop("share"), seeds, texts, min_share).drop("similar")
            new = durable(new.withColumn("share", F.coalesce("share", F.lit(0.0))))
            self._shares.save(self.shares().unionByName(new.select(*key, "share").distinct()))
            fresh = fresh.unionByName(new.select(*fresh.columns))
        return fresh.select(*entries.columns, "share", (F.col("share") >= min_share).alias("similar"))


def run_incremental(
    spark: SparkSession,
    sheet_path: str,
    details_path: str,
    index: PairIndex,
    state: HitState,
    inputs: Inputs,
    min_share: float = repo.MIN_SHARE,
) -> DataFrame:
    """Match the pending seeds of a stored sheet by the index and the kept hits; save the sheet.

    `inputs.seeds` is not read. Returns the published rows of this run. Kept hits and shares are
    saved on the way; a run that dies repeats at most its own lookups.
    """
    store = SheetStore(spark, sheet_path)
    sheet = store.read()
    todo = durable(pending(fine_rows(with_errors(sheet))))
    patterns = durable(search_patterns(index, has_code(todo)))
    grouped = durable(repo.group_hits(state.hits_of(index, patterns)))
    listed = shortlist(repo.with_repository(grouped, inputs.repos), inputs.scanner_answers)
    found = durable(top_matches(state.compared(index, listed, todo, inputs.files, min_share)))
    published = durable(repo.results(found, inputs.files, inputs.commits, inputs.heads))
    append_details(detail_rows(todo, published), details_path, str(store.version()))
    store.save(update_found(sheet, summary_cells(todo, published)))
    return published
