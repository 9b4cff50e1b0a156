"""Search by the stored index: hits and rare patterns without reading a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixhound.functions.grams import distinct_ngrams, ngrams, with_words
from fixhound.functions.text import MAX_PATTERNS
from fixhound.operators.search import HITS_PER_PATTERN, capped
from fixhound.operators.spread import durable, fits_broadcast, hot_key_join
from fixhound.sources.pair_index import BLOCK_FILES, PairIndex


def pattern_grams(patterns: DataFrame) -> DataFrame:
    """What a pattern is looked up by: `pattern, mark, needed, shift, gram`.

    A word by itself, or all word pairs with their distance from the pattern's first word. Only
    versions after `mark` are looked at, all if `patterns` has no such column.
    """
    mark = F.col("mark") if "mark" in patterns.columns else F.lit(0).cast("bigint").alias("mark")
    split = with_words(patterns.select("pattern", mark).distinct(), "pattern")
    pairs = F.when(F.size("words") == 1, F.col("words")).otherwise(ngrams(F.col("words"), 2))
    listed = split.select("pattern", "mark", pairs.alias("grams"))
    return listed.select(
        "pattern", "mark", F.size("grams").alias("needed"), F.posexplode("grams").alias("shift", "gram")
    )


def _met(index: PairIndex, grams: DataFrame, newer_than: int) -> DataFrame:
    """Postings of the wanted grams, with the columns of `grams`."""
    found = index.postings(grams, newer_than)
    if fits_broadcast(grams, "gram"):
        grams = F.broadcast(grams)
    return found.join(grams, "gram")


def _file(offset: str):
    return (F.col("block") * BLOCK_FILES + F.col(offset)).alias("file_id")


def indexed_places(index: PairIndex, patterns: DataFrame) -> DataFrame:
    """Files that hold a pattern: `pattern, file_id, repo_name`, once per pair.

    Patterns of several pairs are held where all their pairs stand at their distances. With a column
    `mark`, a pattern is looked for in later versions only, and no earlier one is opened if all
    marks are later. A file counts with its newest version.
    """
    grams = durable(pattern_grams(patterns))
    newer_than = grams.agg(F.min("mark")).first()[0] or 0
    met = _met(index, grams.where("needed = 1"), newer_than).where("version > mark")
    short = met.select("pattern", "version", "block", F.explode(F.array_distinct("files")).alias("file"))
    held = short.select("pattern", "version", _file("file"))
    if not grams.where("needed > 1").isEmpty():
        held = held.unionByName(_long_places(index, grams.where("needed > 1"), newer_than))
    return _current(index, held)


def _long_places(index: PairIndex, grams: DataFrame, newer_than: int) -> DataFrame:
    """`pattern, version, file_id` of patterns of several pairs.

    The places of a pattern's rarest pair are taken, then those of them that the second rarest stands
    beside, then those that all others do. Lists of the other pairs are never multiplied by patterns.
    """
    counted = _met(index, grams.select("gram").distinct(), newer_than).groupBy("gram").agg(F.sum("n_files").alias("n_files"))
    rarest = Window.partitionBy("pattern", "mark").orderBy("n_files", "shift")
    ranked = hot_key_join(grams, counted, "gram", "inner", ["pattern"]).withColumn("rank", F.row_number().over(rarest))
    # a pattern with a pair that is nowhere is nowhere
    known = F.count("*").over(Window.partitionBy("pattern", "mark"))
    ranked = durable(ranked.withColumn("known", known).where("known = needed").drop("known", "n_files"))
    first = _met(index, ranked.where("rank = 1"), newer_than).where("version > mark")
    places = first.select("pattern", "mark", "version", "block", "shift", F.inline(F.arrays_zip("files", "places")))
    start = (F.col("places") - F.col("shift")).cast("bigint").alias("start")
    left = places.select("pattern", "mark", "version", "block", F.col("files").cast("bigint").alias("file"), start)
    left = _beside(index, durable(left), ranked.where("rank = 2"), newer_than)
    if not ranked.where("rank > 2").isEmpty():
        more = ranked.where("needed > 2").select("pattern", "mark").distinct()
        whole = left.join(more, ["pattern", "mark"], "left_anti")
        left = whole.unionByName(_beside(index, left.join(more, ["pattern", "mark"], "left_semi"), ranked.where("rank > 2"), newer_than))
    return left.select("pattern", "version", _file("file")).distinct()


def _beside(index: PairIndex, starts: DataFrame, grams: DataFrame, newer_than: int) -> DataFrame:
    """The starts of patterns at which all of `grams` stand at their distances. Durable.

    Lists are narrowed to the places asked for before they are unfolded.
    """
    on = ["gram", "version", "block"]
    key = ["pattern", "mark", "version", "block", "file", "start"]
    packed = (F.shiftleft("file", 32) + F.col("start") + F.col("shift")).alias("at")
    wanted = grams.select("pattern", "mark", "shift", "gram")
    wanted = F.broadcast(wanted) if fits_broadcast(wanted, "gram") else wanted
    asked = durable(starts.join(wanted, ["pattern", "mark"]).select(*key, "gram", packed))
    sets = asked.groupBy(*on).agg(F.collect_set("at").alias("asked"))
    lists = _met(index, grams.select("gram").distinct(), newer_than).select(*on, "files", "places")
    pack = F.zip_with("files", "places", lambda f, p: F.shiftleft(f.cast("bigint"), 32) + p)
    found = lists.join(sets, on).select(*on, F.explode(F.array_intersect("asked", pack)).alias("at"))
    needed = grams.groupBy("pattern", "mark").agg(F.count("*").alias("needed"))
    held = asked.join(found, [*on, "at"]).groupBy(*key).agg(F.count("*").alias("n"))
    return durable(held.join(needed, ["pattern", "mark"]).where("n = needed").select(*key))


def _current(index: PairIndex, held: DataFrame) -> DataFrame:
    """Without files of which there is a newer version; with their repositories."""
    held = durable(held)
    wanted = held.select("file_id").distinct()
    if fits_broadcast(wanted):
        wanted = F.broadcast(wanted)
    newest = index.names().join(wanted, "file_id", "left_semi").groupBy("file_id").agg(
        F.max_by("repo_name", "version").alias("repo_name"), F.max("version").alias("newest")
    )
    joined = hot_key_join(held, newest, "file_id", "inner", ["pattern"])
    return joined.where(F.col("version") == F.col("newest")).select("pattern", "file_id", "repo_name")


def indexed_hits(
    index: PairIndex, patterns: DataFrame, limit: int = HITS_PER_PATTERN
) -> DataFrame:
    """Capped hits of every pattern of every seed, as `seed_hits` finds them in texts."""
    first = capped(indexed_places(index, patterns), limit)
    return hot_key_join(patterns, first, "pattern", "inner", ["row_index"]).select(
        "row_index", "pattern_no", "pattern", "hit_no", "file_id", "repo_name"
    )


def file_counts(index: PairIndex, grams: DataFrame) -> DataFrame:
    """In how many files each gram occurs: `gram, n_files`. Only grams that occur are returned.

    Without changed files the blocks' numbers are added, and no list of files is read.
    """
    met = _met(index, grams.select("gram").distinct(), 0)
    if not any(index.log().values()):
        return met.groupBy("gram").agg(F.sum("n_files").alias("n_files"))
    listed = met.select("version", "gram", "block", F.explode(F.array_distinct("files")).alias("file"))
    held = listed.select(F.col("gram").alias("pattern"), "version", _file("file"))
    return _current(index, held).groupBy(F.col("pattern").alias("gram")).agg(F.count("*").alias("n_files"))


def rare_patterns(index: PairIndex, seeds: DataFrame, limit: int = MAX_PATTERNS) -> DataFrame:
    """The `limit` word pairs of a seed that occur in the fewest files: `row_index, pattern_no,
    pattern, n_files`, as `rare_seed_patterns` finds them in texts.

    The sketch bounds every pair's number of files from both sides. Pairs that may be among a
    seed's rarest are finalists and are counted exactly. A pair that passes the sketch may still be in
    no file; where too few finalists are left for that reason, the next pairs are counted as well,
    until no pair left out can be rarer than the last one taken. The result does not depend on the
    sketch's width.
    """
    split = with_words(seeds.select("row_index", "code"), "code")
    pairs = F.posexplode(distinct_ngrams(F.col("words"), 2)).alias("at", "gram")
    own = durable(split.select("row_index", pairs))
    left = durable(hot_key_join(own, index.bounds(own), "gram", "inner", ["row_index"]))
    by_upper = Window.partitionBy("row_index").orderBy("high")
    upto = left.withColumn("n", F.row_number().over(by_upper)).where(F.col("n") <= limit)
    limits = upto.groupBy("row_index").agg(F.max("high").alias("last"))
    known = None
    rarest = Window.partitionBy("row_index").orderBy("n_files", "at")
    while True:
        judged = left.join(limits, "row_index")
        chosen = durable(judged.where("low <= last").drop("last"))
        counted = hot_key_join(chosen, file_counts(index, chosen), "gram", "inner", ["row_index"])
        counted = counted.select("row_index", "at", "gram", "n_files")
        known = counted if known is None else known.unionByName(counted)
        known = durable(known.withColumn("place", F.row_number().over(rarest)).where(F.col("place") <= limit).drop("place"))
        left = durable(judged.where("low > last").drop("last"))
        taken = known.groupBy("row_index").agg(F.count("*").alias("n"), F.max("n_files").alias("last"))
        # with too few pairs known, all that are left may be among the rarest
        whole = F.when(F.col("n") >= limit, F.col("last")).otherwise(F.lit((1 << 62)))
        limits = left.select("row_index").distinct().join(taken, "row_index", "left").select(
            "row_index", F.coalesce(whole, F.lit(1 << 62)).alias("last")
        )
        if left.join(limits, "row_index").where("low <= last").isEmpty():
            break
    numbered = known.withColumn("pattern_no", F.row_number().over(rarest))
    return numbered.select("row_index", "pattern_no", F.col("gram").alias("pattern"), "n_files")


def search_patterns(index: PairIndex, seeds: DataFrame, limit: int = MAX_PATTERNS) -> DataFrame:
    """The patterns of a seed, as `seed_patterns` takes them: its rarest pairs, or its only word."""
    words = with_words(seeds.select("row_index", "code"), "code").where(F.size("words") == 1)
    single = words.select("row_index", F.lit(1).alias("pattern_no"), F.get("words", F.lit(0)).alias("pattern"))
    return rare_patterns(index, seeds, limit).drop("n_files").unionByName(single)
