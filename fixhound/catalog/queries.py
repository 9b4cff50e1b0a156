"""One query per operator or job, over whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from fixhound.catalog import tables as t
from fixhound.functions import text as tx
from fixhound.functions.grams import with_words
from fixhound.operators import patterns as pat
from fixhound.operators import repositories as repo
from fixhound.operators import classes, fingerprints, indexed, search, sheet, similarity, verdicts
from fixhound.operators.spread import durable, shared_folder
from fixhound.plans import fix_report as report
from fixhound.plans import matching, publish
from fixhound.sources.sheet_table import SheetTable
from fixhound.sources.tables import register_views
from fixhound.streaming.hit_state import HitState

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MIN_SHARE = repo.MIN_SHARE
EARLIER_SHARE = 0.9
MIN_STARS = 110_000
FIRST_SEEDS = 10
PHRASE_WORDS = (4, 6)
FENCE = "```"


def query(function: Query) -> Query:
    """Register under the function's name; small integers become BIGINT as in the checks."""

    def widened(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = function(spark, sf_dir)
        return df.select(
            *[
                F.col(f"`{f.name}`").cast("bigint").alias(f.name)
                if isinstance(f.dataType, IntegerType)
                else F.col(f"`{f.name}`")
                for f in df.schema
            ]
        )

    QUERIES[function.__name__] = widened
    return function


# Fix report


@query
def fix_report_sql(spark, sf_dir):
    register_views(t.fix_tables(spark, sf_dir))
    return report.fix_report_sql(spark, **t.REPORT_FILTERS)


@query
def fix_report_semi(spark, sf_dir):
    return report.fix_report(t.fix_tables(spark, sf_dir), **t.REPORT_FILTERS)


@query
def fix_report_summary(spark, sf_dir):
    return report.row_count(report.fix_rows(t.fix_tables(spark, sf_dir), **t.REPORT_FILTERS))


@query
def fix_report_preview(spark, sf_dir):
    return report.preview(report.fix_rows(t.fix_tables(spark, sf_dir), **t.REPORT_FILTERS))


# Text rules


@query
def scalar_concat_nulls(spark, sf_dir):
    url = F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT"))
    return t.load(spark, sf_dir, "orders").select(
        "o_orderkey", tx.report_commit_url(url, F.col("o_orderkey")).alias("commit_url")
    )


@query
def pattern_qualified(spark, sf_dir):
    given = F.when(
        F.col("pattern_no") == 2, F.concat("pattern", F.lit(" Language:Python"))
    ).otherwise(F.col("pattern"))
    return t.inputs(spark, sf_dir).patterns().select(
        "row_index", "pattern_no", tx.qualified(given).alias("query")
    )


@query
def text_truncated(spark, sf_dir):
    return t.files(spark, sf_dir).select(
        "file_id", tx.snippet(F.col("content")).alias("code_snippet")
    )


@query
def detail_cell_truncated(spark, sf_dir):
    return t.files(spark, sf_dir).select(
        "file_id", tx.detail_cell(F.col("content")).alias("cell")
    )


@query
def utf8_or_empty(spark, sf_dir):
    """German documents get a byte that is not UTF-8."""
    content = F.encode("text", "UTF-8")
    damaged = F.when(F.col("lang") == "de", F.concat(F.unhex(F.lit("FF")), content))
    return t.load(spark, sf_dir, "documents").select(
        "doc_id", tx.utf8_or_empty(F.coalesce(damaged, content)).alias("content")
    )


def _by_event_type(**values: Column) -> Column:
    chosen = F.lit(None).cast("string")
    for name, value in values.items():
        chosen = F.when(F.col("event_type") == name, value).otherwise(chosen)
    return chosen


def _replies(spark, sf_dir) -> DataFrame:
    """Pattern replies of all shapes, one per event."""
    user = F.col("user_id").cast("string")
    pair = F.concat(F.lit('["user '), user, F.lit('", "'), F.col("event_type"), F.lit('"]'))
    seven = F.concat(F.lit("["), user, F.lit(', 2.5, true, null, "null", "f", "g"]'))
    reply = _by_event_type(
        click=F.concat(F.lit(" \n"), pair, F.lit("\t")),
        view=F.concat(F.lit(f"{FENCE}json\n"), pair, F.lit(f"\n{FENCE}")),
        purchase=seven,
        error=F.concat(F.lit(f"{FENCE}json "), pair, F.lit(FENCE)),
        signup=F.col("props"),
    )
    return t.load(spark, sf_dir, "events").select(F.col("event_id").alias("row_index"), reply.alias("reply"))


@query
def pattern_list_parse(spark, sf_dir):
    return pat.with_pattern_list(_replies(spark, sf_dir)).select(
        "row_index",
        F.size("patterns").alias("n_patterns"),
        F.array_join("patterns", "|").alias("patterns"),
    )


@query
def pattern_rows(spark, sf_dir):
    return pat.captured_patterns(_replies(spark, sf_dir))


@query
def verdict_parse(spark, sf_dir):
    answer = _by_event_type(
        click=F.lit("yes"),
        view=F.lit(" Yes\n"),
        purchase=F.lit("YES."),
        signup=F.lit("No"),
    )
    return t.load(spark, sf_dir, "events").select(
        "event_id",
        tx.is_flagged(answer).alias("scanner"),
        tx.is_accepted(answer).alias("similar"),
    )


# Seed sheets


@query
def seed_rows_clean(spark, sf_dir):
    """Labels as a sheet: unlabelled documents are blank rows."""
    documents = t.load(spark, sf_dir, "documents")
    labelled = documents.join(t.load(spark, sf_dir, "labels"), "doc_id", "left")
    raw = labelled.select(
        (F.col("doc_id") + 2).alias("row_index"),
        "quality",
        (F.col("toxic") == 1).alias("toxic"),
        F.when(F.col("quality") == 0, "").otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("toxic") == 1, F.col("text")).alias("code"),
    ).withColumn("lang", F.when(F.col("quality").isNotNull(), F.col("lang")))
    return sheet.clean_rows(raw, ["quality", "toxic", "lang", "code"])


@query
def seeds_first_n(spark, sf_dir):
    return sheet.first_rows(t.seeds(spark, sf_dir), FIRST_SEEDS)


@query
def pending_seeds(spark, sf_dir):
    """The seeds a second run would try again."""
    _, cells = _published_cells(spark, sf_dir)
    seeds = sheet.update_found(t.seeds(spark, sf_dir), cells)
    return sheet.pending(seeds).select("row_index", "cve_id", "found")


# Patterns and hits


@query
def seed_patterns(spark, sf_dir):
    return t.plain_inputs(spark, sf_dir).patterns()


@query
def seed_patterns_rare(spark, sf_dir):
    return pat.rare_seed_patterns(t.seeds(spark, sf_dir), t.files(spark, sf_dir))


@query
def pattern_hits(spark, sf_dir):
    inputs = t.inputs(spark, sf_dir)
    return search.pattern_hits(inputs.patterns(), inputs.files)


@query
def phrase_hits(spark, sf_dir):
    """All runs of four and six words of the seeds, looked up in whole texts."""
    seeds = t.seeds(spark, sf_dir)
    given = search.union_hits(*[pat.seed_phrases(seeds, n) for n in PHRASE_WORDS])
    return search.pattern_hits(given, t.files(spark, sf_dir))


@query
def pattern_hits_capped(spark, sf_dir):
    inputs = t.inputs(spark, sf_dir)
    return search.seed_hits(inputs.patterns(), inputs.files)


@query
def hits_union_all(spark, sf_dir):
    inputs = t.inputs(spark, sf_dir)
    patterns = inputs.patterns()
    talks = t.conversation_files(spark, sf_dir)
    return search.union_hits(
        search.seed_hits(patterns, inputs.files), search.seed_hits(patterns, talks)
    )


# The stored index


@query
def indexed_places(spark, sf_dir):
    """The files of `pattern_hits`, by the index."""
    patterns = durable(indexed.search_patterns(t.index(spark, sf_dir), t.seeds(spark, sf_dir)))
    return indexed.indexed_places(t.index(spark, sf_dir), patterns)


@query
def indexed_phrases(spark, sf_dir):
    """The files of `phrase_hits`, by the places of word pairs in the index."""
    seeds = t.seeds(spark, sf_dir)
    given = search.union_hits(*[pat.seed_phrases(seeds, n) for n in PHRASE_WORDS])
    return indexed.indexed_places(t.index(spark, sf_dir), given)


@query
def indexed_patterns(spark, sf_dir):
    """The patterns of `seed_patterns_rare`, by sketch and index."""
    return indexed.rare_patterns(t.index(spark, sf_dir), t.seeds(spark, sf_dir))


@query
def indexed_hits(spark, sf_dir):
    index = t.index(spark, sf_dir)
    patterns = durable(indexed.search_patterns(index, sheet.has_code(t.seeds(spark, sf_dir))))
    return indexed.indexed_hits(index, patterns)


@query
def incremental_hits(spark, sf_dir):
    """Hits of a second run, after the rest of the corpus has come: kept hits and new files."""
    seeds = sheet.has_code(t.seeds(spark, sf_dir))
    index = t.new_index(spark, "growing-index")
    state = HitState(spark, f"{index.path}-state")
    for part in t.corpus_parts(spark, sf_dir):
        index.append(part)
        hits = state.hits_of(index, durable(indexed.search_patterns(index, seeds)))
    return hits


# Repositories


@query
def repo_candidates(spark, sf_dir):
    return matching.candidates(t.inputs(spark, sf_dir)).drop("flagged")


@query
def repo_samples(spark, sf_dir):
    inputs = t.inputs(spark, sf_dir)
    hits = durable(search.seed_hits(inputs.patterns(), inputs.files))
    hits = hits.withColumn("url", tx.file_url(F.col("repo_name"), F.col("file_id").cast("string")))
    samples = repo.hit_samples(hits, inputs.files, F.col("url"))
    return samples.select(
        "row_index",
        "repo_name",
        F.size("code_samples").alias("n_samples"),
        F.array_join("code_samples", "\n").alias("code_samples"),
        F.array_join("file_urls", "\n").alias("file_urls"),
    )


@query
def repo_attributes(spark, sf_dir):
    return t.repos(spark, sf_dir)


@query
def repo_readme(spark, sf_dir):
    described = t.readmes(spark, sf_dir)
    names = t.repos(spark, sf_dir).select("repo_name")
    return repo.with_readme(names.join(described.drop("readme"), "repo_name", "left"), described.drop("description"))


@query
def repos_min_stars(spark, sf_dir):
    return repo.star_filter(t.repos(spark, sf_dir), min_stars=MIN_STARS)


@query
def repos_fork_archive(spark, sf_dir):
    """Forks and archived repositories go; what isn't known of one never drops it."""
    name = F.length("repo_name")
    marked = t.repos(spark, sf_dir).select(
        "*",
        F.when(F.col("stars") % 3 == 0, name % 2 == 0).alias("fork"),
        F.when(F.col("stars") % 2 == 0, F.col("stars") % 5 == 0).alias("archived"),
    )
    return repo.star_filter(marked, exclude_forks=True, exclude_archived=True)


@query
def repos_unknown_kept(spark, sf_dir):
    """Only repositories with many stars are known; hits in the others stay."""
    inputs = t.inputs(spark, sf_dir)
    known = repo.star_filter(inputs.repos, min_stars=MIN_STARS)
    return repo.drop_flagged(matching.candidates(replace(inputs, repos=known))).drop("flagged")


@query
def repos_top_stars(spark, sf_dir):
    return repo.top_starred(t.repos(spark, sf_dir), repo.MATCHES_PER_SEED)


@query
def repos_not_flagged(spark, sf_dir):
    return repo.drop_flagged(matching.candidates(t.inputs(spark, sf_dir))).drop("flagged")


@query
def repos_not_flagged_answers(spark, sf_dir):
    """Captured answers for some repositories; the others are kept."""
    inputs = t.inputs(spark, sf_dir)
    answers = t.readmes(spark, sf_dir).select(
        "repo_name", F.when(F.length("readme") > 2000, " yes\n").alias("answer")
    )
    entries = durable(matching.candidates(inputs))
    return repo.drop_flagged_by_answers(entries, answers).drop("flagged")


def _learned(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every document as a repository's README, labelled toxic ones as scanners; verdicts learned from
    even documents, and all answers."""
    texts = t.files(spark, sf_dir).select(F.col("file_id").alias("repo_name"), F.col("content").alias("text"))
    labels = t.load(spark, sf_dir, "labels")
    answers = labels.select(F.col("doc_id").alias("repo_name"), F.when(F.col("toxic") == 1, " Yes").otherwise("no").alias("answer"))
    model = verdicts.fit_verdicts(texts, answers.where("repo_name % 2 = 0"))
    return verdicts.learned_verdicts(texts, model), answers


@query
def scanners_learned(spark, sf_dir):
    learned, _ = _learned(spark, sf_dir)
    return learned.select("repo_name", F.round("score", 4).alias("score"), "flagged")


@query
def scanners_agreement(spark, sf_dir):
    """How often a learned verdict agrees with an answer that it wasn't learned from."""
    learned, answers = _learned(spark, sf_dir)
    held_out = learned.join(answers.where("repo_name % 2 = 1"), "repo_name")
    said = tx.is_flagged(F.col("answer"))
    return held_out.groupBy(said.alias("scanner")).agg(
        F.count("*").alias("answers"), F.count_if(F.col("flagged") == said).alias("agreed")
    )


@query
def candidates_top10(spark, sf_dir):
    return matching.shortlist(matching.candidates(t.inputs(spark, sf_dir))).drop("flagged")


def _compared(spark, sf_dir, min_share: float | None = None) -> DataFrame:
    """The compared candidates, by share or else by answers."""
    inputs = t.inputs(spark, sf_dir)
    listed = matching.shortlist(matching.candidates(inputs)).drop("flagged")
    if min_share is not None:
        return repo.similar_by_share(listed, inputs.seeds, inputs.files, min_share)
    labels = t.load(spark, sf_dir, "labels")
    answer = F.when(F.col("quality") == 1, "YES").otherwise("NO")
    answers = labels.select(F.col("doc_id").alias("file_id"), answer.alias("answer"))
    return repo.similar_by_answers(listed, answers)


@query
def validated_candidates(spark, sf_dir):
    return _compared(spark, sf_dir, MIN_SHARE).where("similar").drop("share", "similar")


@query
def validated_by_share(spark, sf_dir):
    return _compared(spark, sf_dir, MIN_SHARE).where("similar").drop("similar")


@query
def validated_by_answers(spark, sf_dir):
    return _compared(spark, sf_dir).where("similar").drop("similar")


@query
def latest_commit(spark, sf_dir):
    """A file is a user's events of one type, its repository the user."""
    file_id = F.concat_ws("/", "user_id", "event_type")
    commits = t.load(spark, sf_dir, "events").select(
        file_id.alias("file_id"),
        F.col("event_id").alias("commit_id"),
        F.col("event_id").cast("string").alias("sha"),
        F.col("ts").alias("committed_at"),
    )
    return repo.latest_commits(commits).select(
        "file_id", "sha", tx.commit_url(F.split_part("file_id", F.lit("/"), F.lit(1)), F.col("sha")).alias("commit_url")
    )


@query
def commit_or_head(spark, sf_dir):
    """Lookups of toxic documents fail and take the branch head."""
    labels = t.load(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id"), "toxic")
    lookups = t.files(spark, sf_dir).join(labels, "file_id", "left").select(
        "file_id",
        "repo_name",
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("failed"),
        F.concat(F.lit("head-"), "repo_name").alias("head_sha"),
    )
    return repo.with_head_fallback(lookups, t.commits(spark, sf_dir))


@query
def similar_pairs(spark, sf_dir):
    return similarity.similar_pairs(t.seeds(spark, sf_dir), t.files(spark, sf_dir), MIN_SHARE)


@query
def similar_classes(spark, sf_dir):
    return classes.similar_classes(t.files(spark, sf_dir))


@query
def similar_classes_lsh(spark, sf_dir):
    """The same, with the first candidates by MinHash bands; no check, as the hashes of the bands are Spark's."""
    return classes.similar_classes(t.files(spark, sf_dir), exact=False)


@query
def file_fingerprints(spark, sf_dir):
    """All fingerprints of a file, put together as a digest."""
    files = t.files(spark, sf_dir)
    prints = fingerprints.file_prints(files, fingerprints.common_words(files))
    digest = F.md5(F.array_join("prints", " "))
    return prints.select("file_id", "n_tokens", F.size("prints").alias("n_prints"), digest.alias("prints_md5"))


@query
def renamed_copies(spark, sf_dir):
    return fingerprints.renamed_copies(t.seeds(spark, sf_dir), t.files(spark, sf_dir))


# Jobs


@query
def matches_top5(spark, sf_dir):
    return matching.matches(t.inputs(spark, sf_dir)).drop("flagged", "share", "similar")


@query
def matches_in_rounds(spark, sf_dir):
    """Of each seed: how many candidates were compared until five matched, and how many matched."""
    inputs = t.inputs(spark, sf_dir)
    compared = matching.matches_in_rounds(inputs, matching.shortlist(matching.candidates(inputs)))
    return compared.groupBy("row_index").agg(
        F.count("*").alias("n_compared"),
        F.count_if("similar").alias("n_matches"),
        F.max("rank").alias("last_rank"),
    )


def _published_cells(spark, sf_dir):
    inputs = t.inputs(spark, sf_dir)
    listed = matching.matches(inputs).select(
        "row_index", "rank", "repo_name", "stars", tx.repo_url(F.col("repo_name")).alias("url")
    )
    return listed, publish.summary_cells(inputs.seeds, listed)


@query
def found_in_projects(spark, sf_dir):
    return _published_cells(spark, sf_dir)[1]


@query
def found_column_update(spark, sf_dir):
    _, cells = _published_cells(spark, sf_dir)
    return sheet.update_found(t.seeds(spark, sf_dir), cells)


@query
def found_column_touched_files(spark, sf_dir):
    """The same by a stored sheet of eight files, of which those with a new cell are rewritten."""
    _, cells = _published_cells(spark, sf_dir)
    stored = SheetTable(spark, f"{shared_folder(spark)}/sheet-{uuid.uuid4().hex}")
    stored.create(t.seeds(spark, sf_dir), 8)
    stored.update(cells)
    return stored.read()


@query
def detail_rows(spark, sf_dir):
    inputs = t.inputs(spark, sf_dir)
    found = durable(matching.matches(inputs))
    return publish.detail_rows(
        inputs.seeds, repo.results(found, inputs.files, inputs.commits)
    )


@query
def detail_rows_with_heads(spark, sf_dir):
    """Detail rows where the commit lookups of toxic documents failed."""
    inputs = t.inputs(spark, sf_dir)
    labels = t.load(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("file_id"))
    heads = inputs.files.join(labels, "file_id", "left_semi").select(
        "file_id", F.concat(F.lit("head-"), "repo_name").alias("head_sha")
    )
    found = durable(matching.matches(inputs))
    return publish.detail_rows(inputs.seeds, repo.results(found, inputs.files, inputs.commits, heads))


@query
def matches_by_answers(spark, sf_dir):
    """A run on captured replies and answers; odd rows have no reply and are searched as usual."""
    inputs = t.inputs(spark, sf_dir)
    split = with_words(inputs.seeds.where("row_index % 2 = 0"), "code").where(F.size("words") >= 4)
    pair = lambda i: F.concat_ws(" ", F.get("words", F.lit(i)), F.get("words", F.lit(i + 1)))
    replies = split.select("row_index", F.to_json(F.array(pair(0), pair(2))).alias("reply"))
    scanners = t.readmes(spark, sf_dir).select(
        "repo_name", F.when(F.length("readme") > 2000, " yes\n").alias("answer")
    )
    quality = F.when(F.col("quality") == 1, "YES").otherwise("NO")
    similar = t.load(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id"), quality.alias("answer"))
    given = replace(
        t.plain_inputs(spark, sf_dir),
        given_patterns=pat.captured_patterns(replies),
        scanner_answers=scanners,
        similar_answers=similar,
    )
    return matching.matches(given).drop("flagged", "similar")


def _faulty_sheet(spark, sf_dir) -> DataFrame:
    """The seeds as a sheet read as text, in which row numbers are damaged or repeated, code has a
    byte that isn't text, and some rows are finished."""
    item = F.col("row_index") - 2
    number = F.when(item % 7 == 3, F.concat(F.lit("row "), F.col("row_index").cast("string")))
    number = number.when(item % 5 == 1, (F.col("row_index") - 1).cast("string"))
    code = F.encode("code", "UTF-8")
    return t.seeds(spark, sf_dir).select(
        number.otherwise(F.col("row_index").cast("string")).alias("row_index"),
        "cve_id",
        F.when(item % 9 == 4, F.concat(F.unhex(F.lit("FF")), code)).otherwise(code).alias("code"),
        F.when(item % 6 == 0, "an earlier result").otherwise("").alias("found"),
    )


def _row_status(spark, sf_dir) -> DataFrame:
    checked = durable(sheet.with_errors(sheet.typed_rows(_faulty_sheet(spark, sf_dir))))
    todo = sheet.pending(sheet.fine_rows(checked))
    found = matching.matches(replace(t.plain_inputs(spark, sf_dir), seeds=durable(todo)))
    return sheet.row_status(checked, found)


@query
def row_status(spark, sf_dir):
    """What a run does with each row of a faulty sheet."""
    return _row_status(spark, sf_dir)


@query
def run_summary_with_errors(spark, sf_dir):
    """Its counters: rows with an error aren't processed."""
    return sheet.status_counters(_row_status(spark, sf_dir))


@query
def seed_funnel(spark, sf_dir):
    return matching.funnel(t.inputs(spark, sf_dir))


def _resumed(spark, sf_dir):
    """A sheet whose seeds partly have results by a stricter share, and its next run."""
    inputs = t.inputs(spark, sf_dir)
    before = repo.best_per_seed(
        _compared(spark, sf_dir, EARLIER_SHARE).where("similar"), repo.MATCHES_PER_SEED
    ).withColumn("url", tx.repo_url(F.col("repo_name")))
    done = durable(sheet.update_found(inputs.seeds, publish.summary_cells(inputs.seeds, before)))
    todo = sheet.pending(done)
    found = matching.matches(replace(inputs, seeds=todo)).withColumn("url", tx.repo_url(F.col("repo_name")))
    return done, todo, durable(found)


@query
def run_summary(spark, sf_dir):
    """Counters of the resumed run: finished seeds are skipped, the others tried again."""
    done, _, found = _resumed(spark, sf_dir)
    return sheet.run_counters(done, found)


@query
def incremental_run(spark, sf_dir):
    """The sheet after the resumed run: finished seeds keep their cell."""
    done, todo, found = _resumed(spark, sf_dir)
    updated = sheet.update_found(done, publish.summary_cells(todo, found))
    return updated.select("row_index", "cve_id", "found")
