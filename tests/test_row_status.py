"""Rows with errors, saving in parts, captured replies and answers, branch heads, reader options."""

import pytest
from pyspark.sql import functions as F

from fixhound import jobs
from fixhound.catalog import tables as t
from fixhound.operators import repositories as repo
from fixhound.operators import sheet
from fixhound.plans import matching
from fixhound.plans.publish import summary_cells
from fixhound.schemas import FILE_COMMITS, FILES, REPOS
from fixhound.sources import tables
from fixhound.sources.pair_index import PairIndex
from fixhound.sources.snapshots import SheetStore
from fixhound.streaming.incremental import match_results, run_batch
from tests.test_incremental import SF_DIR, details_at, full_sheet, inputs, one_full_run

RAW = "row_index string, cve_id string, code binary, found string"


def checked(spark):
    rows = [
        ("2", "a", b"fine", ""), ("3", "b", b"x", ""), (" 4 ", "c", b"x", ""), ("4", "d", b"y", "done long ago"),
        ("five", "e", b"x", ""), (None, "f", b"x", ""), ("1", "g", b"x", ""), ("6", "h", b"\xff\xfe", ""),
        ("7", "i", None, "finished a while ago"), ("8", "j", b"", "None found"), ("99999999999999999999", "k", b"x", ""),
    ]
    return sheet.with_errors(sheet.typed_rows(spark.createDataFrame(rows, RAW)))


def test_errors_of_rows(spark):
    messages = {r.cve_id: r.error for r in checked(spark).collect()}
    assert messages == {
        "a": None, "b": None, "c": "row number occurs 2 times", "d": "row number occurs 2 times",
        "e": "no row number", "f": "no row number", "g": "row number below the first row",
        "h": "code is not text", "i": None, "j": None, "k": "no row number",
    }
    assert {r.code for r in sheet.fine_rows(checked(spark)).collect()} == {"fine", "x", None, ""}


def test_status_and_counters(spark):
    found = spark.createDataFrame([(2,), (2,), (4,), (7,)], "row_index bigint")
    status = sheet.row_status(checked(spark), found)
    assert {r.cve_id: r.status for r in status.collect()} == {
        "a": "updated", "b": "none_found", "i": "skipped", "j": "none_found", **dict.fromkeys("cdefghk", "error")
    }
    assert sheet.status_counters(status).first().asDict() == {
        "total": 11, "processed": 4, "skipped": 1, "updated": 1, "none_found": 2, "errors": 7
    }
    none = sheet.row_status(checked(spark).where("false"), found)
    assert sheet.status_counters(none).first().total == 0


def test_rows_with_errors_stay_and_go_to_quarantine(spark, tmp_path):
    cells, details = one_full_run(spark)
    store = SheetStore(spark, str(tmp_path / "sheet"))
    bad = full_sheet(spark).where("row_index = 2").withColumn("row_index", F.lit(None).cast("bigint"))
    twice = full_sheet(spark).where("row_index = 3").withColumn("row_index", F.lit(900))
    store.save(full_sheet(spark).unionByName(bad).unionByName(twice).unionByName(twice))
    done = run_batch(spark, str(tmp_path / "sheet"), str(tmp_path / "details"), inputs(spark), str(tmp_path / "bad"))
    counters = done.first()
    assert (counters.total, counters.processed, counters.errors) == (43, 40, 3)
    kept = store.read()
    assert {r.row_index: r.found for r in kept.where("row_index < 900").collect()} == cells
    assert {r.found for r in kept.where("row_index IS NULL OR row_index = 900").collect()} == {""}
    assert details_at(spark, str(tmp_path / "details")) == details
    assert sorted(r.message for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [
        "no row number", "row number occurs 2 times", "row number occurs 2 times"
    ]


def test_saving_in_parts_gives_the_same_sheet(spark, tmp_path):
    cells, details = one_full_run(spark)
    store = SheetStore(spark, str(tmp_path / "sheet"))
    store.save(full_sheet(spark))
    counters = run_batch(spark, str(tmp_path / "sheet"), str(tmp_path / "details"), inputs(spark), saves=3).first()
    assert store.version() == 4
    assert counters.updated == sum(v != "None found" for v in cells.values())
    assert {r.row_index: r.found for r in store.read().collect()} == cells
    assert details_at(spark, str(tmp_path / "details")) == details


def test_an_index_gives_the_same_matches(spark, tmp_path):
    given = inputs(spark)
    index = PairIndex(spark, str(tmp_path / "index"), range_bits=2)
    index.append(given.files)
    by_index = matching.Inputs(given.seeds, given.files, given.repos, given.commits, index=index)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(matching.matches(by_index)) == rows(matching.matches(given))


def test_rounds_compare_no_more_than_needed(spark):
    given = inputs(spark)
    listed = matching.shortlist(matching.candidates(given))
    done = matching.matches_in_rounds(given, listed, min_share=0.0, limit=2)
    every = repo.similar_by_share(listed, given.seeds, given.files, 0.0)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(repo.best_per_seed(done.where("similar"), 2)) == rows(repo.best_per_seed(every.where("similar"), 2))
    by_seed = {}
    for r in sorted(every.collect(), key=lambda r: r["rank"]):
        by_seed.setdefault(r.row_index, []).append(r.similar)
    wanted = 0
    for flags in by_seed.values():
        hits = [i + 1 for i, f in enumerate(flags) if f]
        wanted += hits[1] if len(hits) > 1 else len(flags)
    assert done.count() == wanted < every.count()


def test_heads_replace_commits_of_failed_lookups(spark):
    matches = spark.createDataFrame([(2, 1, "r", 5, 10), (2, 2, "s", 4, 11), (3, 1, "r", 5, 12)], "row_index bigint, rank int, repo_name string, stars bigint, file_id bigint")
    files = spark.createDataFrame([(i, "r", f"p{i}", "text") for i in (10, 11, 12)], FILES)
    commits = spark.createDataFrame([(10, 1, "c10", None), (11, 2, "c11", None)], FILE_COMMITS)
    heads = spark.createDataFrame([(11, "main"), (12, None), (77, "other"), (11, "main")], "file_id bigint, head_sha string")
    got = {r.file_path: (r.commit_sha, r.commit_url) for r in repo.results(matches, files, commits, heads).collect()}
    assert got == {"p10": ("c10", "https://github.com/r/commit/c10"), "p11": ("main", "https://github.com/s/commit/main"), "p12": (None, None)}


def test_search_job_with_captured_tables(spark, tmp_path):
    given = inputs(spark)
    path = lambda name: str(tmp_path / name)
    full_sheet(spark).write.parquet(path("seeds"))
    given.files.write.parquet(path("files"))
    given.repos.withColumn("description", F.lit("")).write.parquet(path("repos"))
    given.commits.withColumn("committed_at", F.col("committed_at").cast("timestamp")).write.parquet(path("commits"))
    text = given.files.where("file_id = 5").first().content.split()
    reply = f'["{text[0]} {text[1]}", "no such words"]'
    spark.createDataFrame([(2, reply), (3, "[]"), (4, "oops")], "row_index bigint, reply string").write.parquet(path("replies"))
    spark.createDataFrame([(r.repo_name, "YES") for r in given.repos.limit(3).collect()], "repo_name string, answer string").write.parquet(path("scanners"))
    spark.createDataFrame([(5, "no")], "file_id bigint, answer string").write.parquet(path("similar"))
    spark.createDataFrame([(k, "head") for k in range(300)], "file_id bigint, head_sha string").write.parquet(path("heads"))
    jobs.main(["index", "--index", path("index"), "--files", path("files")])
    args = [x for name in ("seeds", "files", "repos", "commits", "details", "sheet", "index", "replies", "heads", "quarantine") for x in (f"--{name}", path(name))]
    jobs.main(["search", "--scanner-answers", path("scanners"), "--similar-answers", path("similar"), "--saves", "2", *args])
    read = lambda name, schema: spark.read.schema(schema).parquet(path(name))
    expected = match_results(
        matching.Inputs(
            full_sheet(spark), read("files", FILES), read("repos", REPOS), read("commits", FILE_COMMITS),
            given_patterns=spark.createDataFrame([(2, 1, f"{text[0]} {text[1]}"), (2, 2, "no such words")], "row_index bigint, pattern_no int, pattern string"),
            scanner_answers=spark.read.parquet(path("scanners")),
            similar_answers=spark.read.parquet(path("similar")),
            heads=spark.read.parquet(path("heads")),
        )
    )
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(SheetStore(spark, path("sheet")).read().select("row_index", "found")) == rows(summary_cells(full_sheet(spark), expected))
    assert all(d[5].endswith("/commit/head") for d in details_at(spark, path("details")))


def test_reader_options_of_a_database():
    split = {"partitionColumn": "id", "lowerBound": 1, "upperBound": 9, "numPartitions": 4}
    assert tables.jdbc_options("jdbc:x", "fixes", split, user="u") == {
        "url": "jdbc:x", "dbtable": "fixes", "user": "u",
        "partitionColumn": "id", "lowerBound": "1", "upperBound": "9", "numPartitions": "4",
    }
    assert tables.jdbc_options("jdbc:x", "cve") == {"url": "jdbc:x", "dbtable": "cve"}
    with pytest.raises(ValueError, match="fixes needs"):
        tables.jdbc_options("jdbc:x", "fixes", {"partitionColumn": "id"})


def test_no_seeds(spark, tmp_path):
    store = SheetStore(spark, str(tmp_path / "sheet"))
    store.save(full_sheet(spark).where("false"))
    assert run_batch(spark, str(tmp_path / "sheet"), str(tmp_path / "details"), t.inputs(spark, SF_DIR), saves=2).first().total == 0
