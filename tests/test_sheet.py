"""Sheets: cleaning, pending rows, updates, snapshots and sinks."""

import pytest
from pyspark.sql import functions as F

from fixhound.operators import sheet
from fixhound.plans.publish import detail_rows, result_cells, summary_cells
from fixhound.schemas import DETAIL_COLUMNS, SEEDS
from fixhound.sources.snapshots import SheetStore, append_details
from fixhound.sources.tables import read_sheet, write_report

RESULT = (
    "row_index bigint, rank int, repo_name string, stars bigint, url string, "
    "commit_url string, file_path string, code_snippet string, commit_sha string"
)


def seeds(spark, rows):
    return spark.createDataFrame(rows, SEEDS)


def test_falsy_cells_and_blank_rows(spark):
    rows = [(2, None, 0, False, "", "x"), (3, None, 0, False, "", ""), (4, 1.5, 7, True, "y", None)]
    raw = spark.createDataFrame(
        rows, "row_index bigint, a double, b int, c boolean, d string, e string"
    )
    cleaned = sheet.clean_rows(raw, ["a", "b", "c", "d", "e"]).orderBy("row_index").collect()
    assert [tuple(r) for r in cleaned] == [
        (2, "", "", "", "", "x"),
        (4, "1.5", "7", "True", "y", ""),
    ]


def test_pending_by_cell_length(spark):
    cells = ["", "None found", "x" * 11, None]
    df = seeds(spark, [(i, "c", "code", "v", cell) for i, cell in enumerate(cells)])
    assert sorted(r.row_index for r in sheet.pending(df).collect()) == [0, 1, 3]


def test_empty_snippet_has_no_code_but_a_cell(spark):
    df = seeds(spark, [(2, "c", "", "v", ""), (3, "c", None, "v", ""), (4, "c", "x", "v", "")])
    assert [r.row_index for r in sheet.has_code(df).collect()] == [4]
    cells = summary_cells(df, spark.createDataFrame([], RESULT))
    assert {r.found for r in cells.collect()} == {"None found"} and cells.count() == 3


def test_update_needs_the_column(spark):
    df = seeds(spark, [(2, "c", "x", "v", "")]).drop("found")
    with pytest.raises(ValueError):
        sheet.update_found(df, df)


def test_update_changes_given_rows_only(spark):
    df = seeds(spark, [(2, "a", "x", "v", "old"), (3, "b", "y", "v", "kept")])
    cells = spark.createDataFrame([(2, "new")], "row_index bigint, found string")
    updated = {r.row_index: r.found for r in sheet.update_found(df, cells).collect()}
    assert updated == {2: "new", 3: "kept"}


def test_default_only_for_absent_column(spark):
    df = seeds(spark, [(2, "", "x", None, "")])
    assert sheet.with_default(df, "cve_id", "N/A").first().cve_id == ""
    assert sheet.with_default(df.drop("cve_id"), "cve_id", "N/A").first().cve_id == "N/A"


def test_cells_follow_rank_and_details_have_eight_columns(spark):
    rows = [
        (2, 2, "b", 5, "u/b", None, "p", "s" * 30001, None),
        (2, 1, "a", 9, "u/a", "c", "p", "code", "sha"),
    ]
    results = spark.createDataFrame(rows, RESULT).repartition(2)
    assert result_cells(results).first().found == "a (9 stars) | u/a\nb (5 stars) | u/b"
    details = detail_rows(seeds(spark, [(2, "CVE-1", "x", "", "")]), results)
    assert tuple(details.columns) == DETAIL_COLUMNS
    by_name = {r["Repository Name"]: r for r in details.collect()}
    assert by_name["a"]["Vulnerability Type"] == ""
    assert by_name["b"]["Commit URL"] is None
    assert by_name["b"]["Code Snippet"].endswith("s\n... (truncated)")


def test_counters(spark):
    df = seeds(
        spark,
        [(2, "a", "x", "v", "done before"), (3, "b", "y", "v", ""), (4, "c", "z", "v", "None found")],
    )
    hit = spark.createDataFrame([(3,), (3,)], "row_index bigint")
    assert tuple(sheet.run_counters(df, hit).first()) == (3, 3, 1, 1, 1)


def test_first_rows(spark):
    df = seeds(spark, [(i, "c", "x", "v", "") for i in range(9, 1, -1)])
    assert [r.row_index for r in sheet.first_rows(df, 3).collect()] == [2, 3, 4]


def test_store_keeps_one_previous_version(spark, tmp_path):
    store = SheetStore(spark, str(tmp_path / "sheet"))
    with pytest.raises(FileNotFoundError):
        store.read()
    for n in range(1, 4):
        assert store.save(spark.range(n)) == n
    assert store.read().count() == 3
    assert store.read(back=1).count() == 2
    with pytest.raises(FileNotFoundError):
        store.read(back=2)
    store.save(store.read().where("id > 0"))
    assert (store.read().count(), store.read(back=1).count()) == (2, 3)


def test_broken_save_leaves_the_last_version(spark, tmp_path):
    store = SheetStore(spark, str(tmp_path / "sheet"))
    store.save(spark.range(5))
    broken = spark.range(9).select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.save(broken)
    assert store.read().count() == 5


def test_repeated_run_replaces_its_details(spark, tmp_path):
    path = str(tmp_path / "details")
    rows = spark.createDataFrame([("a", 1)], ["CVE ID", "Stars"])
    for run in ("1", "2", "2"):
        append_details(rows, path, run)
    assert spark.read.parquet(path).count() == 2


def test_csv_report_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    rows = [(2, "CVE-1", 'say "x"\nthen, y', "v", "None found")]
    write_report(seeds(spark, rows), path, "csv")
    assert [tuple(r) for r in read_sheet(spark, path, SEEDS, "csv").collect()] == rows
