"""Updates that rewrite touched files only, and several writers."""

import pytest

from fixhound.schemas import SEEDS
from fixhound.sources.sheet_table import SheetTable

CELLS = "row_index bigint, found string"


def sheet(spark, n=100):
    return spark.createDataFrame([(i, f"CVE-{i}", "x", "v", "") for i in range(2, n + 2)], SEEDS)


def cells(spark, given):
    return spark.createDataFrame(list(given.items()), CELLS)


def found(table, version=None):
    return {r.row_index: r.found for r in table.read(version).where("found <> ''").collect()}


def paths(table):
    return {r.path for r in table.files(table.version()).collect()}


@pytest.fixture
def table(spark, tmp_path):
    made = SheetTable(spark, str(tmp_path / "sheet"))
    assert made.create(sheet(spark), 10) == 1
    return made


def test_only_touched_files_are_rewritten(spark, table):
    before = paths(table)
    assert len(before) == 10
    assert table.update(cells(spark, {2: "first", 101: "last"})) == 2
    after = paths(table)
    assert len(before - after) == 2 and len(before & after) == 8
    assert found(table) == {2: "first", 101: "last"} and found(table, 1) == {}
    assert table.read().count() == 100


def test_nothing_to_write_makes_no_version(spark, table):
    before = paths(table)
    for given in ({}, {5: None}, {1: "above"}, {1000: "below"}):
        assert table.update(cells(spark, given)) == 1
    assert paths(table) == before


def test_interleaved_updates_of_other_files_both_count(spark, table):
    other = SheetTable(spark, table._path)
    mine, theirs = table.prepare(cells(spark, {2: "a"})), other.prepare(cells(spark, {101: "b"}))
    assert other.commit(theirs) == 2 and table.commit(mine) == 3
    assert found(table) == {2: "a", 101: "b"}


def test_update_of_the_same_file_is_made_again(spark, table, monkeypatch):
    other = SheetTable(spark, table._path)
    stale = table.prepare(cells(spark, {2: "a"}))
    assert other.update(cells(spark, {3: "b"})) == 2
    assert table.commit(stale) is None
    prepared = iter([stale])
    again = table.prepare
    monkeypatch.setattr(table, "prepare", lambda given: next(prepared, None) or again(given))
    assert table.update(cells(spark, {2: "a"})) == 3
    assert found(table) == {2: "a", 3: "b"} and table.read().count() == 100


def test_version_is_taken_once(spark, table):
    mine = table.prepare(cells(spark, {2: "a"}))
    assert table._publish(2, mine)
    assert not table._publish(2, mine)
    assert table.version() == 2 and found(table) == {2: "a"}


def test_second_sheet_is_refused(spark, table):
    with pytest.raises(FileExistsError):
        table.create(sheet(spark, 3), 1)


def test_missing_sheet(spark, tmp_path):
    none = SheetTable(spark, str(tmp_path / "none"))
    assert none.version() == 0
    with pytest.raises(FileNotFoundError):
        none.read()


def test_rows_without_number_and_repeated_cells(spark, tmp_path):
    table = SheetTable(spark, str(tmp_path / "odd"))
    rows = [(None, "c", "x", "v", ""), (2, "c", "x", "v", ""), (2, "d", "x", "v", "")]
    table.create(spark.createDataFrame(rows, SEEDS), 1)
    twice = spark.createDataFrame([(2, "a"), (2, "b"), (None, "z")], CELLS)
    table.update(twice)
    assert sorted((r.row_index or 0, r.cve_id, r.found) for r in table.read().collect()) == [
        (0, "c", ""),
        (2, "c", "b"),
        (2, "d", "b"),
    ]
