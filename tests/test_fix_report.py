"""The fix report on hand-made rows."""

import pytest

from fixhound import jobs
from fixhound.operators import spread
from fixhound.plans import fix_report as report
from fixhound.schemas import FIX_TABLES
from fixhound.sources.tables import register_views


def make(spark, **rows):
    return {
        name: spark.createDataFrame(rows.get(name, []), schema)
        for name, schema in FIX_TABLES.items()
    }


def change(commit, language="Python", name="f.py"):
    return (commit, name, 1, 0, "before", "after", "diff", language)


def both(spark, tables):
    """The rows of the two forms, which must agree in order as well."""
    register_views(tables)
    by_sql = [tuple(r) for r in report.fix_report_sql(spark).collect()]
    by_semi = [tuple(r) for r in report.fix_report(tables).collect()]
    assert by_sql == by_semi
    return by_sql


@pytest.fixture
def tables(spark):
    return make(
        spark,
        file_change=[change("h1"), change("h1", name="g.py"), change("h1", name="h.py"), change("h2"),
                     change("h3", "python"), change("h4")],
        commits=[("h1",), ("h1",), ("h2",), ("h3",), ("h4",)],
        fixes=[
            ("CVE-2", "h1", "u/a", 55.0),
            ("CVE-2", "h1", "u/a", 60.0),
            ("CVE-2", "h1", "u/b", 99.0),
            ("CVE-1", "h2", None, 70.0),
            ("CVE-1", "h2", "u/low", 54.0),
            ("CVE-1", "h2", "u/null", None),
            ("CVE-1", "h3", "u/case", 80.0),
            ("CVE-3", "h4", "u/class", 80.0),
            ("CVE-4", "h4", "u/unknown", 80.0),
            (None, "h4", "u/none", 80.0),
        ],
        cve=[("CVE-1",), ("CVE-2",), ("CVE-2",), ("CVE-3",)],
        cwe_classification=[("CVE-1", "CWE-89"), ("CVE-2", "CWE-89"), ("CVE-2", "CWE-79"),
                            ("CVE-3", "CWE-79"), ("CVE-4", "CWE-89")],
    )


EXPECTED = [
    ("/commit/h2", "CVE-1", "h2", None),
    ("u/a/commit/h1", "CVE-2", "h1", "u/a"),
    ("u/b/commit/h1", "CVE-2", "h1", "u/b"),
]


def test_filters_joins_and_distinct(spark, tables):
    assert both(spark, tables) == EXPECTED


def test_heavy_keys_give_the_same_report(spark, tables, monkeypatch):
    monkeypatch.setattr(spread, "SPREAD_FROM_ROWS", 1)
    assert spread.heavy_keys(tables["fixes"], "hash")
    assert both(spark, tables) == EXPECTED


def test_summary_and_preview(spark, tables):
    rows = report.fix_rows(tables)
    assert report.row_count(rows).first().n_rows == 3
    assert [tuple(r) for r in report.preview(rows, 2).collect()] == EXPECTED[:2]


def test_query_text_with_its_own_constants(spark, tables, tmp_path):
    register_views(tables)
    path = tmp_path / "own.sql"
    path.write_text("\n\nSELECT DISTINCT f.hash FROM file_change f, commits c\nWHERE f.hash = c.hash;\n\n")
    assert report.run_sql_file(spark, path).count() == 4


def test_job_writes_the_report(spark, tables, tmp_path):
    for name, table in tables.items():
        table.write.parquet(str(tmp_path / "db" / name))
    jobs.main(["fix-report", "--tables", str(tmp_path / "db"), "--out", str(tmp_path / "out")])
    jobs.main(["fix-report", "--tables", str(tmp_path / "db"), "--out", str(tmp_path / "out")])
    rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(rows, key=str) == sorted(EXPECTED, key=str)
