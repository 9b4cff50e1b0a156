"""The fix report: fixes joined with commits, file changes and weakness classes."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixhound.functions.text import report_commit_url
from fixhound.operators.spread import hot_key_join

REPORT_SQL = Path(__file__).with_name("fix_report.sql")

# Fixed values of the report's filters.
LANGUAGE = "Python"
CWE_ID = "CWE-89"
MIN_SCORE = 55

PREVIEW_ROWS = 5
REPORT_COLUMNS = ("commit_url", "cve_id", "hash", "repo_url")


def run_sql_file(spark: SparkSession, path: str | Path, **args) -> DataFrame:
    """Run the query text of a file on the session's views. `args` fill its `:names`."""
    text = Path(path).read_text().strip().rstrip(";")
    return spark.sql(text, args=args or None)


def fix_report_sql(
    spark: SparkSession,
    language: str = LANGUAGE,
    cwe_id: str = CWE_ID,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """The report from its query text; needs the five tables as views."""
    return run_sql_file(
        spark, REPORT_SQL, language=language, cwe_id=cwe_id, min_score=min_score
    )


def fix_rows(
    tables: dict[str, DataFrame],
    language: str = LANGUAGE,
    cwe_id: str = CWE_ID,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """The report's rows without order, as existence tests on `fixes`.

    Its columns come from `fixes` alone, so every join is a left semi join on distinct keys.
    Copies of a fix go before the joins; a CVE or a commit with very many fixes is spread.
    """
    fixes = (
        tables["fixes"]
        .where(F.col("score") >= min_score)
        .select("cve_id", "hash", "repo_url")
    )
    classed = (
        tables["cwe_classification"]
        .where(F.col("cwe_id") == cwe_id)
        .select("cve_id")
        .distinct()
        .join(tables["cve"].select("cve_id").distinct(), "cve_id", "left_semi")
    )
    touched = (
        tables["file_change"]
        .where(F.col("programming_language") == language)
        .select("hash")
        .distinct()
        .join(tables["commits"].select("hash").distinct(), "hash", "left_semi")
    )
    of_class = hot_key_join(
        fixes.distinct(), classed, "cve_id", "left_semi", ["hash", "repo_url"], sample=fixes
    )
    kept = hot_key_join(
        of_class, touched, "hash", "left_semi", ["cve_id", "repo_url"], sample=fixes
    )
    return kept.select(
        report_commit_url(F.col("repo_url"), F.col("hash")).alias("commit_url"),
        "cve_id",
        "hash",
        "repo_url",
    )


def fix_report(tables: dict[str, DataFrame], **filters) -> DataFrame:
    """The rows in CVE order. The further sort keys split a CVE with very many fixes."""
    return fix_rows(tables, **filters).orderBy(
        F.col("cve_id").asc_nulls_last(), "hash", "repo_url"
    )


def row_count(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("n_rows"))


def preview(report: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in a total order."""
    return report.orderBy("cve_id", "hash", "repo_url", "commit_url").limit(rows)
