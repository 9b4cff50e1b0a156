"""Declared schemas of the tables the jobs read. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


# The vulnerability database.
FILE_CHANGE = _struct(
    hash=StringType(),
    filename=StringType(),
    num_lines_added=IntegerType(),
    num_lines_deleted=IntegerType(),
    code_before=StringType(),
    code_after=StringType(),
    diff_parsed=StringType(),
    programming_language=StringType(),
)
COMMITS = _struct(hash=StringType())
FIXES = _struct(
    cve_id=StringType(), hash=StringType(), repo_url=StringType(), score=DoubleType()
)
CVE = _struct(cve_id=StringType())
CWE_CLASSIFICATION = _struct(cve_id=StringType(), cwe_id=StringType())

FIX_TABLES = {
    "file_change": FILE_CHANGE,
    "commits": COMMITS,
    "fixes": FIXES,
    "cve": CVE,
    "cwe_classification": CWE_CLASSIFICATION,
}

# The search job. `row_index` is the physical row of the sheet and starts at 2.
SEEDS = _struct(
    row_index=LongType(),
    cve_id=StringType(),
    code=StringType(),
    vulnerability=StringType(),
    found=StringType(),
)
FILES = _struct(
    file_id=LongType(), repo_name=StringType(), file_path=StringType(), content=StringType()
)
REPOS = _struct(
    repo_name=StringType(),
    stars=LongType(),
    description=StringType(),
    fork=BooleanType(),
    archived=BooleanType(),
    flagged=BooleanType(),
)
FILE_COMMITS = _struct(
    file_id=LongType(), commit_id=LongType(), sha=StringType(), committed_at=TimestampType()
)

# Captured replies and answers, and heads of branches where a commit lookup failed.
PATTERN_REPLIES = _struct(row_index=LongType(), reply=StringType())
SCANNER_ANSWERS = _struct(repo_name=StringType(), answer=StringType())
SIMILAR_ANSWERS = _struct(file_id=LongType(), answer=StringType())
HEADS = _struct(file_id=LongType(), head_sha=StringType())

# Columns of the published detail table, in their fixed order.
DETAIL_COLUMNS = (
    "CVE ID",
    "Vulnerability Type",
    "Repository Name",
    "Stars",
    "Repository URL",
    "Commit URL",
    "File Path",
    "Code Snippet",
)
