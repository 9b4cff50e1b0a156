"""What a run publishes: a summary cell per seed and a detail row per match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixhound.functions.text import detail_cell, entry_line
from fixhound.operators.sheet import with_default, with_none_found
from fixhound.schemas import DETAIL_COLUMNS


def result_cells(results: DataFrame) -> DataFrame:
    """The matches of a seed as one text, a line each, in rank order (at most five)."""
    line = entry_line(F.col("repo_name"), F.col("stars"), F.col("url"))
    lines = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return results.groupBy("row_index").agg(
        F.array_join(lines["line"], "\n").alias("found")
    )


def summary_cells(seeds: DataFrame, results: DataFrame) -> DataFrame:
    """`row_index, found` for every seed, with the "none" text where nothing matched."""
    return with_none_found(seeds, result_cells(results))


def detail_rows(seeds: DataFrame, results: DataFrame) -> DataFrame:
    """The eight published columns; defaults only where the sheet lacks a column."""
    described = with_default(with_default(seeds, "cve_id", "N/A"), "vulnerability", "Unknown")
    rows = results.join(
        described.select("row_index", "cve_id", "vulnerability"), "row_index"
    )
    fields = ("cve_id", "vulnerability", "repo_name", "stars", "url", "commit_url", "file_path")
    return rows.select(
        *[F.col(field).alias(name) for field, name in zip(fields, DETAIL_COLUMNS)],
        detail_cell(F.col("code_snippet")).alias(DETAIL_COLUMNS[-1]),
    )
