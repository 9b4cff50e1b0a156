"""Seed sheets: cleaning, pending work, keyed update of the result column, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixhound.functions.cells import cell_text
from fixhound.functions.text import NONE_FOUND

# A result cell longer than this is a finished row. `None found` has exactly this length,
# so such rows are tried again.
FINISHED_CHARS = 10
# The row under the header.
FIRST_ROW = 2


def clean_rows(sheet: DataFrame, cells: list[str]) -> DataFrame:
    """Falsy cells become "", and rows with no other cell go. Row numbers stay."""
    texts = sheet.select("row_index", *[cell_text(sheet, c).alias(c) for c in cells])
    return texts.where(F.concat_ws("", *cells) != "")


def with_default(df: DataFrame, name: str, default: str) -> DataFrame:
    """Add a column that the sheet lacks. Empty cells of a present one stay empty."""
    return df if name in df.columns else df.withColumn(name, F.lit(default))


def first_rows(seeds: DataFrame, n: int) -> DataFrame:
    return seeds.orderBy("row_index").limit(n)


def is_pending(found: Column) -> Column:
    return F.length(F.coalesce(found, F.lit(""))) <= FINISHED_CHARS


def pending(seeds: DataFrame) -> DataFrame:
    return seeds.where(is_pending(F.col("found")))


def has_code(seeds: DataFrame) -> DataFrame:
    return seeds.where(F.coalesce(F.col("code"), F.lit("")) != "")


def with_none_found(seeds: DataFrame, cells: DataFrame) -> DataFrame:
    """One summary cell per seed: `row_index, found`."""
    return seeds.select("row_index").join(cells, "row_index", "left").select(
        "row_index", F.coalesce("found", F.lit(NONE_FOUND)).alias("found")
    )


def update_found(sheet: DataFrame, cells: DataFrame) -> DataFrame:
    """Write new cells into the result column by row number; other cells stay."""
    if "found" not in sheet.columns:
        raise ValueError("the sheet has no column for results")
    fresh = cells.select("row_index", F.col("found").alias("_fresh"))
    return (
        sheet.join(fresh, "row_index", "left")
        .withColumn("found", F.coalesce("_fresh", "found"))
        .drop("_fresh")
    )


def typed_rows(raw: DataFrame) -> DataFrame:
    """Rows of a sheet read as text: row numbers as numbers, null for a cell that isn't one."""
    return raw.withColumn("row_index", F.expr("try_cast(row_index AS BIGINT)"))


def with_errors(sheet: DataFrame) -> DataFrame:
    """Add `error`, which says why a row can't be handled; null for all others.

    A row has an error if its number is missing or below the first row's, if another row has the same
    number, or if its code is bytes that aren't text. The others go on without it.
    """
    number = F.col("row_index")
    same = sheet.where(number.isNotNull()).groupBy("row_index").agg(F.count("*").alias("_rows"))
    repeated = same.where("_rows > 1")
    message = F.when(number.isNull(), "no row number")
    message = message.when(number < FIRST_ROW, "row number below the first row")
    message = message.when(F.col("_rows").isNotNull(), F.concat(F.lit("row number occurs "), "_rows", F.lit(" times")))
    if dict(sheet.dtypes).get("code") == "binary":
        readable = F.try_validate_utf8(F.col("code").cast("string"))
        message = message.when(F.col("code").isNotNull() & readable.isNull(), "code is not text")
    return sheet.join(repeated, "row_index", "left").withColumn("error", message).drop("_rows")


def fine_rows(checked: DataFrame) -> DataFrame:
    """The rows without an error, with their code as text."""
    return checked.where("error IS NULL").drop("error").withColumn("code", F.col("code").cast("string"))


def row_status(checked: DataFrame, results: DataFrame) -> DataFrame:
    """What a run did with each row: `error`, `skipped`, `updated` or `none_found`, with the message."""
    hit = results.select("row_index").distinct().withColumn("_hit", F.lit(True))
    status = (
        F.when(F.col("error").isNotNull(), "error")
        .when(~is_pending(F.col("found")), "skipped")
        .when(F.col("_hit"), "updated")
        .otherwise("none_found")
    )
    joined = checked.join(hit, "row_index", "left").withColumn("status", status)
    return joined.select("row_index", "cve_id", "status", F.col("error").alias("message"))


def status_counters(status: DataFrame) -> DataFrame:
    """Totals of one run: rows with an error aren't processed, skipped ones are."""
    of = lambda name: F.count_if(F.col("status") == name)
    return status.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") != "error").alias("processed"),
        of("skipped").alias("skipped"),
        of("updated").alias("updated"),
        of("none_found").alias("none_found"),
        of("error").alias("errors"),
    )


def run_counters(seeds: DataFrame, results: DataFrame) -> DataFrame:
    """Totals of one run: a skipped row counts as processed, only found ones as updated."""
    hit = results.select("row_index").distinct().withColumn("_hit", F.lit(True))
    todo = is_pending(F.col("found"))
    return seeds.join(hit, "row_index", "left").agg(
        F.count("*").alias("total"),
        F.count("*").alias("processed"),
        F.count_if(~todo).alias("skipped"),
        F.count_if(todo & F.col("_hit").isNotNull()).alias("updated"),
        F.count_if(todo & F.col("_hit").isNull()).alias("none_found"),
    )
