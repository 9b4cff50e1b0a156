"""Resumable runs: finished seeds are skipped, and progress is saved part by part."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fixhound.operators.repositories import results
from fixhound.operators.sheet import (
    fine_rows,
    pending,
    row_status,
    status_counters,
    update_found,
    with_errors,
)
from fixhound.operators.spread import durable
from fixhound.plans.matching import Inputs, matches
from fixhound.plans.publish import detail_rows, summary_cells
from fixhound.schemas import SEEDS
from fixhound.sources.snapshots import SheetStore, append_details


def match_results(inputs: Inputs) -> DataFrame:
    """The published fields of all matches, computed once."""
    found = durable(matches(inputs))
    return durable(results(found, inputs.files, inputs.commits, inputs.heads))


def run_batch(
    spark: SparkSession,
    sheet_path: str,
    details_path: str,
    inputs: Inputs,
    quarantine_path: str | None = None,
    saves: int = 1,
) -> DataFrame:
    """Match the pending seeds of a stored sheet, add detail rows and save the sheet.

    `inputs.seeds` is not read; the store's sheet takes its place. The seeds are handled in `saves`
    parts of about the same size, and the sheet is saved after each, so a run that dies
    loses one part. Details are written before the sheet: a part that is repeated replaces
    its own rows. Rows with an error stay as they are, don't stop the others, and go to the quarantine
    table with their message. Returns the counters of the run.
    """
    store = SheetStore(spark, sheet_path)
    checked = durable(with_errors(store.read()))
    if quarantine_path:
        failed = row_status(checked, checked.where("false")).where("status = 'error'")
        append_details(failed, quarantine_path, str(store.version()))
    todo = durable(pending(fine_rows(checked)))
    hits = []
    for part in _parts(todo, saves):
        sheet = store.read()
        found = match_results(replace(inputs, seeds=part))
        append_details(detail_rows(part, found), details_path, str(store.version()))
        store.save(update_found(sheet, summary_cells(part, found)))
        hits.append(found.select("row_index"))
    return status_counters(row_status(checked, reduce(DataFrame.unionByName, hits)))


def _parts(seeds: DataFrame, n: int) -> list[DataFrame]:
    """The seeds in n ranges of row numbers of about the same size."""
    if n <= 1:
        return [seeds]
    cuts = seeds.approxQuantile("row_index", [k / n for k in range(1, n)], 0.01)
    bounds = [None, *sorted({int(c) for c in cuts}), None]
    number = F.col("row_index")
    return [
        seeds.where(F.lit(True) if low is None else number > low).where(F.lit(True) if high is None else number <= high)
        for low, high in zip(bounds, bounds[1:])
    ]


def stream_seeds(
    spark: SparkSession,
    seeds_path: str,
    out_path: str,
    checkpoint_path: str,
    inputs: Inputs,
    files_per_part: int | None = None,
) -> StreamingQuery:
    """Match seed files as they arrive; stop when all present ones are done.

    All waiting files are one part, which reads the corpus once for all its seeds;
    `files_per_part` makes parts smaller at the price of a pass over the corpus for each.
    Finished files are remembered in the checkpoint. A part that is repeated after a
    failure overwrites its own output, because that is keyed by the batch number.
    """

    def publish(seeds: DataFrame, batch: int) -> None:
        todo = durable(pending(seeds))
        found = match_results(replace(inputs, seeds=todo))
        append_details(detail_rows(todo, found), f"{out_path}/details", str(batch))
        cells = summary_cells(todo, found)
        cells.write.mode("overwrite").parquet(f"{out_path}/cells/run={batch}")

    reader = spark.readStream.schema(SEEDS)
    if files_per_part is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_part)
    return (
        reader.parquet(seeds_path)
        .writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
