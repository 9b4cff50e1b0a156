"""Resumed runs, in batch and as a stream."""

from pyspark.sql import functions as F

from fixhound import jobs
from fixhound.catalog import tables as t
from fixhound.plans.matching import Inputs
from fixhound.plans.publish import detail_rows, summary_cells
from fixhound.sources.snapshots import SheetStore
from fixhound.streaming.incremental import match_results, run_batch, stream_seeds

SF_DIR = "/root/testdata/sf0.001"


def full_sheet(spark):
    seeds = t.seeds(spark, SF_DIR).withColumn("vulnerability", F.lit("SQL injection"))
    return seeds.select("row_index", "cve_id", "code", "vulnerability", "found")


def inputs(spark):  # patterns are taken anew
    return t.plain_inputs(spark, SF_DIR)


def one_full_run(spark):
    found = match_results(Inputs(full_sheet(spark), *_rest(inputs(spark))))
    cells = summary_cells(full_sheet(spark), found)
    return (
        {r.row_index: r.found for r in cells.collect()},
        sorted(map(tuple, detail_rows(full_sheet(spark), found).collect()), key=str),
    )


def _rest(given):
    return given.files, given.repos, given.commits


def details_at(spark, path):
    return sorted((tuple(r) for r in spark.read.parquet(path).drop("run").collect()), key=str)


def test_two_runs_equal_one(spark, tmp_path):
    cells, details = one_full_run(spark)
    store = SheetStore(spark, str(tmp_path / "sheet"))
    half = F.col("row_index") < 20
    waiting = F.when(half, "").otherwise("held back until later")
    store.save(full_sheet(spark).withColumn("found", waiting))
    run = lambda: run_batch(
        spark, str(tmp_path / "sheet"), str(tmp_path / "details"), inputs(spark)
    ).first()
    first = run()
    assert (first.total, first.skipped) == (40, 22)
    released = F.when(half, F.col("found")).otherwise("")
    store.save(store.read().withColumn("found", released))
    second = run()
    assert second.updated == sum(v != "None found" for k, v in cells.items() if k >= 20)
    assert {r.row_index: r.found for r in store.read().collect()} == cells
    assert details_at(spark, str(tmp_path / "details")) == details


def test_a_run_after_the_last_tries_only_the_unfound(spark, tmp_path):
    path = str(tmp_path / "sheet")
    SheetStore(spark, path).save(full_sheet(spark))
    run_batch(spark, path, str(tmp_path / "details"), inputs(spark))
    again = run_batch(spark, path, str(tmp_path / "details"), inputs(spark)).first()
    assert again.updated == 0 and again.skipped + again.none_found == again.total


def test_stream_in_parts_equals_one_run(spark, tmp_path):
    cells, details = one_full_run(spark)
    seeds, out = str(tmp_path / "seeds"), str(tmp_path / "out")
    run = lambda: stream_seeds(
        spark, seeds, out, str(tmp_path / "state"), inputs(spark), files_per_part=1
    ).awaitTermination()
    full_sheet(spark).where("row_index < 15").coalesce(1).write.parquet(seeds)
    run()
    full_sheet(spark).where("row_index >= 15").repartition(2).write.mode("append").parquet(seeds)
    run()
    run()
    written = spark.read.parquet(f"{out}/cells")
    assert written.select("run").distinct().count() == 3
    assert {r.row_index: r.found for r in written.collect()} == cells
    assert details_at(spark, f"{out}/details") == details


def test_search_job(spark, tmp_path):
    paths = {name: str(tmp_path / name) for name in ("seeds", "files", "repos", "commits")}
    given = inputs(spark)
    full_sheet(spark).write.parquet(paths["seeds"])
    given.files.write.parquet(paths["files"])
    given.repos.withColumn("description", F.lit(None).cast("string")).write.parquet(paths["repos"])
    given.commits.withColumn("committed_at", F.col("committed_at").cast("timestamp")).write.parquet(
        paths["commits"]
    )
    args = [x for name, path in paths.items() for x in (f"--{name}", path)]
    sheet, details = str(tmp_path / "sheet"), str(tmp_path / "details")
    jobs.main(["search", "--sheet", sheet, "--details", details, *args])
    cells, rows = one_full_run(spark)
    assert {r.row_index: r.found for r in SheetStore(spark, sheet).read().collect()} == cells
    assert details_at(spark, details) == rows


def test_partitioning_of_the_input_does_not_matter(spark):
    given = inputs(spark)
    cells, _ = one_full_run(spark)
    scattered = Inputs(
        full_sheet(spark).repartition(5),
        given.files.repartition(13, F.xxhash64("content")),
        given.repos.repartition(3),
        given.commits.repartition(4, "sha"),
    )
    found = match_results(scattered)
    assert {r.row_index: r.found for r in summary_cells(scattered.seeds, found).collect()} == cells
