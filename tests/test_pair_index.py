"""The stored index: lookups, patterns and incremental hits against searches in texts."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fixhound.catalog import tables as t
from fixhound.operators import indexed, patterns, search
from fixhound.plans.matching import Inputs
from fixhound.plans.publish import summary_cells
from fixhound.sources import pair_index
from fixhound.sources.pair_index import PairIndex
from fixhound.sources.snapshots import SheetStore
from fixhound.streaming.hit_state import HitState, run_incremental
from fixhound.streaming.incremental import match_results
from tests.test_plans import plan_of
from tests.test_search import FILES, SEEDS, corpus, holds, ways  # noqa: F401

SF_DIR = "/root/testdata/sf0.001"
GIVEN = ["of", "the SAME", "the same", "same text as", "w1 end1 a b", "of the w1 end1 a b", "x", "a a", "a a a",
         "the same text as in all the other copies of it", "the same text as in some", "not there"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute(rows):
    return sorted(((g, f[0], f[1]) for g in GIVEN for f in rows if holds(f[3] or "", g.lower())), key=str)


def given(spark):
    return spark.createDataFrame([(g,) for g in GIVEN], "pattern string")


def test_lookups_over_versions_and_changed_files(spark, tmp_path, ways):  # noqa: F811
    rows, _ = corpus(spark, 60)
    rows += [(9000, "r1", "p", "a a a a b"), (9001, "r2", "p", None), (9002, None, "p", " x "), (-5, "r3", "p", "of the same")]
    index = PairIndex(spark, str(tmp_path / "index"), range_bits=3)
    assert index.append(spark.createDataFrame(rows[:40], FILES)) == 1
    assert rows_of(indexed.indexed_places(index, given(spark))) == brute(rows[:40])
    assert index.append(spark.createDataFrame(rows[40:], FILES)) == 2
    assert index.log() == {1: 0, 2: 0}
    assert rows_of(indexed.indexed_places(index, given(spark))) == brute(rows)
    changed = [(3, "r9", "p", "of the w1 end1 a b"), (9000, "r1", "p", "nothing"), (70, "r0", "p", "a a a")]
    index.append(spark.createDataFrame(changed, FILES))
    assert index.log()[3] == 2
    now = {r[0]: r for r in rows + changed}
    assert rows_of(indexed.indexed_places(index, given(spark))) == brute(now.values())
    counts = {r.gram: r.n_files for r in indexed.file_counts(index, spark.createDataFrame([("of the",), ("a a",), ("q q",)], "gram string")).collect()}
    assert counts == {g: sum(holds(f[3] or "", g) for f in now.values()) for g in ("of the", "a a")}


def test_capped_hits_equal_those_of_texts(spark, tmp_path):
    _, files = corpus(spark)
    index = PairIndex(spark, str(tmp_path / "index"), range_bits=2)
    index.append(files)
    listed = spark.createDataFrame([(2, 1, "of the"), (3, 1, "of the"), (3, 2, "end5 a"), (4, 1, "it")], "row_index bigint, pattern_no int, pattern string")
    assert rows_of(indexed.indexed_hits(index, listed)) == rows_of(search.seed_hits(listed, files))


@pytest.mark.parametrize("width", [1, 64])
def test_rare_patterns_for_any_width_of_the_sketch(spark, tmp_path, width):
    files = t.files(spark, SF_DIR)
    seeds = t.seeds(spark, SF_DIR).select("row_index", "code").unionByName(
        spark.createDataFrame([(900, "no such pair anywhere"), (901, ""), (902, None), (903, "the")], SEEDS)
    )
    index = PairIndex(spark, str(tmp_path / "index"), range_bits=2, sketch_width=width)
    for part in t.corpus_parts(spark, SF_DIR):
        index.append(part)
    expected = rows_of(patterns.rare_seed_patterns(seeds, files))
    assert rows_of(indexed.rare_patterns(index, seeds)) == expected
    if width == 64:
        # changed files make lower bounds worthless, and the result stays right
        twice = files.where("file_id < 20")
        index.append(twice)
        assert rows_of(indexed.rare_patterns(index, seeds)) == expected


def test_few_finalists_with_a_wide_sketch(spark, tmp_path):
    index = PairIndex(spark, str(tmp_path / "index"), range_bits=2)
    index.append(t.files(spark, SF_DIR))
    pairs = t.seeds(spark, SF_DIR).select(F.explode(F.split("code", " ")).alias("gram"))
    exact = {r.gram: r.n_files for r in indexed.file_counts(index, pairs).collect()}
    bounds = {r.gram: (r.low, r.high) for r in index.bounds(pairs).collect()}
    assert set(exact) <= set(bounds)
    assert all(bounds[g][0] <= n <= bounds[g][1] for g, n in exact.items())
    assert sum(low == high for low, high in bounds.values()) > 0.9 * len(bounds)


def test_a_version_without_log_entry_is_not_read(spark, tmp_path):
    rows, files = corpus(spark, 30)
    index = PairIndex(spark, str(tmp_path / "index"), range_bits=2)
    index.append(files)
    index._write(files.select(F.col("file_id") + 1000, "repo_name"), "names", 2)
    index._write(index._posted(files.withColumn("file_id", F.col("file_id") + 1000)), "postings", 2, "range")
    assert index.version() == 1
    assert rows_of(indexed.indexed_places(index, given(spark))) == brute(rows)
    assert index.append(spark.createDataFrame([(500, "r", "p", "a a")], FILES)) == 2
    assert rows_of(indexed.indexed_places(index, given(spark))) == brute([*rows, (500, "r", "p", "a a")])


def test_lookups_open_touched_ranges_and_new_versions_only(spark, tmp_path):
    _, files = corpus(spark)
    index = PairIndex(spark, str(tmp_path / "index"), range_bits=2)
    for k in range(3):
        index.append(files.withColumn("file_id", F.col("file_id") + 1000 * k))
    grams = spark.createDataFrame([("of the",)], "gram string")
    plan = plan_of(index.postings(grams, newer_than=2).join(grams, "gram"))
    assert re.search(r"PartitionFilters: \[.*version#\d+L? = 3\)?.*range#\d+ = \d+", plan), plan
    assert "content" not in plan
    counted = plan_of(indexed.file_counts(index, grams))
    assert "ReadSchema: struct<gram:string,n_files:int>" in counted


def test_hits_of_several_runs_equal_one_full_search(spark, tmp_path):
    rows, _ = corpus(spark, 90)
    listed = spark.createDataFrame([(2, 1, "of the"), (2, 2, "the same"), (3, 1, "of the"), (4, 1, "end5 a"), (5, 1, "of the w1 end1 a b"), (6, 1, "nowhere at all")], "row_index bigint, pattern_no int, pattern string")
    index, state = PairIndex(spark, str(tmp_path / "index"), range_bits=2), HitState(spark, str(tmp_path / "state"))
    steps = [
        (rows[50:], "row_index < 4"),
        (rows[:50], "row_index > 1"),
        ([(1, "r1", "p", "gone"), (0, "r0", "p", "of the nowhere at all")], "true"),
        ([], "true"),
    ]
    for files, part in steps:
        if files:
            index.append(spark.createDataFrame(files, FILES))
        wanted = listed.where(part)
        marks = {r.pattern: r.mark for r in state.marked(index, wanted).collect()}
        assert rows_of(state.hits_of(index, wanted)) == rows_of(indexed.indexed_hits(index, wanted))
    # the last run looks for nothing again, and its marks are the newest version
    assert set(marks.values()) == {3}


def test_incremental_runs_equal_one_run_over_texts(spark, tmp_path):
    given_ = t.inputs(spark, SF_DIR)
    seeds = t.seeds(spark, SF_DIR).withColumn("vulnerability", F.lit("v"))
    index, state = PairIndex(spark, str(tmp_path / "index"), range_bits=2), HitState(spark, str(tmp_path / "state"))
    sheet, details = str(tmp_path / "sheet"), str(tmp_path / "details")
    store = SheetStore(spark, sheet)
    store.save(seeds)
    shares = 0
    for k, part in enumerate(t.corpus_parts(spark, SF_DIR)):
        index.append(part)
        # all seeds are pending again, as if none had been found
        store.save(store.read().withColumn("found", F.lit("None found")))
        inputs = Inputs(seeds, given_.files.withColumn("version", F.when(F.col("file_id") % 3 > 0, 1).otherwise(2)), given_.repos, given_.commits)
        run_incremental(spark, sheet, details, index, state, inputs)
    found = match_results(Inputs(seeds, given_.files, given_.repos, given_.commits))
    assert rows_of(store.read().select("row_index", "found")) == rows_of(summary_cells(seeds, found))
    shares = state.shares().count()
    store.save(store.read().withColumn("found", F.lit("")))
    run_incremental(spark, sheet, details, index, state, Inputs(seeds, given_.files.where("false"), given_.repos, given_.commits))
    assert state.shares().count() == shares




def test_postings_are_gathered_where_texts_are(spark, tmp_path, monkeypatch):
    """One exchange deals out texts, none postings; chunks of any size hold the same places."""
    _, files = corpus(spark)
    index = PairIndex(spark, str(tmp_path / "index"), range_bits=2)
    assert len(re.findall(r"Exchange ", plan_of(index._posted(files)))) == 1
    texts = [(300, ["a", "b", "a", "b"]), (2, None), (1, ["a"]), (7, []), (5, ["b", "a", "b"])]
    batch = pa.RecordBatch.from_pylist([{"file_id": f, "words": w} for f, w in texts], pa.schema([("file_id", pa.int64()), ("words", pa.list_(pa.string()))]))
    wanted = {(w[i], f, i) for f, w in texts for i in range(len(w or []))} | {(f"{w[i]} {w[i + 1]}", f, i) for f, w in texts for i in range(len(w or []) - 1)}
    for size in (1, 4, 1 << 20):
        monkeypatch.setattr(pair_index, "GATHERED_WORDS", size)
        rows = [r for b in pair_index._gathered(iter([batch, batch.slice(5)])) for r in b.to_pylist()]
        assert {(r["gram"], r["block"] * pair_index.BLOCK_FILES + f, p) for r in rows for f, p in zip(r["files"], r["places"])} == wanted
        assert all(r["n_files"] == len(set(r["files"])) for r in rows)


def test_lists_of_common_pairs_are_not_multiplied_by_phrases(spark, tmp_path, monkeypatch):
    """Many phrases around one common pair: only the places of each phrase's rarest pair are unfolded."""
    texts = [(k, "r", "p", " ".join(f"x{k}_{i} of the y{k}_{i}" for i in range(20))) for k in range(50)]
    phrases = spark.createDataFrame([(f"x{k}_3 of the y{k}_3",) for k in range(50)], "pattern string")
    index = PairIndex(spark, str(tmp_path / "index"), range_bits=2)
    index.append(spark.createDataFrame(texts, FILES))
    sizes, beside = [], indexed._beside
    monkeypatch.setattr(indexed, "_beside", lambda i, starts, *a: sizes.append(starts.count()) or beside(i, starts, *a))
    assert rows_of(indexed.indexed_places(index, phrases)) == sorted([(f"x{k}_3 of the y{k}_3", k, "r") for k in range(50)], key=str)
    assert sizes == [50, 50]
