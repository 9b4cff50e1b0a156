"""Shapes of the physical plans."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry
from fixhound.catalog import queries as catalog
from fixhound.catalog import tables as t
from fixhound.operators import search, similarity, spread
from fixhound.plans import fix_report as report
from fixhound.plans import matching
from fixhound.schemas import FIX_TABLES
from tests.compare import check_rows, open_tables, spark_rows

SF_DIR = "/root/testdata/sf0.001"
BANNED = re.compile(r"BroadcastNestedLoopJoin|CartesianProduct|EvalPython|PythonUDF|InPandas|InArrow")


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def whole_plans(monkeypatch):
    """Stage boundaries off, so a plan shows everything under it."""
    for module in (catalog, matching, search, similarity):
        monkeypatch.setattr(module, "durable", lambda df: df)


# These run many jobs of their own; what is left of their plans is the last step.
IN_ROUNDS = {"similar_classes", "similar_classes_lsh", "incremental_hits", "indexed_patterns", "matches_in_rounds"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - IN_ROUNDS))
def test_no_cross_join_and_no_python(spark, whole_plans, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF_DIR))
    assert not BANNED.findall(plan)


def test_hits_are_capped_before_the_shuffle(spark):
    plan = plan_of(catalog.QUERIES["pattern_hits_capped"](spark, SF_DIR))
    assert re.search(r"dense_rank\(.*\), 10, Partial", plan)
    assert re.search(r"dense_rank\(.*\), 10, Final", plan)


def test_small_pattern_lists_leave_the_words_where_they_are(spark):
    plan = plan_of(catalog.QUERIES["pattern_hits"](spark, SF_DIR))
    assert "BroadcastHashJoin" in plan
    assert not re.search(r"Arguments: hashpartitioning\(w1", plan)


def test_large_pattern_lists_are_salted(spark, monkeypatch):
    monkeypatch.setattr(spread, "BROADCAST_BYTES", -1)
    inputs = t.inputs(spark, SF_DIR)
    joined = search.pattern_hits(inputs.patterns(), inputs.files)
    assert "_salt" in plan_of(joined)


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        spread.own_folder("yarn")


def test_large_tables_are_not_moved_to_use_more_cores(spark, monkeypatch):
    files = t.files(spark, SF_DIR)
    assert "Exchange" in plan_of(spread.spread_scan(files))
    monkeypatch.setattr(spread, "SPREAD_SCAN_BYTES", 0)
    assert "Exchange" not in plan_of(spread.spread_scan(files))


def test_compared_texts_stay_in_the_scan(spark):
    plan = plan_of(catalog.QUERIES["validated_by_share"](spark, SF_DIR))
    assert "BroadcastHashJoin" in plan
    assert not re.search(r"Exchange\nInput \[\d+\]: \[[^\]]*(content|words|file_shingles)", plan)


def test_previews_need_no_full_sort(spark):
    for name in ("fix_report_preview", "repos_top_stars", "seeds_first_n"):
        assert "TakeOrderedAndProject" in plan_of(catalog.QUERIES[name](spark, SF_DIR))


def test_filters_and_columns_reach_the_scans(spark, tmp_path):
    for name, schema in FIX_TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    tables = {n: spark.read.schema(s).parquet(str(tmp_path / n)) for n, s in FIX_TABLES.items()}
    plan = plan_of(report.fix_report(tables))
    for pushed in (
        "GreaterThanOrEqual(score,55.0)",
        "EqualTo(programming_language,Python)",
        "EqualTo(cwe_id,CWE-89)",
    ):
        assert pushed in plan
    assert "ReadSchema: struct<hash:string,programming_language:string>" in plan
    assert "code_before" not in plan and "diff_parsed" not in plan


def test_fix_report_has_no_fan_out_before_distinct(spark):
    plan = plan_of(catalog.QUERIES["fix_report_semi"](spark, SF_DIR))
    assert "LeftSemi" in plan and "Join type: Inner" not in plan


@pytest.mark.parametrize(
    "name", ["fix_report_semi", "matches_top5", "repo_samples", "seed_patterns_rare", "similar_pairs"]
)
def test_large_table_ways_give_the_same_rows(spark, monkeypatch, name):
    """Nothing counts as small, every frequent key is spread, Spark broadcasts nothing."""
    monkeypatch.setattr(spread, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(spread, "SPREAD_FROM_ROWS", 1)
    monkeypatch.setattr(spread, "SALTS", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = spark_rows(catalog.QUERIES[name](spark, SF_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == check_rows(open_tables(SF_DIR), entry.oracle_sql()[name])


def test_heavy_keys_finds_them(spark):
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, -1, id) AS k").repartition(5)
    assert spread.heavy_keys(df, "k", from_rows=1) == [-1]
    assert spread.heavy_keys(df, "k") == []
    assert spread.heavy_keys(df.where("k IS NULL"), "k", from_rows=0) == []
    assert spread.heavy_keys(df.selectExpr("CAST(NULL AS BIGINT) AS k"), "k", from_rows=1) == [None]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_joins_are_the_same_with_heavy_and_null_keys(spark, monkeypatch, how):
    left = spark.range(300).selectExpr("id", "CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN id END AS k")
    right = spark.createDataFrame([(1, "a"), (4, "b"), (None, "c"), (999, "d")], "k bigint, v string")
    plain = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
    monkeypatch.setattr(spread, "SPREAD_FROM_ROWS", 1)
    assert None in spread.heavy_keys(left, "k")
    salted = spread.hot_key_join(left, right, "k", how, ["id"])
    assert "_salt" in plan_of(salted)
    assert sorted(map(tuple, salted.collect()), key=str) == plain
