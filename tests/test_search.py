"""Search, grouping and ranking on hand-made rows, against plain Python."""

import pytest
from pyspark.sql import functions as F

from fixhound.functions.text import file_url
from fixhound.operators import patterns as pat
from fixhound.operators import repositories as repo
from fixhound.operators import search, similarity, spread

FILES = "file_id bigint, repo_name string, file_path string, content string"
SEEDS = "row_index bigint, code string"


@pytest.fixture(params=["broadcast", "shuffle"])
def ways(request, monkeypatch):
    """Both ways of every join: small frames are broadcast, or no frame counts as small and
    every key that is at all frequent is spread."""
    if request.param == "shuffle":
        monkeypatch.setattr(spread, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(spread, "SPREAD_FROM_ROWS", 1)


def corpus(spark, n=120):
    """A third of the files are copies of one text, and every file has a common pair."""
    texts = [
        "the same text as in all the other copies of it" if i % 3 == 0 else f"of the w{i % 7} end{i} a b"
        for i in range(n)
    ]
    rows = [(i, f"r{i % 5}", f"p/{i}", text) for i, text in enumerate(texts)]
    return rows, spark.createDataFrame(rows, FILES).repartition(7)


def holds(text, pattern):
    return f" {pattern} " in f" {' '.join(text.lower().split())} "


PATTERNS = [
    (2, 1, "of the"), (2, 2, "the same"), (3, 1, "of the"), (3, 2, "end5 a"), (4, 1, "not there"),
]


def test_capped_hits(spark, ways):
    rows, files = corpus(spark)
    patterns = spark.createDataFrame(PATTERNS, "row_index bigint, pattern_no int, pattern string")
    got = sorted(tuple(r) for r in search.seed_hits(patterns, files, limit=10).collect())
    expected = []
    for row, number, pattern in PATTERNS:
        hits = [f for f in rows if holds(f[3], pattern)][:10]
        expected += [(row, number, pattern, i, f[0], f[1]) for i, f in enumerate(hits, 1)]
    assert got == sorted(expected)


def test_phrases_of_any_length(spark, ways):
    rows, files = corpus(spark, 40)
    given = ["of", "the SAME", "same text as", "w1 end1 a b", "of the w1 end1 a b",
             "the same text as in all the other copies of it", "the same text as in some"]
    patterns = spark.createDataFrame([(g,) for g in given], "pattern string")
    got = sorted(tuple(r) for r in search.pattern_hits(patterns, files).collect())
    assert got == sorted(
        (g, f[0], f[1]) for g in given for f in rows if holds(f[3], g.lower())
    )


def test_rare_patterns(spark, ways):
    _, files = corpus(spark)
    seeds = spark.createDataFrame([(2, "of the w1 end1 a b zz"), (3, "zz yy"), (4, "")], SEEDS)
    got = sorted(tuple(r) for r in pat.rare_seed_patterns(seeds, files, limit=3).collect())
    assert got == [(2, 1, "w1 end1", 1), (2, 2, "end1 a", 1), (2, 3, "the w1", 12)]


def test_similar_pairs_collapse_copies(spark, ways):
    rows, files = corpus(spark)
    copied = next(r[3] for r in rows if r[0] == 0)
    given = [(2, copied), (3, copied.upper()), (4, "of the w1 end1 a b"), (5, "a b"), (6, "no such text here")]
    seeds = spark.createDataFrame(given, SEEDS)
    got = similarity.similar_pairs(seeds, files, 0.5).orderBy("row_index", "file_id").collect()

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i:i + 3]) for i in range(len(w) - 2)}

    expected = {}
    for row, code in given:
        for file_id, _, _, text in rows:
            own, other = shingles(code), shingles(text)
            if own and len(own & other) >= 0.5 * len(own):
                key = (frozenset(own), text)
                pair = expected.setdefault(key, [set(), set(), len(own & other), len(own), len(other)])
                pair[0].add(row)
                pair[1].add(file_id)
    assert [
        (r.row_index, r.n_seeds, r.file_id, r.n_files, r.shared, r.seed_shingles, r.file_shingles)
        for r in got
    ] == sorted(
        (min(a), len(a), min(b), len(b), *sizes) for a, b, *sizes in expected.values()
    )
    assert (got[0].n_seeds, got[0].n_files, got[0].share, got[0].jaccard) == (2, 40, 1.0, 1.0)


HITS = "row_index bigint, pattern_no int, pattern string, hit_no int, file_id bigint, repo_name string"


def test_first_hit_and_samples(spark, ways):
    rows = [(2, 2, "p2", 1, 7, "b"), (2, 1, "p1", 2, 8, "b"), (2, 2, "p2", 2, 8, "b"), (2, 1, "p1", 1, 9, "a")]
    hits = spark.createDataFrame(rows, HITS).repartition(3)
    grouped = {r.repo_name: tuple(r)[2:] for r in repo.group_hits(hits).collect()}
    assert grouped == {"b": (1, 2, 8, 3), "a": (1, 1, 9, 1)}
    files = spark.createDataFrame([(i, "r", "p", f"text{i}") for i in (7, 8, 9)], FILES)
    url = file_url(F.col("repo_name"), F.col("file_id").cast("string"))
    samples = {r.repo_name: r for r in repo.hit_samples(hits, files, url).collect()}
    assert samples["b"].code_samples == ["text8", "text7", "text8"]
    assert samples["b"].file_urls[1] == "https://github.com/b/blob/HEAD/7"


ENTRIES = "row_index bigint, repo_name string, pattern_no int, hit_no int, file_id bigint"


def entries(spark):
    rows = [(2, "x", 2, 1, 1), (2, "y", 1, 3, 2), (2, "z", 1, 1, 3), (3, "x", 1, 1, 1)]
    return spark.createDataFrame(rows, ENTRIES)


def repos(spark):
    return spark.createDataFrame(
        [("x", 5, False, False, None), ("y", 5, True, False, False), ("z", 9, False, True, True)],
        "repo_name string, stars bigint, fork boolean, archived boolean, flagged boolean",
    )


def test_ranking_keeps_first_seen_order_of_ties(spark, ways):
    joined = repo.with_repository(entries(spark), repos(spark))
    kept = repo.drop_flagged(joined)
    ranked = repo.best_per_seed(kept, 10).orderBy("row_index", "rank").collect()
    assert [(r.row_index, r.rank, r.repo_name) for r in ranked] == [(2, 1, "y"), (2, 2, "x"), (3, 1, "x")]
    assert repo.best_per_seed(kept, 1).count() == 2


def test_flags_by_answers_keep_unknown(spark, ways):
    answers = spark.createDataFrame([("x", "YES."), ("y", " yes\n"), ("z", None)], "repo_name string, answer string")
    kept = repo.drop_flagged_by_answers(entries(spark), answers)
    assert sorted(r.repo_name for r in kept.collect()) == ["x", "x", "z"]


def test_similar_by_answers_accepts_unknown(spark, ways):
    answers = spark.createDataFrame([(1, "no"), (2, None)], "file_id bigint, answer string")
    got = repo.similar_by_answers(entries(spark), answers).collect()
    assert sorted((r.repo_name, r.similar) for r in got) == [
        ("x", False), ("x", False), ("y", True), ("z", True),
    ]


def test_search_passes_over_a_common_header(spark, ways):
    """The file that holds only the last statement is found, one that shares the header isn't accepted."""
    header = "import os import sys import re"
    statement = 'cursor.execute("SELECT " + user_id) # unsafe query'
    texts = [statement, f"{header} print hello"] + [f"{header} w{i} x{i}" for i in range(30)]
    files = spark.createDataFrame([(i, f"r{i}", "p", x) for i, x in enumerate(texts)], FILES)
    seeds = spark.createDataFrame([(2, f"{header} {statement}"), (3, "HELLO")], SEEDS)
    patterns = pat.seed_patterns(seeds, files)
    hits = search.seed_hits(patterns, files).collect()
    assert {h.file_id for h in hits if h.row_index == 2 and h.pattern_no == 1} == {0}
    assert {(h.pattern, h.file_id) for h in hits if h.row_index == 3} == {("hello", 1)}
    rows = [(2, "r0", 1, 1, 0), (2, "r1", 5, 1, 1)]
    got = repo.similar_by_share(spark.createDataFrame(rows, ENTRIES), seeds, files, 0.4).collect()
    assert {r.repo_name: r.similar for r in got} == {"r0": True, "r1": False}


def test_longer_patterns_are_held_to_their_last_word(spark, ways):
    files = spark.createDataFrame([(1, "x", "p", "import os only"), (2, "x", "p", "Import OS zebra")], FILES)
    patterns = spark.createDataFrame([(2, 1, "import os ZEBRA"), (2, 2, "Import OS")], "row_index bigint, pattern_no int, pattern string")
    got = sorted((h.pattern_no, h.file_id) for h in search.seed_hits(patterns, files).collect())
    assert got == [(1, 2), (2, 1), (2, 2)]


def test_unknown_repositories_stay(spark, ways):
    known = repos(spark).where("repo_name = 'z'")
    got = repo.drop_flagged(repo.with_repository(entries(spark), known)).collect()
    assert sorted((r.row_index, r.repo_name, r.stars) for r in got) == [(2, "x", 0), (2, "y", 0), (3, "x", 0)]
    unsure = repos(spark).withColumn("fork", F.lit(None).cast("boolean")).withColumn("archived", F.lit(None).cast("boolean"))
    assert repo.star_filter(unsure, exclude_forks=True, exclude_archived=True).count() == 3


def test_similar_by_share(spark, ways):
    files = spark.createDataFrame(
        [(1, "x", "p", "one two three four"), (2, "y", "p", "five six"), (3, "z", "p", "two  THREE four")], FILES
    )
    seeds = spark.createDataFrame([(2, "one two three four"), (3, "a")], SEEDS)
    got = repo.similar_by_share(entries(spark), seeds, files, 0.5).collect()
    assert sorted((r.row_index, r.repo_name, r.share, r.similar) for r in got) == [
        (2, "x", 1.0, True), (2, "y", 0.0, False), (2, "z", 0.5, True), (3, "x", 1.0, True),
    ]


def test_star_fork_and_archive_filters(spark):
    names = lambda df: sorted(r.repo_name for r in df.collect())
    assert names(repo.star_filter(repos(spark))) == ["x", "y", "z"]
    assert names(repo.star_filter(repos(spark), min_stars=6)) == ["z"]
    assert names(repo.star_filter(repos(spark), exclude_forks=True)) == ["x", "z"]
    assert names(repo.star_filter(repos(spark), exclude_forks=True, exclude_archived=True)) == ["x"]
    assert [r.repo_name for r in repo.top_starred(repos(spark), 2).collect()] == ["z", "x"]


def test_commit_lookup(spark, ways):
    commits = spark.createDataFrame(
        [(1, 1, "old", 10), (1, 2, "new", 20), (1, 3, "tie", 20)],
        "file_id bigint, commit_id bigint, sha string, committed_at bigint",
    )
    lookups = spark.createDataFrame(
        [(1, "r", False, "head"), (2, "r", False, "head"), (3, "r", True, "head")],
        "file_id bigint, repo_name string, failed boolean, head_sha string",
    )
    got = {r.file_id: (r.commit_sha, r.commit_url) for r in repo.with_head_fallback(lookups, commits).collect()}
    assert got == {
        1: ("tie", "https://github.com/r/commit/tie"),
        2: (None, None),
        3: ("head", "https://github.com/r/commit/head"),
    }
    attached = {r.repo_name: r.commit_sha for r in repo.with_commit(entries(spark), commits).collect()}
    assert attached == {"x": "tie", "y": None, "z": None}
