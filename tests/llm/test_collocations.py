"""Collocations against brute force."""

import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fixhound.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n int, rank string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, min_count, best):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    frequent = {p: f for p, f in counts.items() if len(p) > 2 and f >= min_count}
    dropped = {(p[0], *p[i:j]) for p, f in frequent.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and f >= counts[(p[0], *p[i:j])]}
    out = {}
    for p, a in frequent.items():
        if p not in dropped:
            n = totals[p[0]]
            cuts = [(1000 * a * n // (counts[p[:k]] * counts[(p[0], *p[k:])]), k) for k in range(2, len(p))]
            score, k = min(cuts)
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), counts[p[:k]], counts[(p[0], *p[k:])], n))
    return sorted(
        (lang, i + 1, phrase.decode(), -a, left, right, n, -score)
        for lang, rows in out.items()
        for i, (score, a, phrase, left, right, n) in enumerate(sorted(rows)[:best])
    )


def texts(seed, n):
    rng = np.random.default_rng(seed)
    fixed = ["of the old Town", "A b c d e f g", "one two", "x x x x x x x", "Été été fin"]
    marks = [" ", " ", "\t", "  ", ". ", ",", "\n", " ? ", "\x0b", "\x0c"]
    for k in range(n):
        parts = [fixed[rng.integers(0, len(fixed))] if rng.random() < 0.4 else f"w{min(rng.zipf(1.4), 60)}" for _ in range(rng.integers(0, 60))]
        yield "".join(p + marks[rng.integers(0, len(marks))] for p in parts), ("en", "de", None, "und", "")[k % 5]


def result(spark, rows, **options):
    table = spark.createDataFrame([(1, text, lang, "p", 5, "r") for text, lang in rows], SCHEMA)
    return sorted(map(tuple, collocations.best_phrases(table.repartition(3), **options).collect()))


@pytest.mark.parametrize("options", [{"min_count": 5, "best": 40}, {"min_count": 3, "best": 10_000, "budget": 20}])
def test_phrases_equal_brute_force(spark, options):
    rows = [*texts(1, 150), (None, "en"), (None, None), ("", "en"), (" .\n", "en"), ("word " * 30_000, "de")]
    expected = brute(rows, options["min_count"], options["best"])
    assert len(expected) > 100
    assert result(spark, rows, **options) == expected


def test_small_and_empty_tables(spark):
    assert result(spark, [("a b", "en")] * 99) == []
    assert result(spark, [("a b", "en")] * 100) == [("en", 1, "a b", 100, 100, 100, 200, 2000)]
    table = spark.createDataFrame([], SCHEMA)
    assert collocations.best_phrases(table).count() == 0


def test_products_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("5000000000000 AS a", "900000000000000 AS n", "6000000000000 AS l", "7000000000000 AS r")
    for name in "alrn":
        row = row.withColumn(f"{name}_", collocations._exact(name))
    got = row.selectExpr("(cast(1000 AS decimal(4,0)) * a_ * n_) div (l_ * r_) AS score").first().score
    assert got == 1000 * 5000000000000 * 900000000000000 // (6000000000000 * 7000000000000)


def test_subtree_totals():
    levels = [np.array([0, 0, 0, 1]), np.array([7, 7, 8, 7]), np.array([1, 1, 1, 1]), np.array([0, 2, 0, 2])]
    nodes = [(depth, at.tolist(), total.tolist()) for depth, at, total in collocations.subtree(levels, np.array([3, 4, 5, 6]))]
    assert nodes == [(2, [0, 2, 3], [7, 5, 6]), (3, [1, 3], [4, 6])]


def test_a_slice_takes_bounded_memory():
    line = "one two three four. five six, seven eight nine ten "
    batch = pa.record_batch([pa.array([line * 400] * 300), pa.array(["en"] * 300)], ["text", "lang"])
    tracemalloc.start()
    try:
        assert sum(len(p) for p in collocations._over_slices(lambda words: [words.pairs()])([batch])) == 300 * 400 * 10
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()
