"""Periodic runs against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from fixhound.llm import periodic_runs
from fixhound.llm.texts import Tokens


def brute(words):
    """Start, length, least period of every run, from the definition."""
    n, least = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                least.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in least.items())


def texts_of_many_kinds(seed):
    rng = np.random.default_rng(seed)
    some = lambda low, high: int(rng.integers(low, high))
    words = lambda letters, n: [f"w{x}" for x in rng.integers(0, letters, n)]
    for _ in range(25):
        yield words(2, some(0, 80))
        yield words(3, some(0, 200))
        yield sum((words(some(1, 30), some(1, 40)) * some(1, 8) for _ in range(5)), [])
        inner = words(2, some(1, 6)) * some(1, 6) + ["b"]
        yield (inner * some(1, 7) + ["c"]) * some(1, 7)
        yield ["a"] * some(0, 300)
        base = words(50, some(10, 100))
        yield base * some(1, 9) + base[: some(0, 10)]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    texts = list(texts_of_many_kinds(seed))
    tokens = Tokens(pa.array([" ".join(t) for t in texts], pa.large_string()), fold_case=False)
    offsets = np.append(tokens.first, len(tokens.hashes))
    start, end, period = periodic_runs.runs_of(tokens.hashes, tokens.doc, offsets)
    for k, text in enumerate(texts):
        own = (start >= offsets[k]) & (start < offsets[k + 1])
        got = zip((start - offsets[k])[own].tolist(), (end - start)[own].tolist(), period[own].tolist())
        assert list(got) == brute(text), text


def test_grammar_joins_repeated_pairs_only():
    tokens = Tokens(pa.array(["a b c a b c a b d", "a b"], pa.large_string()))
    grammar = periodic_runs.Grammar(tokens.hashes + tokens.doc.astype(np.uint64), tokens.doc)
    # nodes: (a b) three times, (a b) c twice
    assert sorted(zip(grammar.start, grammar.size)) == [(0, 2), (0, 3), (3, 2), (3, 3), (6, 2)]
    assert len(grammar.first) == 2


def test_edge_cases(spark):
    long = " ".join(f"w{i % 7001}" for i in range(40_000))
    rows = [(1, None), (2, ""), (2, " \t\n"), (3, "a a a a a"), (3, "a  a\na a a\ta"), (None, "A a A a A a A a B"), (5, long), (5, long), (6, "x")]
    docs = spark.createDataFrame([(i, t, 7, "mine", [1]) for i, t in rows], "doc_id bigint, text string, n_words int, collapsed string, runs array<int>")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.detect(docs).collect()), key=str)
    once = " ".join(f"w{i}" for i in range(7001))
    expected = [
        (1, 0, [], ""),
        (2, 0, [], ""),
        (2, 0, [], ""),
        (3, 5, [], "a a a a a"),
        (3, 6, [(0, 6, 1)], "a"),
        (None, 9, [(0, 8, 2)], "A a B"),
        (5, 40_000, [(0, 40_000, 7001)], once),
        (5, 40_000, [(0, 40_000, 7001)], once),
        (6, 1, [], "x"),
    ]
    assert got == sorted(expected, key=str)
    assert periodic_runs.detect(docs.where("false")).count() == 0
