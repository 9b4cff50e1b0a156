"""Learned scanner verdicts against the formula."""

import math
from collections import Counter

import pytest

from fixhound.operators import spread, verdicts
from tests.test_plans import plan_of

TEXTS = [
    ("a", "Scan scan all the code"), ("b", "scanner to scan sites"), ("c", "a web shop for the books"),
    ("d", "the shop of books and maps"), ("e", None), ("f", "scan the unknown words"), ("g", "books books the"), ("h", ""),
]
ANSWERS = [("a", " yes\n"), ("b", "YES"), ("b", "no"), ("c", "No"), ("d", None), ("d", "maybe"), ("e", "no"), ("zz", "yes")]


def frames(spark):
    texts = spark.createDataFrame([(r, t, 1) for r, t in TEXTS], "repo_name string, text string, word int")
    return texts, spark.createDataFrame(ANSWERS, "repo_name string, answer string")


def expected():
    said = {"a": True, "b": True, "c": False, "d": False, "e": False, "zz": True}
    bags = {r: Counter((t or "").lower().split()) for r, t in TEXTS}
    yes, no = (sum((bags[r] for r in said if r in bags and said[r] == v), Counter()) for v in (True, False))
    size = len(yes | no)
    scale = math.log((sum(no.values()) + size + 1) / (sum(yes.values()) + size + 1))
    score = lambda bag: sum(n * (math.log((yes[w] + 1) / (no[w] + 1)) + scale) for w, n in bag.items())
    return {r: score(bag) + math.log(3 / 3) if bag else None for r, bag in bags.items()}


@pytest.mark.parametrize("salted", [False, True])
def test_scores(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(spread, "SPREAD_FROM_ROWS", 1)
    texts, answers = frames(spark)
    got = {r.repo_name: (r.score, r.flagged) for r in verdicts.learned_verdicts(texts, verdicts.fit_verdicts(texts, answers)).collect()}
    for name, score in expected().items():
        assert got[name] == ((None, False) if score is None else (pytest.approx(score), score > 0))
    assert got["f"][1] and not got["g"][1]


def test_one_verdict_only_teaches_nothing(spark):
    texts, answers = frames(spark)
    for part in (answers.where("answer = 'YES'"), answers.where("false"), answers.where("answer IS NULL")):
        model = verdicts.fit_verdicts(texts, part)
        assert model is None
        assert not any(r.flagged for r in verdicts.learned_verdicts(texts, model).collect())


def test_answers_come_before_verdicts_and_unknown_stays(spark):
    entries = spark.createDataFrame([(2, r) for r in "abcfgx"], "row_index bigint, repo_name string")
    learned = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("f", True), ("g", False)], "repo_name string, flagged boolean")
    answers = spark.createDataFrame([("a", "no"), ("b", "yes"), ("c", None)], "repo_name string, answer string")
    assert sorted(r.repo_name for r in verdicts.drop_learned(entries, learned, answers).collect()) == ["a", "g", "x"]


@pytest.mark.parametrize("limit", [1 << 20, 300, 1])
def test_words_are_not_shuffled_and_parts_of_the_model_add_up(spark, monkeypatch, limit):
    """The model goes whole, in two parts, or, as it takes too many parts, meets the words in a shuffle."""
    texts, answers = frames(spark)
    model = verdicts.fit_verdicts(texts, answers)
    monkeypatch.setattr(spread, "BROADCAST_BYTES", limit)
    learned = verdicts.learned_verdicts(texts, model)
    plan = plan_of(learned)
    assert ("hashpartitioning(word" in plan) == (limit == 1)
    if limit > 1:
        assert ("Union" in plan) == (limit == 300)
    got = {r.repo_name: r.score for r in learned.collect()}
    assert all(got[name] == (score if score is None else pytest.approx(score)) for name, score in expected().items())
