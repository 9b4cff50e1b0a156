"""Text rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from fixhound.functions import text as tx
from fixhound.functions.grams import distinct_ngrams, exploded_ngrams, words
from fixhound.operators.patterns import captured_patterns, with_pattern_list

FENCE = "```"


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def test_concat_counts_null_as_empty(spark):
    assert one(spark, None, lambda v: tx.report_commit_url(v, F.lit("abc"))) == "/commit/abc"


def test_commit_url_is_null_without_commit(spark):
    assert one(spark, None, lambda v: tx.commit_url(F.lit("a/b"), v)) is None
    assert one(spark, "s", lambda v: tx.commit_url(F.lit("a/b"), v)) == (
        "https://github.com/a/b/commit/s"
    )


def test_entry_line_defaults(spark):
    line = lambda v: tx.entry_line(v, F.lit(None).cast("long"), v)
    assert one(spark, None, line) == "Unknown (0 stars) | "


@pytest.mark.parametrize("length, cut", [(30000, False), (30001, True)])
def test_detail_cell(spark, length, cut):
    text = "é" * length
    expected = text[:30000] + "\n... (truncated)" if cut else text
    assert one(spark, text, tx.detail_cell) == expected


@pytest.mark.parametrize(
    "content, text", [(b"A\xc3\xa9", "Aé"), (b"\xff\x41", ""), (b"", ""), (None, "")]
)
def test_utf8_or_empty(spark, content, text):
    value = bytearray(content) if content is not None else None
    assert one(spark, value, tx.utf8_or_empty, "binary") == text


@pytest.mark.parametrize(
    "answer, flagged, accepted",
    [
        ("yes", True, True),
        (" Yes\n", True, True),
        ("\x1c YES\xa0", True, True),
        ("YES.", False, False),
        ("no", False, False),
        (None, False, True),
    ],
)
def test_verdicts(spark, answer, flagged, accepted):
    assert one(spark, answer, tx.is_flagged) is flagged
    assert one(spark, answer, tx.is_accepted) is accepted


@pytest.mark.parametrize(
    "pattern, expected",
    [
        ("a b", "a b language:python"),
        ("a LANGUAGE:Python", "a LANGUAGE:Python"),
    ],
)
def test_qualified(spark, pattern, expected):
    assert one(spark, pattern, tx.qualified) == expected


def test_readme_sample_and_nulls(spark):
    assert one(spark, "x" * 2500, tx.readme_sample) == "x" * 2000
    assert one(spark, None, tx.readme_sample) == ""


LISTS = [
    ('["a","b"]', ["a", "b"]),
    (f'{FENCE}json\n["a","b"]\n{FENCE}', ["a", "b"]),
    (f'{FENCE}\njson ["a"]\n{FENCE}', ["a"]),
    (f'{FENCE}json ["a"]{FENCE}', []),
    (f'{FENCE}\n["a"]', []),
    (f'{FENCE}\n["a"]\nnot a fence', ["a"]),
    ('{"k":1}', []),
    ("oops", []),
    ("", []),
    (None, []),
    ("[]", []),
    ('["a"] and more', []),
    ("['a']", []),
    ("[1,2,3,4,5,6,7]", ["1", "2", "3", "4", "5"]),
    ('[2.0, true, false, null, "null"]', ["2.0", "True", "False", "None", "null"]),
    (" \n [\"z\"]\t", ["z"]),
]


def test_pattern_lists(spark):
    given = [(i, reply) for i, (reply, _) in enumerate(LISTS)]
    replies = spark.createDataFrame(given, "row_index bigint, reply string")
    parsed = {r.row_index: r.patterns for r in with_pattern_list(replies).collect()}
    assert [parsed[i] for i in range(len(LISTS))] == [expected for _, expected in LISTS]
    rows = captured_patterns(replies).orderBy("row_index", "pattern_no").collect()
    assert [tuple(r) for r in rows] == [
        (i, n, p) for i, (_, ps) in enumerate(LISTS) for n, p in enumerate(ps, 1)
    ]


def test_words_and_ngrams(spark):
    assert one(spark, " A b\n\tC ", words) == ["a", "b", "c"]
    pairs = lambda v: distinct_ngrams(words(v), 2)
    assert one(spark, "a b a b", pairs) == ["a b", "b a"]
    assert one(spark, "a", pairs) == []
    assert one(spark, "", pairs) == []


def test_exploded_runs_hold_every_ngram(spark):
    df = spark.createDataFrame([(1, " a b c a "), (2, ""), (3, "x")], "id int, t string")
    rows = exploded_ngrams(df, "t", 2).where("w1 != '' AND w2 != ''").collect()
    assert sorted(tuple(r) for r in rows) == [(1, "a", "b"), (1, "b", "c"), (1, "c", "a")]
