"""Fingerprints of code with folded names."""

import hashlib
import re

from pyspark.sql import functions as F

from fixhound.operators import fingerprints as fp

KEPT = ["for", "if", "return", "in", "def", "print", "len", "while"]

ORIGINAL = """def total(values, limit):
    result = 0
    for value in values:
        if value > limit:
            result = result + value * 3
    return result / len(values)
"""
RENAMED = """# counted elsewhere
def f(xs, most):
    acc = 0
    for x in xs:
        if x > most:
            acc = acc + x * 7
    return acc / len(xs)

print(f([1], 2))
"""
OTHER = """while ready():
    print("waiting", len(queue), flush=True); queue.pop(); step(); log.write("x" + y)
"""


def slow_prints(text, kept):
    """The definition, window by window."""
    tokens = re.findall(r"[^\W\d]\w*|\d+|[^\w\s]", text or "")
    folded = [t if t in kept else "0" if t[0].isdigit() else "v" if re.match(r"\w", t) else t for t in tokens]
    if not folded:
        return 0, []
    runs = [
        int(hashlib.md5(" ".join(folded[i : i + fp.RUN]).encode()).hexdigest()[:15], 16)
        for i in range(max(1, len(folded) - fp.RUN + 1))
    ]
    least = {min(runs[i : i + fp.WINDOW]) for i in range(max(1, len(runs) - fp.WINDOW + 1))}
    return len(folded), sorted(least)


def files(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "file_id bigint, content string")


def seeds(spark, texts):
    return spark.createDataFrame([(i + 2, t) for i, t in enumerate(texts)], "row_index bigint, code string")


def test_prints_equal_definition(spark):
    texts = [ORIGINAL, RENAMED, OTHER, "", None, " \n", "x", "a b c d e f g h i", "é1 = ñ_2 + 33;" * 3, ORIGINAL * 200]
    got = {r.file_id: (r.n_tokens, r.prints) for r in fp.file_prints(files(spark, texts), KEPT).collect()}
    assert got == {i: slow_prints(t, KEPT) for i, t in enumerate(texts)}


def test_renaming_changes_no_print(spark):
    plain = re.sub(r"\b(total|values|value|limit|result)\b", lambda m: "n_" + m[0].upper(), ORIGINAL)
    rows = fp.file_prints(files(spark, [ORIGINAL, plain]), KEPT).collect()
    assert plain != ORIGINAL and rows[0].prints == rows[1].prints


def test_renamed_copy_is_found_where_words_differ(spark):
    corpus = files(spark, [RENAMED, OTHER, RENAMED, None])
    rows = fp.renamed_copies(seeds(spark, [ORIGINAL, "", None, ORIGINAL]), corpus, KEPT).collect()
    assert [(r.row_index, r.n_seeds, r.file_id, r.n_files) for r in rows] == [(2, 2, 0, 2)]
    assert rows[0].share >= 0.5


def test_pairs_equal_brute_force_on_both_join_paths(spark, monkeypatch):
    texts = [ORIGINAL, RENAMED, OTHER, ORIGINAL + OTHER, RENAMED[:150], OTHER * 2, "x", "y z", "1"] + [ORIGINAL] * 40
    own = [ORIGINAL, OTHER, "z", RENAMED + ORIGINAL]
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault(tuple(slow_prints(t, KEPT)[1]), []).append(i)
    expected = set()
    for i, t in enumerate(own):
        asked = set(slow_prints(t, KEPT)[1])
        for prints, ids in sets.items():
            shared = len(asked & set(prints))
            if shared >= 0.5 * len(asked):
                expected.add((i + 2, ids[0], len(ids), shared))
    for fits in (True, False):
        monkeypatch.setattr(fp, "fits_broadcast", lambda *_: fits)
        rows = fp.renamed_copies(seeds(spark, own), files(spark, texts), KEPT).collect()
        assert {(r.row_index, r.file_id, r.n_files, r.shared) for r in rows} == expected


def test_common_words_are_those_of_most_files(spark):
    corpus = files(spark, ["if a a a", "if b", "if b c", None, ""])
    assert fp.common_words(corpus, 2) == ["if", "b"]
    assert fp.common_words(corpus.where(F.lit(False)), 2) == []


def test_empty_tables(spark):
    none = files(spark, []), seeds(spark, [])
    assert fp.renamed_copies(none[1], none[0]).isEmpty()
    assert fp.renamed_copies(seeds(spark, [ORIGINAL]), none[0]).isEmpty()
    assert fp.renamed_copies(none[1], files(spark, [ORIGINAL])).isEmpty()
