"""Classes of similar files against brute force."""

import numpy as np
from pyspark.sql import functions as F

from fixhound.catalog import tables as t
from fixhound.functions import grams
from fixhound.operators import classes, shingle_sets
from tests.test_plans import plan_of

FILES = "file_id bigint, content string, label int, n int, bucket string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def brute(rows, least=0.8):
    sets = [shingles(text) for _, text in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, every = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or (every and both / every >= least):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    groups = {}
    for (number, text), x in zip(rows, label):
        groups.setdefault(x, []).append((number, text or ""))
    return sorted((min(n for n, _ in g), len({x for _, x in g}), len(g)) for g in groups.values())


def result(spark, rows, **options):
    files = spark.createDataFrame([(n, text, 1, 2, "b") for n, text in rows], FILES).repartition(3)
    return sorted(tuple(r) for r in classes.similar_classes(files, **options).collect())


def corpus():
    rng = np.random.default_rng(3)
    words = lambda n, size: [f"w{x}" for x in rng.integers(0, size, n)]
    rows = []
    for size in (20, 60, 150):
        base = words(size, 10**6)
        for k in range(12):
            copy = list(base)
            for place in rng.integers(0, size, k // 2 + 1):
                copy[place] = f"e{k}"
            rows += [" ".join(copy)] * (1 + k % 2)
    passage = " ".join(words(70, 10**6))
    rows += [f"{passage} " + " ".join(words(16, 10**6)) for _ in range(40)]
    rows += [" ".join(words(30, 3)) for _ in range(20)]
    rows += [None, "", " ", "a b", "A B", "a b", "a b c", "a  b c", "x " * 500, "x " * 400]
    return [(7 * k % 1009, text) for k, text in enumerate(rows)]


def test_classes_equal_brute_force(spark):
    assert result(spark, corpus()) == brute(corpus())


def test_bands_find_nearly_all_and_nothing_else(spark):
    exact, found = brute(corpus()), result(spark, corpus(), exact=False)
    assert sum(n for _, _, n in found) == sum(n for _, _, n in exact)
    # every class found lies inside an exact one, so there are at least as many
    missing = len(found) - len(exact)
    texts = sum(n for _, n, _ in exact)
    assert 0 <= missing <= 0.1 * (texts - len(exact))


def test_bands_recall_on_the_test_tables(spark):
    files = t.files(spark, "/root/testdata/sf0.001")
    exact = classes.similar_classes(files).count()
    texts = files.select("content").distinct().count()
    found = classes.similar_classes(files, exact=False).count()
    recall = (texts - found) / (texts - exact)
    print(f"links by bands: {texts - found} of {texts - exact}, recall {recall:.3f}")
    assert 0.9 <= recall <= 1


def test_a_common_passage_multiplies_nothing(spark, monkeypatch):
    """Files that share most of their text, all below the similarity, hardly ever meet."""
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(k, f"{passage} " + " ".join(f"d{k}w{i}" for i in range(14))) for k in range(1500)]
    made, across = [], classes._across
    monkeypatch.setattr(classes, "_across", lambda *a: made.append(across(*a)) or made[-1])
    assert len(result(spark, rows)) == 1500
    assert made[0].count() < 1500


def test_no_files(spark):
    assert result(spark, []) == []
    assert result(spark, [], exact=False) == []


def test_signatures_are_sparks_hashes(spark):
    sets = spark.createDataFrame([(1, [5, -7, 2**62, 0]), (2, [-(2**63), 2**63 - 1]), (3, [9])], "doc bigint, shingles array<bigint>").repartition(2)
    numbered = sets.select("doc", F.size("shingles").alias("n"), "shingles")
    hashed = lambda seed: lambda s: F.xxhash64(s, F.lit(seed))
    for gathered in (1, 1 << 16):
        made = numbered.mapInArrow(classes._signatures(8, gathered), "doc bigint, n int, least array<bigint>").join(sets, "doc")
        least = F.array(*[F.array_min(F.transform("shingles", hashed(k))) for k in range(8)])
        assert made.where(F.col("least") == least).count() == 3


def test_bands_are_hashed_once_and_unshared_shingles_are_not_gathered(spark):
    sets = spark.createDataFrame([(k, [k, k + 1, 100, 200]) for k in range(0, 60, 2)], "doc bigint, shingles array<bigint>")
    assert "MapInArrow" not in plan_of(classes.by_bands(sets))
    assert "collect_list" not in plan_of(classes.by_rarest(sets))
    # of four shingles, the first of an order by rarity stand in front: two that no other text has
    assert classes.by_rarest(sets, 0.5).select("place").distinct().collect() == [(2,)]


def test_pairs_of_very_different_sizes_are_not_compared(spark):
    rows = [(1, 10, 7, 1, 2), (2, 100, 7, 2, 2), (3, 95, 7, 3, 1)]
    placed = spark.createDataFrame(rows, "doc bigint, n int, bucket bigint, label bigint, degree bigint")
    assert {tuple(r) for r in classes._with_one(placed, 0, 0.8).collect()} == {(2, 3)}


def test_links_that_share_no_band_are_found(spark, monkeypatch):
    """Whatever the bands leave out, also all, is compared by the rarest shingles."""
    by_bands = classes.by_bands
    for kept in ("false", "doc % 2 = 0"):
        monkeypatch.setattr(classes, "by_bands", lambda sets, kept=kept: by_bands(sets).where(kept))
        assert result(spark, corpus(), exact=False) == brute(corpus())


def test_nothing_that_grows_with_the_files_is_broadcast(spark, monkeypatch):
    def refused(df):
        raise AssertionError("broadcast without a bound")

    monkeypatch.setattr(F, "broadcast", refused)
    assert result(spark, corpus()) == brute(corpus())


def test_any_order_of_shingles_and_pairs_in_parts_give_the_same_classes(spark, monkeypatch):
    monkeypatch.setattr(classes, "COMMON", 5)
    monkeypatch.setattr(classes, "PAIRS", 7)
    assert result(spark, corpus()) == brute(corpus())


def test_sets_are_those_of_the_words_between_white_space(spark):
    texts = ["", " ", "a b", "a b c", "a b c a b c", "\tA\n b\x0bC\x0c d\r", "a\u00a0b c d", "\u00c4 \u0130 \u03a3 \u00df", "x " * 9, "a bc d", "ab c d", "\x1c a b c"]
    files = spark.createDataFrame([(k, text, 1, 2, "b") for k, text in enumerate(texts)], FILES)
    made = {r.doc: r for r in classes.marked(classes._contents(files), 0.8).collect()}
    wanted = files.select("file_id", F.size(grams.distinct_ngrams(grams.words(F.col("content")), 3)).alias("n")).collect()
    assert {k: r.n for k, r in made.items()} == {r.file_id: r.n for r in wanted}
    assert made[9].lead != made[10].lead and made[3].lead[0] in classes_of(spark, "a b c a b c") and not made[2].lead


def classes_of(spark, text):
    files = spark.createDataFrame([(1, text, 1, 2, "b")], FILES)
    return classes.marked(classes._contents(files), 0.1).first().lead


def test_parities_leave_out_no_similar_pair():
    rng = np.random.default_rng(5)
    for n in (1, 9, 63, 64, 65, 700):
        some = rng.integers(-(2**63), 2**63 - 1, n)
        other = np.concatenate([some[n // 10 :], rng.integers(-(2**63), 2**63 - 1, n // 10)])
        odd = [shingle_sets.parities(shingle_sets._in_order(None, np.array([0, n]), np.array(x)))[0].as_py() for x in (some, other)]
        assert len(odd[0]) * 64 >= n
        assert sum((x ^ y).bit_count() if x ^ y >= 0 else 64 - (~(x ^ y)).bit_count() for x, y in zip(*odd)) <= 2 * (n // 10)


def test_rows_with_a_partner_stay(spark):
    """Of all pairs in a bucket that size and place allow, both rows stay."""
    rng = np.random.default_rng(7)
    rows, allowed = [], set()
    for bucket in range(300):
        some = [(int(n), int(rng.integers(0, n // 5 + 1))) for n in rng.integers(20, 60, 2 + bucket % 4)]
        rows += [(100 * bucket + k, n, bucket, place, len(some)) for k, (n, place) in enumerate(some)]
        most = [(n - place) * 2.25 - n + 1e-6 for n, place in some]
        for i, (n, _) in enumerate(some):
            for j, (m, _) in enumerate(some):
                if i != j and min(n, m) >= 0.8 * max(n, m) and m <= most[i] and n <= most[j]:
                    allowed.add(100 * bucket + i)
    placed = spark.createDataFrame(rows, "doc bigint, n int, bucket bigint, place int, members bigint").repartition(3)
    kept = {r.doc for r in classes._with_partner(placed, 0.8).collect()}
    two = {doc for doc, _, _, _, members in rows if members == 2}
    assert allowed <= kept and kept & two == allowed & two and len(kept) < len(rows)
