"""Operators over documents against brute force on small rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fixhound.llm import decontaminate, dedup, language, pitman_yor, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, n bigint, score double, doc string"


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [f"w{i}" for i in np.minimum(rng.zipf(1.3, n), vocabulary)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1, 0.5, "x") for i, t in texts], SCHEMA)


def shingles(text):
    words = WORD.findall(text.lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else Counter()


def similar(a, b):
    both = sum((a & b).values())
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


def test_near_duplicates(spark):
    base = prose(1, 200, 100_000)
    texts = [" ".join(base)]
    for k in range(40):
        edited = list(base)
        for place in np.random.default_rng(k).integers(0, 200, k % 12):
            edited[place] = f"e{k}"
        texts.append(" ".join(edited))
    passage = " ".join(prose(2, 60, 100_000))
    texts += [passage + " " + " ".join(prose(100 + k, 15, 100_000)) for k in range(20)]
    texts += [texts[0], texts[3], "", None, "", "a b", "A  b", "a b c", "x " * 3000, "x " * 2000]
    got = {r.doc_id: r.class_id for r in dedup.classes(frame(spark, enumerate(texts))).collect()}
    bags = [shingles(t or "") for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or similar(bags[i], bags[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert got == dict(enumerate(label))


def test_near_duplicates_of_repeated_rows_and_none(spark):
    rows = frame(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (3, "z")])
    assert sorted(map(tuple, dedup.classes(rows).collect()), key=str) == sorted([(5, 5), (5, 5), (None, 5), (3, 3)], key=str)
    assert dedup.classes(rows.where("false")).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    elements = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    weights = rng.integers(1, 9, 300).astype(float)
    other = np.where(np.arange(300) < 60, rng.integers(1, 9, 300), weights).astype(float)
    agree = []
    for k in range(30):
        salted = dedup.mix(elements + np.uint64(k))
        a, b = (dedup.signatures(salted, w, np.zeros(300, int), 1) for w in (weights, other))
        agree.append((a == b).mean())
    exact = np.minimum(weights, other).sum() / np.maximum(weights, other).sum()
    assert abs(np.mean(agree) - exact) < 0.03


def test_benchmark_leaks(spark):
    items = [(1, " ".join(prose(10, 30, 100_000))), (2, " ".join(prose(11, 55, 100_000))), (3, None), (4, "too short"), (5, " ".join(prose(12, 9, 100_000)))]
    around = lambda seed: " ".join(prose(seed, 37 + seed, 100_000))
    edited = items[1][1].split()
    edited[50] = "other"
    docs = [(0, None), (1, ""), (2, around(20))]
    docs += [(3 + k, f"{around(21 + k)} {items[0][1].upper()}. {around(40 + k)}") for k in range(5)]
    docs += [(8, items[1][1]), (9, around(30) + " " + " ".join(edited)), (10, items[4][1] + "\n" + items[0][1]), (10, items[4][1]), (11, " ".join(items[0][1].split()[:15]))]
    rows = frame(spark, docs)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, table).collect())
    assert found == [*((3 + k, 1) for k in range(5)), (8, 2), (9, 2), (10, 1), (10, 5), (10, 5)]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, table, items_a_pass=1).collect()) == found
    assert decontaminate.contaminated(rows, table.where("false")).count() == decontaminate.contaminated(rows.where("false"), table).count() == 0


@pytest.mark.parametrize("size, edits, within", [(400, 8, 200), (800, 16, 200), (1500, 30, 1500), (12, 1, 12), (5, 0, 5), (6, 0, 6), (30, 1, 30), (120, 2, 120)])
def test_edited_items_are_found_wherever_the_edits_are(size, edits, within):
    """Brute force: every passage at least 0.8 similar to the item, with words replaced, dropped or added."""
    wanted = found = 0
    for k in range(45):
        rng = np.random.default_rng(k)
        item = prose(1000 + k, size, 10**9) if size < 100 else [f"v{x}" for x in rng.integers(0, 10**6, size)]
        edited = list(item)
        for place in sorted(rng.choice(within, edits, replace=False), reverse=True):
            edited[place : place + (k % 3 < 2)] = [] if k % 3 == 1 else [f"new{place}"]
        if similar(shingles(" ".join(item)), shingles(" ".join(edited))) < 0.8:
            continue
        wanted += 1
        around = [" ".join(f"a{x}" for x in rng.integers(0, 10**6, rng.integers(0, 50))) for _ in range(2)]
        index = decontaminate.ItemIndex.build([7], [" ".join(item)])
        found += [h[:2] for h in index.find(pa.array([f"{around[0]} {' '.join(edited)} {around[1]}"], pa.large_string()))] == [(0, 7)]
    assert wanted and found >= 0.98 * wanted


def test_benchmark_leaks_edge_cases(spark):
    item = " ".join(prose(50, 40, 100_000))
    long = " ".join(prose(51, 60_000, 100_000))
    docs = [(1, f"{long} {item} {long}"), (2, f"{item} x {item}"), (3, "a b c d"), (None, item)]
    table = spark.createDataFrame([(1, item, 3), (1, item, 4), (2, "a b c d", 5), (3, "", 6)], "item_id bigint, text string, start int")
    found = decontaminate.contaminated(frame(spark, docs), table).collect()
    assert sorted([(r.doc_id, r.item_id, r.start) for r in found], key=str) == sorted([(1, 1, 60_000), (1, 1, 60_000), (2, 1, 0), (2, 1, 0), (None, 1, 0), (None, 1, 0)], key=str)


def test_near_duplicates_of_shared_ids(spark):
    """Rows that share an id are compared each by its own text."""
    a, b = prose(60, 100, 100_000), prose(61, 100, 100_000)
    near = lambda words: " ".join(["first", *words[1:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (None, "lone " + " ".join(prose(62, 50, 10**5)))]
    got = sorted(map(tuple, dedup.classes(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (None, None)], key=str)
    kept = dedup.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 1, None], key=str)


def test_a_passage_in_many_different_documents_gives_few_pairs(spark, monkeypatch):
    """Below 0.8 similar to each other: documents that share a passage hardly ever meet."""
    passage = " ".join(prose(70, 70, 10**9))
    texts = [f"{passage} " + " ".join(f"d{k}w{i}" for i in range(14)) for k in range(2000)]
    pairs = []
    across = dedup._across
    monkeypatch.setattr(dedup, "_across", lambda *a: pairs.append(across(*a)) or pairs[-1])
    classes = dedup.classes(frame(spark, enumerate(texts)))
    assert classes.where("class_id = doc_id").count() == 2000
    assert pairs[0].count() < 2000


def test_block_index_finds_all_within_the_radius():
    rng = np.random.default_rng(5)
    index = decontaminate.ItemIndex.build([1], [" ".join(prose(13, 31, 100_000))])
    size = next(iter(index.tables))
    mark = index.tables[size][2][0]
    for bits in range(decontaminate.RADIUS + 1):
        for _ in range(50):
            near = mark
            for b in rng.choice(64, bits, replace=False):
                near ^= np.uint64(1) << np.uint64(b)
            window, _, shift = index.candidates(size, np.array([near], np.uint64))
            assert 0 in shift


def test_pitman_yor_counts_and_probabilities(spark):
    texts = [(i, " ".join(prose(i, 50, 30))) for i in range(40)] + [(40, None), (41, ""), (42, "neverseen W1 \x1f"), (43, "w1 w2"), (43, "w1 w2")]
    docs = frame(spark, texts).selectExpr("doc_id", "text", "doc_id % 5 != 2 as train", "lang")
    got = {r.doc_id: r for r in pitman_yor.score(docs).collect()}
    tokens = {i: [*WORD.findall((t or "").lower()), None] for i, t in texts}
    counts = Counter(w for i, t in texts if i % 5 != 2 for w in [*WORD.findall((t or "").lower()), None])
    n, v = sum(counts.values()), len(counts)
    for i, words in tokens.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert got[i].score < 0
    assert got[40].score == got[41].score
    trained = [r for i, r in got.items() if i % 5 != 2 and i < 40]
    assert sum(r.score for r in trained) > sum(r.base_score for r in trained)


def test_pitman_yor_scores_each_row_by_itself(spark):
    rows = [(1, "alpha beta gamma"), (1, "alpha"), (None, "x y z w"), (-1, "alpha beta"), (None, None), (7, "word " * 50_000)]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "true as train", "n as id", "score as n_tokens")
    got = sorted(((r.doc_id, r.n_tokens) for r in pitman_yor.score(docs).collect()), key=str)
    assert got == sorted([(1, 4), (1, 2), (None, 5), (-1, 3), (None, 1), (7, 50_001)], key=str)


def test_pitman_yor_sums_to_one(spark):
    docs = frame(spark, [(i, " ".join(prose(i, 60, 20))) for i in range(30)]).selectExpr("text", "true as train")
    one = spark.createDataFrame([(" ".join([f"w{i}" for i in range(1, 21)]),)], "text string").selectExpr("text", "false as train")
    words = pitman_yor.word_counts(docs.unionByName(one).coalesce(1)).collect()
    context = max(c for r in words for c in r.contexts)
    flat = [(np.uint64(r.word & (2**64 - 1)), r) for r in words]
    word = np.array([w for w, _ in flat], np.uint64)
    n = np.array([dict(zip(r.contexts, r.counts)).get(context, 0) for _, r in flat])
    sampler = pitman_yor.Sampler(len(flat), 0.7, 0.5)
    c, t = np.zeros(pitman_yor.CONTEXTS), np.zeros(pitman_yor.CONTEXTS)
    c[context], t[context] = n.sum(), (n > 0).sum()
    start = {"c": c, "t": t, "rc": float((n > 0).sum()), "rt": float((n > 0).sum())}
    contexts = np.full(len(word), context)
    tables, at, root_n, root_t = next(sampler.sweeps(word, contexts, n, [start]))
    t = t.copy()
    t[context] = tables.sum()
    now = {"c": c, "t": t, "rc": float(root_n.sum()), "rt": float(root_t.sum())}
    root = sampler.root_estimate(root_n, root_t, now)
    p = sampler.estimate(contexts, n, tables, np.arange(len(word)), root, now)
    free = (1.0 + 0.5 * root_t.sum()) / (len(word) + 1) / (1.0 + root_n.sum())
    unseen = (1.0 + 0.7 * tables.sum()) * free / (1.0 + n.sum())
    assert p.sum() + unseen == pytest.approx(1.0)
    assert ((tables >= (n > 0)) & (tables <= n)).all()


def test_pitman_yor_has_a_restaurant_for_each_word_before(spark, monkeypatch):
    """All pairs in one place, with whole words as contexts, give what blocks and wards give, whichever words are frequent."""
    same_ending = ["nation", "station", "ration", "motion"]
    texts = [" ".join(f"{same_ending[int(w[1:]) % 4]} {w}" for w in prose(i, 40, 60)) for i in range(30)] + [None, "unheard of", "Nation w1 w2"]
    train = [i % 4 != 3 for i in range(len(texts))]
    word, context, doc, _ = pitman_yor.tokens_with_end(pa.array(texts))
    assert len(np.unique(context)) == len({w.lower() for t in texts for w in WORD.findall(t or "")}) + 1
    pairs, at = np.unique(np.stack([word, context]), axis=1, return_inverse=True)
    at = at.reshape(-1)
    n = np.bincount(at, np.array(train)[doc], pairs.shape[1]).astype(int)
    names, before = np.unique(pairs[1], return_inverse=True)
    dish = np.unique(pairs[0], return_inverse=True)[1].reshape(-1)
    before = before.reshape(-1)
    by_dish = np.bincount(dish, n > 0)
    discount = lambda x: min(max(((x == 1).sum() + 0.5) / ((x == 1).sum() + 2 * (x == 2).sum() + 1), 0.1), 0.95)
    sampler = pitman_yor.Sampler(int((by_dish > 0).sum()), discount(n), discount(by_dish))
    total = lambda t, rc, rt: {"c": np.bincount(before, n), "t": np.bincount(before, t), "rc": rc.sum(), "rt": rt.sum()}
    totals = [total(n > 0, by_dish, by_dish > 0)]
    mean = 0
    keys = pitman_yor._pair_key(pairs[0], pairs[1])
    for k in range(pitman_yor.SETTLING + pitman_yor.KEPT):
        tables, _, rc, rt = list(sampler.sweeps(pairs[0], before, n, totals, keys))[-1]
        totals.append(total(tables, rc, rt))
        if k >= pitman_yor.SETTLING:
            root = sampler.root_estimate(rc, rt, totals[-1])
            mean = mean + sampler.estimate(before, n, tables, dish, root, totals[-1]) / pitman_yor.KEPT
    wanted = np.bincount(doc, np.log10(mean)[at])
    docs = spark.createDataFrame(list(zip(range(len(texts)), texts, train)), "doc_id bigint, text string, train boolean")
    every = pitman_yor.frequent_words
    for some in (slice(None), slice(3), slice(3, 40, 2), slice(0)):
        monkeypatch.setattr(pitman_yor, "frequent_words", lambda d: (every(d)[0][some], every(d)[1]))
        got = {r.doc_id: r.score for r in pitman_yor.score(docs).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(wanted.tolist(), abs=1e-3)


def test_pitman_yor_of_nothing(spark):
    docs = frame(spark, [(1, "a b"), (2, None)]).selectExpr("doc_id", "text", "false as train")
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in pitman_yor.score(docs).collect()} == {1: (3, 0, 0), 2: (1, 0, 0)}
    assert pitman_yor.score(docs.where("false")).count() == 0


def test_quality_counts(spark):
    texts = ["", None, " \n ", "a b c d e f g h i j", "one two three four five " * 4, "x | y # 5%\nx | y # 5%\n\n \n", "a b c d e q a b c d e r a b c d e", "the " * 30, "w " * 4]
    rows = frame(spark, enumerate(texts))
    got = {r.doc_id: r for r in quality.judge(rows, quality.references(rows)).collect()}
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        runs = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        repeat = {k + j for k in range(len(words) - 4) if runs[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        failed = len(words) < 10 or 100 * len(repeat) > 20 * len(words)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(repeat)), text
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text or "")) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == failed and (not failed or not r.kept)
    assert quality.judge(rows.where("false"), quality.References()).count() == 0
    assert set(rows.columns) <= set(quality.judge(rows, quality.References()).columns)


def test_quality_cuts_no_words_out_for_runs_of_five(spark):
    rows = quality._repeated(quality.with_words(frame(spark, [(1, "a b c d e q a b c d e r")])))
    assert rows.first()["_repeat"] == 10
    assert "slice(" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_quality_counts_kinds_in_compiled_code(spark):
    """Every word of a text, however often it occurs; white space at the ends; and no method that Java leaves uncompiled."""
    often = quality.COUNTED_BY_STEPS
    texts = [(1, "a " * (often - 1) + "b " * often + "c " * (often + 1) + "d " * (2 * often + 5) + "e"), (2, "\n x y\tx\x0b\x0c\r x "), (3, None), (4, " \n"), (5, "")]
    rows = frame(spark, texts)
    wanted = {}
    for _, text in texts:
        words = WORD.findall(text or "")
        wanted |= {w: n / len(words) for w, n in Counter(words).items()}
    hashes = {r.h: r.w for r in spark.createDataFrame([(w,) for w in wanted], "w string").selectExpr("w", "xxhash64(w) AS h").collect()}
    got = quality._kinds(rows.select("text")).collect()
    assert len(got) == len(wanted) and {hashes[r.hash]: r.p for r in got} == pytest.approx(wanted)
    judged = quality.judge(rows, quality.references(rows.selectExpr("doc_id", "text", "concat('l', doc_id % 2) AS lang")))
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort(" not in plan and "sequence(" not in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        code = judged.select("*")._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_quality_verdict(spark):
    common = "the of and to a in that is was for".split()
    good = [" ".join(w for k in range(100) for w in (common[(k * 7 + i) % 10], f"word{k * i % 97}x")) + "." for i in range(1, 30)]
    bad = " ".join(f"q{k}***" for k in range(300))
    rows = frame(spark, [*enumerate(good), (99, bad)])
    got = {r.doc_id: r.kept for r in quality.judge(rows, quality.references(rows)).collect()}
    assert not got[99] and all(got[i] for i in range(len(good)))


def test_quality_distances_of_all_words(spark):
    """Brute force over all words, long and rare ones too; copies and texts without words included."""
    texts = [(i, " ".join(w + "tail" * (int(w[1:]) % 2) for w in prose(i, 60, 500)), "en" if i % 2 else "de") for i in range(12)]
    texts += [(20, texts[0][1], "de"), (21, None, "en"), (22, " \n", None), (23, "unheard of words only", None), (24, "loneword " * 3, "fr")]
    rows = spark.createDataFrame([(i, t, lang, 1, 0.5, "x") for i, t, lang in texts], SCHEMA)
    used = {lang: Counter(w for _, t, own in texts if own == lang for w in WORD.findall(t or "")) for lang in ("de", "en", "fr")}

    def distance(p, q):
        term = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0
        shares = [(p[w] / max(p.total(), 1), q[w] / q.total()) for w in {*p, *q}]
        return math.sqrt(max(sum(term(a, b) + term(b, a) for a, b in shares) / 2, 0))

    known = quality.references(rows)
    for split in (known, quality.References(known.chars, known.words.withColumn("often", quality.F.col("hash") % 2 == 0))):
        got = {r.doc_id: r.far_words for r in quality.judge(rows, split).collect()}
        assert len(got) == len(texts)
        for i, text, _ in texts:
            if words := Counter(WORD.findall(text or "")):
                assert got[i] == pytest.approx(min(distance(words, q) for q in used.values()), abs=1e-7)
            else:
                assert got[i] == 1.0


def test_language(spark):
    words = {"en": "the and with that house river", "de": "der und mit dass haus fluß", "fr": "le et avec que maison rivière"}
    rows = []
    for k, (lang, some) in enumerate(words.items()):
        for i in range(40):
            picked = np.random.default_rng(100 * k + i).choice(some.split(), 12)
            rows.append((len(rows), " ".join(picked), lang, 1, 0.1, "x"))
    rows += [(900, None, "en", 1, 0.1, ""), (901, "123 !", "en", 1, 0.1, ""), (902, "", None, 1, 0.1, ""), (903, "haus fluß " * 5000, None, 1, 0.1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(docs.where("doc_id % 4 != 0"))
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert all(got[i].lang_pred == r[2] for i, r in enumerate(rows) if i < 120)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
    assert got[900].score == 0 and 0 <= got[5].score <= 1
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs.where("false"))).collect()} == {"und"}


def brute_segments(scores):
    """Ruzzo and Tompa by definition: the best run, shortest of equals, then left and right of it."""
    best = max(((sum(scores[i:j]), i - j, -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 1e-12:
        return []
    i = -best[2]
    j = i - best[1]
    move = lambda found, by: [(a + by, b + by, s) for a, b, s in found]
    return brute_segments(scores[:i]) + [(i, j, best[0])] + move(brute_segments(scores[j:]), j)


def test_maximal_segments():
    rng = np.random.default_rng(8)
    for _ in range(60):
        positive = rng.random(25) < 0.3
        scores = np.where(positive, rng.integers(1, 64, 25) / 8, -0.75)
        got = toxicity.maximal_segments(np.flatnonzero(positive), scores[positive], -0.75)
        assert [(a, b, pytest.approx(s)) for a, b, s in got] == brute_segments(scores.tolist())


def test_toxicity(spark):
    rows = [(i, " ".join(prose(i, 80) + (["vilewordy", "nastyterm"] * 2 if i % 3 == 0 else []))) for i in range(120)]
    rows += [(900, None), (901, ""), (902, "vilewordy nastyterm " * 4000), (903, " ".join(prose(903, 50)))]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(1, 0), (None, 1), (2, None), (50, 7)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all((got[i].score >= 0.3) == (i % 3 == 0) for i in range(120))
    assert got[902].score > 0.9 and got[903].score < 0.3 and got[900].score == got[901].score < 0.3
    assert got[0].passages[0]["first"] == 80 and got[0].passages[0]["last"] == 84 and not got[1].passages
    empty = toxicity.fit(docs, labels.where("false"))
    assert {round(r.score, 6) for r in toxicity.score(docs, empty).collect()} == {0.0}
