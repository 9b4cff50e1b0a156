"""Quality rules with DataFrame functions only: counts, and divergence from a language's usual text.

A document's shares of character classes and of all its words are compared with the references of
all languages by Jensen-Shannon distance (base-2 divergence, 0 to 1). References are the shares
over all documents of a language, whatever the length and number of a word. A document is rejected if
it is far from every language, and long enough for that to mean something.

Words that a language has often are sent to the documents; the others are dealt out by word together
with the words of the documents that aren't among the frequent ones. A document and a language that share no word
are at distance 1, and each word that both have lessens the divergence; so only those are looked up, and
what they add is summed by text. Words and texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stores import written

#: Character classes. Plain are lower-case letters and digits, so that numbers in a short text don't
#: make it unusual; stops are the marks of ordinary sentences.
NAMES = ("plain", "white", "upper", "stops", "other")
# ASCII letters one by one: Java looks those up in a table, before it asks for the class of a letter
_PLAIN_OR_WHITE = r"[abcdefghijklmnopqrstuvwxyz0123456789 \t\n\x0B\f\r\p{Ll}]+"
_STOPS = r"[.,;:!?'\"()\-]+"
#: Words that make up this share of a language at least, 1/OFTEN of them at most, are sent to the documents.
OFTEN = 1e-6
#: A word is counted in its text by halving steps up to this many times; one that occurs more often by a pass over the text.
#: All steps are in one compiled method with what follows, and Java compiles none above 8,000 bytes.
COUNTED_BY_STEPS = 1 << 12
#: Documents are judged on characters from this many of them on, on words from this many on.
LEAST_CHARS, LEAST_WORDS = 100, 150
#: A document is rejected beyond these distances (square roots of divergences).
FAR_CHARS, FAR_WORDS = 0.2, 0.91


@dataclass
class References:
    """Shares by language: of character classes; and of words, as a table of hash, shares (in the order of `chars`) and often."""

    chars: dict[str, list[float]] = field(default_factory=dict)
    words: DataFrame | None = None


def _words(text: Column) -> Column:
    """The words of a text. Without white space at the ends no empty ones arise, and no function has to drop them."""
    text = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"[\x20\x09-\x0D]+"))


def with_words(docs: DataFrame) -> DataFrame:
    """`docs` with `_words`, `_n` and the lengths of its character classes; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_words", _words(text))
    out = out.withColumn("_n", F.size("_words")).withColumn("_solid", F.length(F.array_join("_words", "")))
    out = out.withColumn("_rest", F.regexp_replace(text, _PLAIN_OR_WHITE, ""))
    out = out.withColumn("_odd", F.regexp_replace("_rest", r"\p{Lu}+", ""))
    out = out.withColumn("_signs", F.regexp_replace("_odd", _STOPS, ""))
    size = {c: F.length(f"_{c}") for c in ("rest", "odd", "signs")}
    return out.withColumns(
        {
            "_plain": F.col("_solid") - size["rest"],
            "_white": F.length(text) - F.col("_solid"),
            "_upper": size["rest"] - size["odd"],
            "_stops": size["odd"] - size["signs"],
            "_other": size["signs"],
            "_marks": size["signs"] - F.length(F.regexp_replace("_signs", "[#*$%&|<>]+", "")),
        }
    ).drop("_rest", "_odd", "_signs")


def references(docs: DataFrame) -> References:
    """References from all of `docs` (text, lang); rows without a language don't count."""
    seen = with_words(docs.where("lang is not null").select("lang", "text"))
    # words first, then the lengths of the character classes and the number of words: told apart by their place
    # as rows words are hashed by compiled code, which functions of arrays are not
    entries = F.concat("_words", F.array(*[F.col(f"_{n}").cast("string") for n in (*NAMES, "n")]))
    # outer: else Spark asks first whether there is an element, and makes all of them twice
    counted = seen.select("lang", "_n", F.posexplode_outer(entries).alias("at", "x"))
    word = F.col("at") < F.col("_n")
    kind = F.when(word, 0).otherwise(F.col("at") - F.col("_n") + 1).cast("tinyint")
    hashed, n = F.when(word, F.xxhash64("x")).otherwise(0), F.when(word, 1).otherwise(F.col("x").try_cast("bigint"))
    counted = counted.select("lang", kind.alias("kind"), hashed.alias("hash"), n.cast("bigint").alias("n"))
    counted = counted.groupBy("lang", "kind", "hash").agg(F.sum("n").alias("n"))
    counted = written.table(counted, "quality-counts")
    total: dict[str, list[int]] = {}
    for r in counted.where("kind > 0").collect():
        total.setdefault(r["lang"], [0] * (len(NAMES) + 1))[r["kind"] - 1] = r["n"]
    out = References()
    filled = [lang for lang, t in sorted(total.items()) if t[-1]]
    if not filled:
        return out
    for lang in filled:
        sizes = total[lang][:-1]
        out.chars[lang] = [n / sum(sizes) for n in sizes]
    share = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)) / F.lit(float(total[lang][-1])) for lang in filled]
    shares = counted.where("kind = 0").groupBy("hash").agg(F.array(*share).alias("shares"))
    out.words = written.table(shares.withColumn("often", F.array_max("shares") >= OFTEN), "quality-words")
    return out


def _term(p: Column, q: Column) -> Column:
    """What one class adds to twice the divergence, in bits."""
    middle = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / middle)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / middle)).otherwise(0.0)


def _entropy(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def _distance(twice: Column) -> Column:
    return F.sqrt(F.greatest(twice / 2, F.lit(0.0)))


def with_char_distances(seen: DataFrame, known: References) -> DataFrame:
    """`_far_chars`: distance from the nearest language by character classes; 0 where none is known."""
    if not known.chars:
        return seen.withColumn("_far_chars", F.lit(0.0))
    chars = reduce(lambda a, b: a + b, [F.col(f"_{n}") for n in NAMES])
    seen = seen.withColumn("_chars", F.greatest(chars, F.lit(1)))
    each = []
    for shares in known.chars.values():
        terms = [_term(F.col(f"_{n}") / F.col("_chars"), F.lit(q)) for n, q in zip(NAMES, shares)]
        each.append(_distance(reduce(lambda a, b: a + b, terms)))
    return seen.withColumn("_far_chars", F.array_min(F.array(*each)))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _kinds(texts: DataFrame) -> DataFrame:
    """`_text` (hash), `hash` and share `p` of every different word of every row of `texts` (text) that has one."""
    hashes = F.sort_array(F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)))
    sorted_ = texts.where("text is not null").select(_text_hash().alias("_text"), hashes.alias("all"))
    # outer: else Spark asks first whether there is an element, and makes all of them twice
    rows = sorted_.select("_text", "all", F.posexplode_outer("all").alias("at", "hash"))
    rows = rows.where(F.col("hash").isNotNull() & ((F.col("at") == 0) | (F.get("all", F.col("at") - 1) != F.col("hash"))))
    # `last` of the equal ones
    rows, step = rows.withColumn("last", F.col("at")), COUNTED_BY_STEPS // 2
    while step:
        rows = rows.withColumn("next", F.col("last") + step)
        rows = rows.withColumn("last", F.when(F.get("all", "next") == F.col("hash"), F.col("next")).otherwise(F.col("last")))
        step //= 2
    k, n = F.col("last") - F.col("at") + 1, F.size("all")
    rows = rows.withColumn("k", F.when(k == COUNTED_BY_STEPS, n - F.size(F.array_remove("all", F.col("hash")))).otherwise(k))
    return rows.select("_text", (F.col("k") / n).alias("p"), "hash")


def _word_distances(texts: DataFrame, known: References) -> DataFrame:
    """`_text` (hash) and `_far_words` of every different text of `texts` (text)."""
    kinds = _kinds(texts)
    # a word lessens twice the divergence by (p + q) log(p + q) - p log p - q log q, 0 if q is 0; the last part is made once a word
    langs = range(len(known.chars))
    shares = [F.get("shares", F.lit(k)) for k in langs]
    by_lang = [q.alias(f"q{k}") for k, q in enumerate(shares)] + [_entropy(q).alias(f"own{k}") for k, q in enumerate(shares)]
    often, rare = (known.words.where(c).select("hash", *by_lang) for c in ("often", "not often"))
    common = kinds.join(F.broadcast(often), "hash")
    others = kinds.join(F.broadcast(often.select("hash")), "hash", "left_anti").join(rare, "hash")
    less = [(_entropy(F.col("p") + F.col(f"q{k}")) - F.col("own") - F.col(f"own{k}")).alias(f"less{k}") for k in langs]
    # a row for each copy of a text, whether it has words or not
    copies = texts.select(_text_hash().alias("_text"), *[F.lit(0.0).alias(f"less{k}") for k in langs], F.lit(1).alias("copies"))
    parts = [rows.withColumn("own", _entropy(F.col("p"))).select("_text", *less, F.lit(0).alias("copies")) for rows in (common, others)]
    sums = copies.unionByName(parts[0]).unionByName(parts[1]).groupBy("_text")
    sums = sums.agg(F.sum("copies").alias("copies"), *[F.sum(f"less{k}").alias(f"less{k}") for k in langs])
    each = [_distance(2 - F.col(f"less{k}") / F.col("copies")) for k in range(len(less))]
    return sums.select("_text", F.array_min(F.array(*each)).alias("_far_words"))


def _repeated(seen: DataFrame) -> DataFrame:
    """`_repeat`: words that stand in a run of five words found twice or more in the text."""
    # of hashes, so that a word is read once
    # the last four are shorter, so none of them equals another
    runs = F.transform("_hashes", lambda h, i: F.xxhash64(h, *[F.get("_hashes", i + k) for k in range(1, 5)]))
    seen = seen.withColumn("_hashes", F.when(F.col("_n") >= 5, F.transform("_words", lambda w: F.xxhash64(w))))
    seen = seen.withColumn("_runs", F.when(F.col("_n") >= 5, runs).otherwise(F.array().cast("array<bigint>"))).drop("_hashes")
    twice = F.size(F.array_distinct("_runs")) < F.size("_runs")
    placed = F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    seen = seen.withColumn("_order", F.when(twice, F.sort_array(placed)))
    same = lambda i, j: F.get("_order", i)["h"] == F.get("_order", j)["h"]
    marked = F.filter("_order", lambda x, k: F.coalesce(same(k - 1, k), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    seen = seen.withColumn("_places", F.sort_array(F.transform(marked, lambda x: x["i"])))
    # a run covers its five words, less those that the next one covers too
    covered = F.transform("_places", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("_places", k + 1) - p, F.lit(5))))
    return seen.withColumn("_repeat", F.coalesce(F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)))


def judge(docs: DataFrame, known: References) -> DataFrame:
    """`docs` with the counts and the verdict behind its columns.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, far_chars, far_words,
    kept. Null and empty texts have no words and fail; repeated rows each get their verdict. Columns
    of `docs` with these names are replaced.
    """
    given = [c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "far_chars", "far_words", "kept")]
    # told apart from the columns made here, and one by one, so that none is shuffled that isn't asked for
    rows = docs.select("text", *[F.col(f"`{c}`").alias(f"_given{k}") for k, c in enumerate(given)])
    seen = with_char_distances(_repeated(with_words(rows)), known)
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    seen = seen.withColumn("_lines", lines)
    chars = reduce(lambda a, b: a + b, [F.col(f"_{n}") for n in NAMES])
    counts = seen.select(
        *[f"_given{k}" for k in range(len(given))],
        _text_hash().alias("_text"),
        F.col("_n").cast("bigint").alias("n_words"),
        F.col("_solid").cast("bigint").alias("word_chars"),
        F.col("_marks").cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"),
        chars.alias("_chars"),
        F.col("_far_chars").alias("far_chars"),
    )
    if known.words is None:
        counts = counts.withColumn("far_words", F.lit(0.0))
    else:
        counts = counts.join(_word_distances(docs.select("text"), known), "_text").withColumnRenamed("_far_words", "far_words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = ((F.col("_chars") >= LEAST_CHARS) & (F.col("far_chars") > FAR_CHARS)) | ((F.col("n_words") >= LEAST_WORDS) & (F.col("far_words") > FAR_WORDS))
    return counts.select(
        *[F.col(f"_given{k}").alias(c) for k, c in enumerate(given)],
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        failed.alias("base_failed"),
        *("far_chars", "far_words"),
        (~failed & ~far).alias("kept"),
    )
