"""Phrase collocations from suffix subtrees built group by group.

The counting of phrases is that of a suffix tree cut at five words, which would not fit into memory
whole. As in vertical partitioning, the prefixes of suffixes are counted first, by growing length: words,
then pairs of frequent words. A phrase can only be frequent if its words and its pairs are, so a suffix
ends where they aren't, and one without a frequent pair is left out. The remaining prefixes are put into
groups whose suffixes fit a memory budget; a prefix beyond the budget is extended, and its longer
prefixes go to groups of their own. Every group builds its subtree independently: its suffixes in order,
with how many words neighbours have in common; the total of the leaves below a node is the number of
occurrences of its phrase. Suffixes are added up inside each task before they are dealt to groups.

The sets of frequent words and pairs go to the tasks as bit tables of a fixed size. A table may hold
more than the set, which costs work and changes nothing: counts come from words and subtrees alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stores import written
from .texts import Tokens, mix, signed, slices, utf8

MAX_WORDS = 5
MIN_COUNT = 100
BEST = 2000
NO_LANGUAGE = "und"
#: Suffixes of a group, which takes about 200 bytes for each while its subtree is built.
GROUP_SUFFIXES = 1 << 18
#: Bits of the tables of frequent words and pairs: 4 MB each.
TABLE_BITS = 25
#: Bytes of text that a task takes at a time; its arrays take about 80 times that.
SLICE_BYTES = 1 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_LEVELS = [f"w{k}" for k in range(1, MAX_WORDS + 1)]


class Words:
    """The words of a slice: hashes, language of each, and whether the next word follows in the same piece."""

    def __init__(self, part: pa.RecordBatch):
        data, offsets = utf8(part.column("text"))
        breaks = _BREAK[data]
        plain = np.where(breaks, np.uint8(0x20), data)
        text = pa.Array.from_buffers(pa.large_string(), part.num_rows, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(plain)])
        self.tokens = Tokens(text)
        languages = part.column("lang").dictionary_encode()
        self.languages = languages.dictionary.to_pylist()
        self.lang = languages.indices.to_numpy(zero_copy_only=False).astype(np.int64)[self.tokens.doc]
        salts = np.array([int.from_bytes(name.encode()[:256], "little") * 0x9E3779B97F4A7C15 + len(name) & 0xFFFFFFFFFFFFFFFF for name in self.languages], np.uint64)
        self.hashes = self.tokens.hashes
        n = len(self.hashes)
        piece = np.cumsum(breaks)[self.tokens.starts] if n else np.zeros(0, np.int64)
        doc = self.tokens.doc
        self.followed = np.append((piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1]), False)[:n]
        with np.errstate(over="ignore"):
            self.salted = mix(self.hashes + mix(salts)[self.lang]) if n else self.hashes

    def pairs(self) -> np.ndarray:
        """A hash for each word and the next one, and their language."""
        with np.errstate(over="ignore"):
            return mix(self.salted * np.uint64(3) + np.append(self.salted[1:], np.uint64(0))[: len(self.salted)])


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


@dataclass
class BitTable:
    """A set of hashes by their leading bits; may hold more than was put in, never less."""

    bits: np.ndarray

    @staticmethod
    def of(counts: DataFrame, bucket: str) -> BitTable:
        """Of all rows' buckets; they come to the driver as at most 2 ** TABLE_BITS bits."""
        word = F.shiftright(bucket, 6).alias("word")
        bit = F.expr(f"shiftleft(1L, cast({bucket} & 63 AS int))")
        rows = counts.groupBy(word).agg(F.bit_or(bit).alias("bits")).toPandas()
        bits = np.zeros(1 << (TABLE_BITS - 6), np.int64)
        bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
        return BitTable(bits)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        bucket = _bucket(hashes)
        return (self.bits[bucket >> 6] >> (bucket & 63)) & 1 == 1


def _summed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of each key."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    begins = np.flatnonzero(new)
    return order[begins], np.diff(np.append(begins, len(keys)))


def _over_slices(work: Callable[[Words], pa.RecordBatch | None]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_bytes=SLICE_BYTES):
                words = Words(part)
                if len(words.hashes):
                    yield from work(words)

    return run


def _word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and how often it occurs, for every word."""

    def work(words: Words) -> Iterator[pa.RecordBatch]:
        first, count = _summed(words.salted)
        tokens = words.tokens
        begins, ends = tokens.starts[first], tokens.ends()[first]
        raw = tokens.data.tobytes().lower()
        text = pa.array([raw[a:b] for a, b in zip(begins.tolist(), ends.tolist())], pa.binary()).cast(pa.string())
        lang = pa.DictionaryArray.from_arrays(pa.array(words.lang[first]), pa.array(words.languages, pa.string())).cast(pa.string())
        buckets = _bucket(words.salted[first])
        yield pa.record_batch([lang, text, pa.array(signed(words.hashes[first])), pa.array(buckets), pa.array(count)], ["lang", "word", "hash", "bucket", "n"])

    rows = docs.mapInArrow(_over_slices(work), "lang string, word string, hash bigint, bucket bigint, n bigint")
    return rows.groupBy("lang", "word", "hash", "bucket").agg(F.sum("n").alias("n"))


def _pair_counts(docs: DataFrame, words_known) -> DataFrame:
    """Buckets of pairs of frequent words and how many pairs fall into each."""

    def work(words: Words) -> Iterator[pa.RecordBatch]:
        frequent = words_known.value.holds(words.salted)
        both = words.followed & frequent
        both[:-1] &= frequent[1:]
        buckets = _bucket(words.pairs()[both])
        first, count = _summed(buckets)
        yield pa.record_batch([pa.array(buckets[first].astype(np.int32)), pa.array(count.astype(np.int32))], ["bucket", "n"])

    rows = docs.mapInArrow(_over_slices(work), "bucket int, n int")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def _suffixes(docs: DataFrame, pairs_known, heavy: list[int], groups: int) -> DataFrame:
    """Suffixes cut at five words or before a pair that isn't frequent, added up, with the group of each.

    The words behind the cut are 0. extended: the group was chosen by the whole suffix, not by its first pair.
    """
    heavy_buckets = np.sort(np.array(heavy, np.int64))

    def work(words: Words) -> Iterator[pa.RecordBatch]:
        pairs = words.pairs()
        linked = words.followed & pairs_known.value.holds(pairs)
        at = np.flatnonzero(linked)
        if not len(at):
            return
        n = len(linked)
        columns = [words.hashes[at], words.hashes[at + 1]]
        inside = np.ones(len(at), bool)
        with np.errstate(over="ignore"):
            key = pairs[at].copy()
            for k in range(2, MAX_WORDS):
                inside &= linked[np.minimum(at + k - 1, n - 1)]
                columns.append(np.where(inside, words.hashes[np.minimum(at + k, n - 1)], np.uint64(0)))
                key = mix(key * np.uint64(5) + columns[-1])
        first, count = _summed(key)
        place = at[first]
        bucket = _bucket(pairs[place])
        extended = np.isin(bucket, heavy_buckets)
        group = np.where(extended, key[first], mix(bucket.astype(np.uint64))) % np.uint64(groups)
        lang = pa.DictionaryArray.from_arrays(pa.array(words.lang[place]), pa.array(words.languages, pa.string())).cast(pa.string())
        yield pa.record_batch(
            [pa.array(group.astype(np.int32)), pa.array(extended), lang, *(pa.array(signed(c[first])) for c in columns), pa.array(count)],
            ["grp", "extended", "lang", *_LEVELS, "n"],
        )

    schema = f"grp int, extended boolean, lang string, {', '.join(f'{w} bigint' for w in _LEVELS)}, n bigint"
    rows = docs.mapInArrow(_over_slices(work), schema)
    # a suffix that every slice holds is one row of its group
    return rows.groupBy("grp", "extended", "lang", *_LEVELS).agg(F.sum("n").alias("n"))


def subtree(levels: list[np.ndarray], counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The nodes of a group's subtree: depth in words, a suffix below each node, and its leaves' total.

    levels: the language and then the words of all suffixes, 0 behind their ends. The suffixes are
    ordered, and neighbours compared: a node of depth d begins where fewer than d words are common.
    """
    order = np.lexsort(levels[::-1])
    total = np.concatenate([[0], np.cumsum(counts[order])])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for depth, level in enumerate(levels):
        ranked = level[order]
        new[1:] |= ranked[1:] != ranked[:-1]
        if depth < 2:
            continue
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(order))
        real = ranked[begins] != 0
        yield depth, order[begins[real]], (total[ends] - total[begins])[real]


def _nodes(suffixes: DataFrame, groups: int, min_count: int) -> DataFrame:
    """lang, phrase (hashes of its words) and its occurrences, of all phrases that occur often enough.

    Nodes above the prefix that chose a group are in several groups, and their totals are added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column("grp").to_numpy()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for a, b in zip(cuts, cuts[1:]):
                if kept and a < b and kept[0].column("grp")[0].as_py() != int(group[a]):
                    yield from built(kept)
                    kept = []
                if a < b:
                    kept.append(batch.slice(a, b - a))
        if kept:
            yield from built(kept)

    def built(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        langs = table.column("lang").combine_chunks().dictionary_encode()
        code = langs.indices.to_numpy(zero_copy_only=False)
        words = [table.column(w).to_numpy() for w in _LEVELS]
        counts, extended = table.column("n").to_numpy(), table.column("extended").to_numpy()
        for split in (False, True):
            own = np.flatnonzero(extended == split)
            if not len(own):
                continue
            for depth, at, total in subtree([code[own], *(w[own] for w in words)], counts[own]):
                whole = not split or depth == MAX_WORDS
                at, total = (at[total >= min_count], total[total >= min_count]) if whole else (at, total)
                phrase = np.stack([w[own[at]] for w in words[:depth]], axis=1).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * depth, pa.int32()), pa.array(phrase))
                lang = pa.DictionaryArray.from_arrays(pa.array(code[own[at]]), langs.dictionary).cast(pa.string())
                yield pa.record_batch([lang, lists, pa.array(total), pa.array(np.full(len(at), whole))], ["lang", "phrase", "n", "whole"])

    dealt = suffixes.repartition(groups, "grp").sortWithinPartitions("grp")
    rows = written.table(dealt.mapInArrow(run, "lang string, phrase array<bigint>, n bigint, whole boolean"), "nodes")
    parts = rows.where("not whole").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return rows.where("whole").select("lang", "phrase", "n").unionByName(parts.select("lang", "phrase", "n"))


def _exact(column: str) -> Column:
    """For products beyond 64 bits: a factor of at most 15 digits."""
    return F.col(column).cast("decimal(15,0)")


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, budget: int = GROUP_SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """Tables of all words (lang, word, hash, n), and of all phrases of 2 to 5 words that occur at least
    `min_count` times (lang, phrase as word hashes, n)."""
    spark = docs.sparkSession
    docs = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))
    words = written.table(_word_counts(docs), "words")
    frequent = spark.sparkContext.broadcast(BitTable.of(words.where(F.col("n") >= min_count), "bucket"))
    pairs = written.table(_pair_counts(docs, frequent).where(F.col("n") >= min_count), "pairs")
    known = spark.sparkContext.broadcast(BitTable.of(pairs, "bucket"))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # at most total / budget prefixes are beyond the budget
    budget = max(budget, total >> 16)
    groups = 1 + 2 * total // budget
    heavy = [r.bucket for r in pairs.where(F.col("n") > budget).select("bucket").collect()]
    return words, written.table(_nodes(_suffixes(docs, known, heavy, groups), groups, min_count), "phrases")


def best_phrases(docs: DataFrame, min_count: int = MIN_COUNT, best: int = BEST, budget: int = GROUP_SUFFIXES) -> DataFrame:
    """The best phrases of each language of `docs` (text, lang): lang, rank, phrase, a, l, r, n, score.

    Texts are cut at `[.,;:!?\\x0A-\\x0D]` into pieces and these at blanks and tabs into words, A to Z in
    lower case. A phrase is 2 to 5 words in a row inside a piece and occurs a >= min_count times, overlaps
    included. Cut after any of its words, its parts occur l and r times, and n is the number of all
    words; its score is the least of floor(1000 a n / (l r)), at the first cut that has it. A phrase
    inside a longer one that occurs as often is dropped. Ties in rank go to the more frequent, then to
    the first in order of bytes.

    A null text is empty; a null language is `und`, together with a language of that name. Repeated
    rows count as often as they come. No other column is read. Without a phrase, the result is empty.
    """
    words, phrases = phrase_counts(docs, min_count, budget)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    single = words.where(F.col("n") >= min_count).select("lang", F.array("hash").alias("phrase"), "n")
    every = single.unionByName(phrases)
    # nothing that is longer by more than a word occurs as often unless something between does
    longer = phrases.where(F.size("phrase") > 2).select("lang", F.size("phrase").alias("size"), "phrase", F.col("n").alias("longer"))
    inner = longer.select("lang", "longer", F.explode(F.array(F.expr("slice(phrase, 1, size - 1)"), F.expr("slice(phrase, 2, size - 1)"))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = phrases.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("n"))).drop("longer")
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("slice(phrase, 1, k)").alias("left"), F.expr("slice(phrase, k + 1, size(phrase) - k)").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        part = every.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
        cuts = cuts.join(part, ["lang", side])
    cuts = cuts.join(totals.select("lang", F.col("total").alias("n")), "lang")
    for name in "alrn":
        cuts = cuts.withColumn(f"{name}_", _exact(name))
    cuts = cuts.withColumn("score", F.expr("(cast(1000 AS decimal(4,0)) * a_ * n_) div (l_ * r_)"))
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c"))
    worst = worst.select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")
    # with all that tie at the end, before the words are known
    among = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = written.table(worst.withColumn("place", F.rank().over(among)).where(F.col("place") <= best).drop("place"), "first-phrases")
    spelled = first.select("lang", "phrase", F.posexplode("phrase").alias("at", "hash")).join(words.select("lang", "hash", "word"), ["lang", "hash"])
    spelled = spelled.groupBy("lang", "phrase").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = first.join(spelled, ["lang", "phrase"]).withColumn("phrase", F.array_join("w.word", " ")).drop("w")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
