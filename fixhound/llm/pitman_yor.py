"""Hierarchical Pitman-Yor language model, trained and applied by Spark jobs.

Tokens are words and an end. Every word has a restaurant of its own, for the tokens that follow it, and so has
the start of a text; all of them share one parent, the restaurant of no context, whose parent is uniform. A
restaurant seats its customers (tokens) as a Chinese restaurant process with discount: a customer opens a table
with a probability that grows with the parent's estimate, and each table sends one customer to the parent.

Pairs of a context and a word are dealt into blocks, over the whole corpus: all pairs of a rare context are in
one block; those of a frequent context and a rare word are with the word; those of two frequent words
anywhere. Gibbs sweeps lift all customers of a pair and seat them again, one after another, given the totals of
the sweep before: customers and tables of the restaurant and of the word at the parent. Totals of at most `CONTEXTS`
frequent words are sent to every block, those of a rare context are at hand, and those of rare words at the parent
are put together in wards, which seat their tables there and reply to the blocks that hold the word. Which words
count as frequent changes no result. Predictive probabilities are averaged over the sweeps that are kept. Random
numbers come from hashes of word, context and sweep, so a task that is run again gives the same.

Words and texts are told apart by 64-bit hashes. Sums of a text travel as multiples of 1/`STEPS`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stores import written
from .texts import Tokens, mix, signed, slices

#: Frequent words, at most; their numbers are below this, those of a block's rare words follow.
CONTEXTS = 1 << 16
#: Sweeps: the first ones only settle, the others are averaged.
SETTLING, KEPT = 1, 3
#: Bytes of text whose tokens are put together before they are dealt out, and tokens of a block, about.
GATHERED, BLOCK = 6 << 20, 2_000_000
#: Wards at most, and parts in which totals of frequent words are summed.
WARDS, PARTS = 512, 16
STEPS = 1 << 30
_END = np.uint64(0x656E64)
_START = np.uint64(0x7374617274)


def tokens_with_end(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every token and of the whole word before it, and its row, the end of each text behind its words; tokens of each text."""
    words = Tokens(texts)
    counts = words.counts + 1
    ends = np.cumsum(counts) - 1
    inner = np.ones(int(counts.sum()), bool)
    inner[ends] = False
    hashes = np.full(len(inner), _END)
    hashes[inner] = words.hashes
    context = np.roll(hashes, 1)
    context[ends - words.counts] = _START
    return hashes, context, np.repeat(np.arange(len(counts)), counts), counts


def _pair_key(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(word + context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(first)


def _place(keys: np.ndarray, places: int) -> np.ndarray:
    """One of `places` for each 64-bit key, by range."""
    return ((keys >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers, not negative, byte by byte of equal weight."""
    head, parts = [len(arrays)], []
    for a in arrays:
        most = int(a.max()) if len(a) else 0
        width = next(w for w in (1, 2, 4, 8) if not most >> (8 * w))
        head += [len(a), width]
        parts.append(a.astype(f"<u{width}").view(np.uint8).reshape(len(a), width).T.tobytes())
    raw = np.array(head, "<i8").tobytes() + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    count = int.from_bytes(raw[:8], "little")
    head = np.frombuffer(raw, "<i8", 2 * count, 8)
    out, at = [], 8 + 16 * count
    for size, width in head.reshape(-1, 2).tolist():
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(size).astype(np.uint64))
        at += size * width
    return out


def frequent_words(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Hashes of frequent words of `docs` (text), the most frequent first, and the number of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", GATHERED):
                found = tokens_with_end(part.column("text"))[0]
                words, n = np.unique(np.append(found, np.full(part.num_rows, _START)), return_counts=True)
                often = n > len(found) >> 18
                names = pa.array(signed(words[often]))
                yield pa.record_batch([pa.concat_arrays([names, pa.nulls(1, pa.int64())]), pa.array(np.append(n[often], len(found)))], ["word", "n"])

    counted = written.table(docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "lm-often")
    tokens = counted.where("word is null").first()
    best = counted.where("word is not null").orderBy(F.desc("n"), "word").limit(CONTEXTS).toPandas()
    return best["word"].to_numpy(np.int64).view(np.uint64), tokens["n"] if tokens else 0


def _dealt(docs: DataFrame, often: np.ndarray, blocks: int) -> DataFrame:
    """block, slice, pairs and docs of a slice of the texts; for each slice one row more, below block 0, with the keys of its texts.

    pairs: hashes of rare words in order, numbers of context and word of every pair in order, occurrences, those in
    `train` rows. docs: the text of each occurrence, by its number in the slice.
    """
    order = np.argsort(often)
    sorted_ = often[order]

    def numbers(names: np.ndarray) -> np.ndarray:
        out = CONTEXTS + np.arange(len(names))
        if len(sorted_):
            at = np.minimum(np.searchsorted(sorted_, names), len(sorted_) - 1)
            out = np.where(sorted_[at] == names, order[at], out)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", GATHERED):
                word, context, doc, counts = tokens_with_end(part.column("text"))
                train = part.column("train").to_numpy(zero_copy_only=False)
                names, at = np.unique(np.append(word, _START), return_inverse=True)
                number = numbers(names)[at]
                start, number = number[-1], number[:-1]
                before = np.roll(number, 1)
                before[np.cumsum(counts) - counts] = start
                place = np.where(before >= CONTEXTS, context, np.where(number >= CONTEXTS, word, _pair_key(word, context)))
                block = _place(place, blocks)
                pair = before.astype(np.uint64) << np.uint64(32) | number.astype(np.uint64)
                by = np.argsort(pair)
                by = by[np.argsort(block[by].astype(np.uint16), kind="stable")]
                pair, block, doc = pair[by], block[by], doc[by]
                del word, context, place, number, before, at, by
                begin = _runs(pair)
                trained = np.add.reduceat(train[doc].astype(np.int64), begin)
                times = np.diff(np.append(begin, len(pair)))
                pair, inside = pair[begin], block[begin]
                first = _runs(inside)
                rows = []
                for a, b in zip(first.tolist(), np.append(first[1:], len(inside)).tolist()):
                    both = [pair[a:b] >> np.uint64(32), pair[a:b] & np.uint64(0xFFFFFFFF)]
                    rare = np.unique(np.concatenate([x[x >= CONTEXTS] for x in both]))
                    both = [np.where(x < CONTEXTS, x, np.uint64(CONTEXTS) + np.searchsorted(rare, x).astype(np.uint64)) for x in both]
                    occurs = doc[begin[a] : begin[b - 1] + times[b - 1]]
                    rows.append((int(inside[a]), made, pack(names[rare.astype(np.int64) - CONTEXTS], *both, times[a:b], trained[a:b]), pack(occurs)))
                keys = part.column("key").to_numpy().view(np.uint64)
                rows.append((-1 - made % 1021, made, pack(keys), b""))
                made += 1
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["block", "slice", "pairs", "docs"])

    return docs.select("key", "text", "train").mapInArrow(run, "block int, slice bigint, pairs binary, docs binary")


def _merged(rows: pa.Table) -> pa.Table:
    """All of a block: a row of its pairs, as in `_dealt` without the occurrences, and a row for each slice, with the
    steps from pair to pair and their occurrences."""
    block = rows.column("block")[0].as_py()
    if block < 0:
        out = [("keys", row["slice"], row["pairs"], b"") for row in rows.select(["slice", "pairs"]).to_pylist()]
    else:
        parts = [unpack(x) for x in rows.column("pairs").to_pylist()]
        names = np.unique(np.concatenate([x[0] for x in parts]))
        keys = []
        for rare, before, number, _, _ in parts:
            to = np.searchsorted(names, rare).astype(np.uint64) + np.uint64(CONTEXTS)
            both = [np.where(x < CONTEXTS, x, to[np.maximum(x.astype(np.int64) - CONTEXTS, 0)] if len(to) else x) for x in (before, number)]
            keys.append(both[0] << np.uint64(32) | both[1])
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate([x[4] for x in parts]), len(every)).astype(np.int64)
        out = [("pairs", -1, pack(names, every >> np.uint64(32), every & np.uint64(0xFFFFFFFF), n), b"")]
        ends = np.cumsum([len(x) for x in keys])
        for k, row in enumerate(rows.select(["slice", "docs"]).to_pylist()):
            places = at[ends[k] - len(keys[k]) : ends[k]]
            out.append(("texts", row["slice"], pack(np.diff(places, prepend=0), parts[k][3]), row["docs"]))
    columns = list(zip(*out))
    return pa.table([pa.array([block] * len(out), pa.int32()), *[pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.binary()))]], ["block", "kind", "slice", "pairs", "docs"])


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)) * (1.0 / (1 << 53))


def seat(customers: np.ndarray, appeal: np.ndarray, discount: float, keys: np.ndarray, salt: int) -> np.ndarray:
    """Tables after seating `customers` of one dish in each of many restaurants.

    appeal: (concentration + discount x tables) x the parent's estimate of the dish. After m
    customers at t tables the next opens one with the chance appeal / (appeal + m - discount t). Up to 32
    customers are seated one by one, later ones in growing groups at the chance of the moment.
    """
    tables = (customers > 0).astype(float)
    at = np.flatnonzero(customers > 1)
    m, step = 1, 0
    while len(at):
        group = np.minimum(max(1, m // 16), customers[at] - m) if m >= 32 else np.ones(len(at), np.int64)
        chance = appeal[at] / (appeal[at] + m - discount * tables[at])
        u = _uniform(keys[at], salt * 1009 + step)
        if m < 32:
            tables[at] += u < chance
        else:
            mean = group * chance
            spread = np.sqrt(np.maximum(mean * (1 - chance), 0))
            normal = np.sqrt(-2 * np.log(np.maximum(u, 1e-15))) * np.cos(2 * np.pi * _uniform(keys[at], salt * 1009 + step + 500_000))
            many = np.clip(np.rint(mean + spread * normal), 0, group)
            few = np.minimum((u < mean).astype(float), group)
            tables[at] += np.where(mean > 4, many, np.minimum(few + np.floor(mean), group))
        m += int(max(1, m // 16)) if m >= 32 else 1
        step += 1
        at = at[customers[at] > m]
    return np.minimum(tables, customers)


class Sampler:
    """Gibbs sweeps over dishes, each with its counts by restaurant."""

    def __init__(self, words: int, discount: float, root_discount: float, concentration: float = 1.0):
        self.words, self.discount, self.root_discount, self.concentration = words, discount, root_discount, concentration

    def sweeps(
        self, word: np.ndarray, context: np.ndarray, n: np.ndarray, totals: list[dict[str, np.ndarray | float]], keys: np.ndarray | None = None
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Where all pairs of all dishes are at hand. After each sweep: tables by pair; begin of each dish; its customers and tables at the parent.

        Rows are sorted by word; keys: hashes of the pairs. totals: of the sweeps so far, customers and tables of every restaurant (`c`, `t`) and of
        the parent (`rc`, `rt`); sweep k uses those of sweep k - 1, the first one starts from one table for each pair.
        """
        at = _runs(word)
        dish = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(word))))
        keys = _pair_key(word, context) if keys is None else keys
        root_customers = np.add.reduceat((n > 0).astype(float), at) if len(at) else np.zeros(0)
        root_tables = (root_customers > 0).astype(float)
        for k, known in enumerate(totals):
            tables = self.seat_pairs(n, known["t"][context], self.root_estimate(root_customers, root_tables, known)[dish], keys, k)
            root_customers = np.add.reduceat(tables, at) if len(at) else np.zeros(0)
            root_tables = self.seat_root(root_customers, known, word[at], k)
            yield tables, at, root_customers, root_tables

    def seat_pairs(self, n: np.ndarray, tables: np.ndarray, root: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
        """Tables of each pair in sweep k, given all tables of its restaurant and the parent's estimate of its dish."""
        out = (n > 0).astype(float)
        at = np.flatnonzero(n > 1)
        out[at] = seat(n[at], (self.concentration + self.discount * tables[at]) * root[at], self.discount, keys[at], 2 * k)
        return out

    def seat_root(self, customers: np.ndarray, known: dict, words: np.ndarray, k: int) -> np.ndarray:
        """Tables of each dish at the parent in sweep k."""
        base = np.full(len(customers), (self.concentration + self.root_discount * known["rt"]) / (self.words + 1))
        return seat(customers.astype(np.int64), base, self.root_discount, words, 2 * k + 1)

    def root_estimate(self, customers: np.ndarray, tables: np.ndarray, total: dict) -> np.ndarray:
        """The parent's estimate of each dish; without any customer the uniform one."""
        free = (self.concentration + self.root_discount * total["rt"]) / (self.words + 1)
        return (np.maximum(customers - self.root_discount * tables, 0) + free) / (self.concentration + total["rc"])

    def estimate(self, context: np.ndarray, n: np.ndarray, tables: np.ndarray, dish: np.ndarray, root: np.ndarray, total: dict) -> np.ndarray:
        """Predictive probability of each pair."""
        back = self.concentration + self.discount * total["t"][context]
        return (np.maximum(n - self.discount * tables, 0) + back * root[dish]) / (self.concentration + total["c"][context])


class Block:
    """Pairs of a block, and what it knows of its words: tables of their restaurants, customers and tables at the parent, occurrences."""

    def __init__(self, packed: bytes, often: np.ndarray):
        self.names, before, number, n = unpack(packed)
        self.before, self.number, self.n = before.astype(np.int64), number.astype(np.int64), n.astype(np.int64)
        self.size = CONTEXTS + len(self.names)
        every = np.zeros(self.size, np.uint64)
        every[: len(often)], every[CONTEXTS:] = often, self.names
        self.keys = _pair_key(every[self.number], every[self.before])
        # words to ask for: the rare ones that follow another one
        self.asked = np.flatnonzero(np.bincount(self.number, minlength=self.size)[CONTEXTS:])

    def by_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.before, values, self.size)

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.number, values, self.size)

    def known(self, rows: list[dict], total: dict) -> dict[str, np.ndarray]:
        """t, rc, rt and occurrences by number, of the replies to this block and the totals of frequent words."""
        out = {x: np.concatenate([y, np.zeros(len(self.names))]) for x, y in total["often"].items()}
        replies = {row["ward"]: unpack(row["data"]) for row in rows}
        out["t"][CONTEXTS:] = replies.pop(-1)[0]
        if replies:
            for x, parts in zip(("rc", "rt", "n"), zip(*[replies[w] for w in sorted(replies)])):
                out[x][CONTEXTS + self.asked] = np.concatenate(parts)
        return out


def _sweep(wards: int, often: np.ndarray, sampler: Sampler | None, known: dict | None, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Seats the pairs of a block in sweep k (one table for each before the first). What is sent: tables of its rare contexts to
    itself (ward -1), customers and occurrences of rare words to wards, all of frequent words behind the wards."""

    def run(pairs: pa.Table, state: pa.Table) -> pa.Table:
        number = pairs.column("block")[0].as_py()
        block = Block(pairs.column("pairs")[0].as_py(), often)
        n = block.n
        if sampler is None:
            tables = (n > 0).astype(float)
        else:
            own = block.known(state.select(["ward", "data"]).to_pylist(), known)
            root = sampler.root_estimate(own["rc"], own["rt"], known)
            tables = sampler.seat_pairs(n, own["t"][block.before], root[block.number], block.keys, k)
        t, rc, occurs, c = block.by_context(tables), block.by_word(tables), block.by_word(n), block.by_context(n)
        rows = [(-1, pack(t[CONTEXTS:].astype(np.int64)))]
        names = block.names[block.asked]
        ward = _place(names, wards)
        first = _runs(ward)
        for a, b in zip(first.tolist(), np.append(first[1:], len(ward)).tolist()):
            some = CONTEXTS + block.asked[a:b]
            rows.append((int(ward[a]), pack(names[a:b], rc[some].astype(np.int64), occurs[some].astype(np.int64))))
        seen = np.array([n.sum(), (n == 1).sum(), (n == 2).sum()])
        step = CONTEXTS // PARTS
        for part in range(PARTS):
            some = slice(part * step, (part + 1) * step)
            rows.append((wards + part, pack(*[x[some].astype(np.int64) for x in (t, rc, occurs, c)], seen if part == 0 else 0 * seen)))
        to, data = zip(*rows)
        return pa.table([pa.array(to, pa.int32()), pa.array([number] * len(to), pa.int32()), pa.array(data, pa.binary())], ["ward", "block", "data"])

    return run


def _reply(wards: int, sampler: Sampler | None, known: dict | None, k: int) -> Callable[[pa.Table], pa.Table]:
    """Customers, tables and occurrences at the parent to every block that holds a word of the ward, in the order of its question.

    Below block 0: sums of the ward (customers, tables, trained words, those with one and with two customers), or of a part
    of the frequent words.
    """

    def run(rows: pa.Table) -> pa.Table:
        ward = rows.column("ward")[0].as_py()
        blocks = rows.column("block").to_pylist()
        if ward >= wards:
            sums = reduce(lambda a, b: [x + y for x, y in zip(a, b)], map(unpack, rows.column("data").to_pylist()))
            out = [(-1, pack(*sums))]
        else:
            asked = [unpack(x) for x in rows.column("data").to_pylist()]
            names, at = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
            customers, occurs = (np.bincount(at, np.concatenate([x[j] for x in asked]), len(names)) for j in (1, 2))
            tables = (customers > 0).astype(float) if sampler is None else sampler.seat_root(customers, known, names, k)
            values = [x.astype(np.int64) for x in (customers, tables, occurs)]
            out, end = [], 0
            for block, x in zip(blocks, asked):
                some = at[end : end + len(x[0])]
                end += len(some)
                out.append((block, pack(*[v[some] for v in values])))
            out.append((-1, pack(np.array([customers.sum(), tables.sum(), (customers > 0).sum(), (customers == 1).sum(), (customers == 2).sum()], np.int64))))
        to, data = zip(*out)
        return pa.table([pa.array(to, pa.int32()), pa.array([ward] * len(to), pa.int32()), pa.array(data, pa.binary())], ["block", "ward", "data"])

    return run


_MERGED = "block int, kind string, slice bigint, pairs binary, docs binary"
_MESSAGES = "ward int, block int, data binary"


class Model:
    """Restaurants of all words over the blocks of some texts, after all sweeps."""

    def __init__(self, docs: DataFrame):
        """docs: key, text, train; texts of the same key are the same."""
        spark = docs.sparkSession
        self.often, tokens = frequent_words(docs)
        self.blocks = min(max(16, tokens // BLOCK), 1 << 16)
        self.wards = min(self.blocks, WARDS)
        # tables by block, so that no sweep shuffles pairs
        folder = written.fresh(spark, "lm-blocks")
        self.name = "lm_" + folder.rsplit("-", 1)[1]
        made = _dealt(docs, self.often, self.blocks).groupBy("block").applyInArrow(_merged, _MERGED)
        made.write.partitionBy("kind").bucketBy(min(self.blocks, 4096), "block").option("path", folder).option("compression", "zstd").saveAsTable(self.name)
        self.table = spark.table(self.name)
        self.pairs = self.table.where("kind = 'pairs'").select("block", "pairs")
        self.totals: list[dict] = []
        self.states: list[DataFrame] = []
        self.sampler: Sampler | None = None
        for k in range(-1, SETTLING + KEPT):
            self._sweep(k)

    def _sweep(self, k: int) -> None:
        known = self.totals[-1] if self.totals else None
        state = self.states[-1] if self.states else self.pairs.sparkSession.createDataFrame([], "block int, ward int, data binary")
        run = _sweep(self.wards, self.often, self.sampler, known, k)
        sent = written.table(self.pairs.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(run, _MESSAGES), "lm-sent")
        replies = written.table(sent.where("ward >= 0").groupBy("ward").applyInArrow(_reply(self.wards, self.sampler, known, k), "block int, ward int, data binary"), "lm-replies")
        self.states.append(replies.where("block >= 0").unionByName(sent.where("ward = -1")))
        sums = np.zeros(5, np.int64)
        parts: dict[int, list[np.ndarray]] = {}
        for row in replies.where("block < 0").collect():
            if row["ward"] < self.wards:
                sums += unpack(row["data"])[0].astype(np.int64)
            else:
                parts[row["ward"]] = [x.astype(float) for x in unpack(row["data"])]
        empty = [np.zeros(CONTEXTS // PARTS)] * 4
        t, rc, n, c = (np.concatenate([parts.get(self.wards + p, empty)[j] for p in range(PARTS)]) for j in range(4))
        rt = (rc > 0).astype(float)
        if self.sampler is None:
            self.tokens, ones, twos = map(int, parts[self.wards][4]) if parts else (0, 0, 0)
            self.words = int(sums[2] + (rc > 0).sum())
            discount = lambda ones, twos: min(max((ones + 0.5) / (ones + 2 * twos + 1), 0.1), 0.95)
            root = discount(int(sums[3] + (rc == 1).sum()), int(sums[4] + (rc == 2).sum()))
            self.sampler = Sampler(self.words, discount(ones, twos), root)
        else:
            rt[: len(self.often)] = self.sampler.seat_root(rc[: len(self.often)], known, self.often, k)
        often = {"t": t, "rc": rc, "rt": rt, "n": n, "c": c}
        self.totals.append({"often": often, "rc": float(sums[0] + rc.sum()), "rt": float(sums[1] + rt.sum())})

    def scores(self) -> DataFrame:
        """key and, summed over the tokens of a text: n, known, log10(c + 1), log10 probability; a row for each row of the texts."""
        states = [s.select("block", "ward", "data", F.lit(k).alias("sweep")) for k, s in enumerate(self.states) if k >= SETTLING]
        run = _scores(self.often, self.sampler, self.totals)
        rows = self.table.where("kind in ('pairs', 'texts')")
        sums = rows.groupBy("block").cogroup(reduce(DataFrame.unionByName, states).groupBy("block")).applyInArrow(run, "slice bigint, keys boolean, data binary")
        keys = self.table.where("kind = 'keys'").select("slice", F.lit(True).alias("keys"), F.col("pairs").alias("data"))
        return sums.unionByName(keys).groupBy("slice").applyInArrow(_summed, "key bigint, n bigint, known bigint, base double, lp double")


def _scores(often: np.ndarray, sampler: Sampler, totals: list[dict]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each slice, texts that have pairs of the block, and the sums over these."""

    def run(rows: pa.Table, state: pa.Table) -> pa.Table:
        rows, state = rows.select(["kind", "slice", "pairs", "docs"]).to_pylist(), state.select(["ward", "data", "sweep"]).to_pylist()
        block = Block(next(row["pairs"] for row in rows if row["kind"] == "pairs"), often)
        n = block.n
        customers = block.by_context(n)
        customers[:CONTEXTS] = totals[0]["often"]["c"]
        mean = np.zeros(len(n))
        own = block.known([row for row in state if row["sweep"] == SETTLING], totals[SETTLING])
        for k in range(SETTLING, SETTLING + KEPT):
            root = sampler.root_estimate(own["rc"], own["rt"], totals[k])
            tables = sampler.seat_pairs(n, own["t"][block.before], root[block.number], block.keys, k)
            own = block.known([row for row in state if row["sweep"] == k + 1], totals[k + 1])
            root = sampler.root_estimate(own["rc"], own["rt"], totals[k + 1])
            there = {"t": own["t"], "c": customers}
            mean += sampler.estimate(block.before, n, tables, block.number, root, there) / KEPT
        occurs = totals[0]["often"]["n"]
        occurs = np.concatenate([occurs, own["n"][CONTEXTS:]])[block.number]
        each = [occurs > 0, np.log10(occurs + 1) * STEPS, -np.log10(mean) * STEPS]
        out = []
        for row in rows:
            if row["kind"] == "texts":
                steps, times = unpack(row["pairs"])
                at = np.repeat(np.cumsum(steps.astype(np.int64)), times.astype(np.int64))
                texts, doc = np.unique(unpack(row["docs"])[0].astype(np.int64), return_inverse=True)
                sums = [np.bincount(doc)] + [np.rint(np.bincount(doc, x[at])).astype(np.int64) for x in each]
                out.append((row["slice"], pack(texts, *sums)))
        to, data = zip(*out)
        return pa.table([pa.array(to, pa.int64()), pa.array([False] * len(to)), pa.array(data, pa.binary())], ["slice", "keys", "data"])

    return run


def _summed(rows: pa.Table) -> pa.Table:
    """Sums of all texts of a slice."""
    rows = rows.select(["keys", "data"]).to_pylist()
    keys = unpack(next(row["data"] for row in rows if row["keys"]))[0]
    parts = list(zip(*[unpack(row["data"]) for row in rows if not row["keys"]]))
    text, *values = (np.concatenate(x).astype(np.int64) for x in parts)
    n, known, base, lp = (np.bincount(text, x, len(keys)) for x in values)
    columns = [signed(keys), n.astype(np.int64), known.astype(np.int64), base / STEPS, -lp / STEPS]
    return pa.table([pa.array(x) for x in columns], ["key", "n", "known", "base", "lp"])


def word_counts(docs: DataFrame) -> DataFrame:
    """A row for each word of docs (text, train): word, contexts (numbers of frequent words, hashes of others), counts (occurrences
    in rows that are `train`, possibly 0)."""
    often, _ = frequent_words(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("pairs").to_pylist():
                block = Block(packed, often)
                every = np.concatenate([often, np.zeros(CONTEXTS - len(often), np.uint64), block.names])
                context = np.where(block.before < CONTEXTS, block.before, signed(every[block.before]))
                yield pa.record_batch([pa.array(signed(every[block.number])), pa.array(context), pa.array(block.n)], ["word", "context", "n"])

    merged = _dealt(docs.withColumn("key", F.lit(0).cast("bigint")), often, 16).where("block >= 0").groupBy("block").applyInArrow(_merged, _MERGED)
    pairs = merged.where("kind = 'pairs'").select("pairs").mapInArrow(run, "word bigint, context bigint, n bigint")
    lists = pairs.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("context", "n"))).alias("x"))
    return lists.select("word", F.col("x.context").alias("contexts"), F.col("x.n").alias("counts"))
def score(docs: DataFrame) -> DataFrame:
    """`doc_id`, `train`, n_tokens, n_known, train_tokens, base_score, score, perplexity of every whole text.

    docs: doc_id, text, train (null: false). Scores are log10 probabilities summed over the words
    and one end; `base_score` is the add-one unigram's. A null text counts as empty: its end is its
    only token. A score hangs on the text alone, so rows that share a doc_id, or have none, are scored each by
    itself. Other columns are not read. Without training tokens all tokens have the same probability in both models.
    """
    named = docs.select("doc_id", F.coalesce("train", F.lit(False)).alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    named = named.withColumn("key", F.xxhash64("text"))
    model = Model(named.select("key", "text", "train"))
    sums = written.table(model.scores(), "lm-sums")
    docs.sparkSession.sql(f"DROP TABLE {model.name}")
    sums = sums.groupBy("key").agg(*[F.max(x).alias(x) for x in ("n", "known", "base", "lp")])
    out = named.select("doc_id", "train", "key").join(sums, "key")
    return out.select(
        "doc_id",
        "train",
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n") * F.log10(F.lit(float(model.tokens + model.words + 1)))).alias("base_score"),
        F.col("lp").alias("score"),
        F.pow(F.lit(10.0), -F.col("lp") / F.col("n")).alias("perplexity"),
    )
