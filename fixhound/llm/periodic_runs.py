"""Periodic runs of words, found in a grammar of the text.

Each text's word ids are compressed by Re-Pair: rounds replace the pairs that occur most often, all at
once where they don't touch, until no pair of neighbours occurs twice in the text. Every replacement
is a node of the derivation, and joins its two halves at a boundary. A run lies at the boundary of
the lowest node that holds all of it, or at a boundary of the sequence that is left. So the runs that
cross its boundary are computed once for each rule, inside one place of its expansion, and are
translated to all places where the rule derives text. What a node cuts off is part of a longer
interval of the same period that a higher node finds; intervals inside another of their period go.

A run of exponent 4 covers two periods on one side of any boundary that it crosses. For periods in
(L, 2L], the L words beside the boundary must therefore occur again at that distance, which is looked
up among the repeated blocks of L words; the interval is then extended by hashes of blocks. Most
boundaries of prose have no such block, and prose costs little more than its first round.

Words are told apart by 64-bit hashes. Texts are handled one by one inside a task, so nothing is
shuffled, and a lost task reads its own texts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .texts import Tokens, mix, powers, slices, utf8

#: A run has at least this many words and repeats its period at least so often.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Periods up to this one are compared word by word at each boundary; longer ones are looked up.
_SHORT = 4
#: Periods tried at a time, which bounds the memory of very repetitive texts.
_CHUNK = 1 << 18

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Grammar:
    """Re-Pair over the texts of a slice, whose symbols differ between texts.

    rule: number of the rule that each node applies; start, left, size: the node's first word, and the
    words of its left half and of all of it; first: a node of each rule; joined: for each word, whether a
    node joins it to the one before.
    """

    def __init__(self, symbols: np.ndarray, doc: np.ndarray):
        self.joined = np.zeros(len(symbols) + 1, bool)
        keys, starts, lefts, sizes = [], [], [], []
        symbol, start, size = symbols, np.arange(len(symbols)), np.ones(len(symbols), np.int64)
        # whether a pair that begins here could occur twice; once it can't, it never will
        open_ = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.zeros(0, bool)
        while open_.any():
            # symbols that stand in no such pair can't take part any more
            near = open_.copy()
            near[1:] |= open_[:-1]
            symbol, start, size, open_ = symbol[near], start[near], size[near], open_[near]
            at = np.flatnonzero(open_)
            same = symbol[at] == symbol[at + 1]
            # of equal symbols in a row, every second pair overlaps the one before
            follows = np.zeros(len(at), bool)
            follows[1:] = same[1:] & same[:-1] & (at[1:] == at[:-1] + 1)
            order = np.arange(len(at))
            row = order - np.maximum.accumulate(np.where(follows, 0, order))
            used = (row & 1) == 0
            at = at[used]
            with np.errstate(over="ignore"):
                key = mix(symbol[at] * np.uint64(0x9E3779B97F4A7C15) + mix(symbol[at + 1]))
            count = _counts(key)
            open_[at[count < 2]] = False
            rank = np.zeros(len(symbol) + 1, np.uint64)
            rank[at] = np.where(count < 2, 0, (count.astype(np.uint64) << np.uint64(32)) | (key >> np.uint64(32)))
            mine = rank[at]
            chosen = (mine > 0) & (mine > np.where(at > 0, rank[at - 1], 0)) & (mine >= rank[at + 1])
            key, at = key[chosen], at[chosen]
            keys.append(key)
            starts.append(start[at])
            lefts.append(size[at])
            size[at] += size[at + 1]
            sizes.append(size[at])
            self.joined[starts[-1] + lefts[-1]] = True
            symbol[at] = key
            open_[at] = open_[at + 1]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            symbol, start, size, open_ = symbol[stay], start[stay], size[stay], open_[stay]
        none = np.zeros(0, np.int64)
        key = np.concatenate(keys or [np.zeros(0, np.uint64)])
        _, self.first, self.rule = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.left, self.size = (np.concatenate(x or [none]) for x in (starts, lefts, sizes))


def _counts(key: np.ndarray) -> np.ndarray:
    """How often each key occurs, at the key's place."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    begins = np.flatnonzero(new)
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(np.diff(np.append(begins, len(key))), np.diff(np.append(begins, len(key))))
    return out


class Blocks:
    """Equality of blocks of words at any place and of any length."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up, self._down = powers(n + 1)
        with np.errstate(over="ignore"):
            self._sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * up[:n], dtype=np.uint64)])

    def of(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._sum[at + size] - self._sum[at]) * self._down[at])

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.of(a, size) == self.of(b, size)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, backwards: bool = False) -> np.ndarray:
        """Length of the longest equal blocks that begin, or end, at these places; `most` at the utmost."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            shift = middle if backwards else 0
            same = self.equal(a - shift, b - shift, middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low


def _repeated(blocks: Blocks, at: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of blocks of this size that occur twice, ordered by block and place, and each one's block."""
    at = at[at + size <= end[at]]
    key = blocks.of(at, size)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    again = ~new
    again[:-1] |= ~new[1:]
    return at[again], np.cumsum(new)[again]


def _crossing(blocks: Blocks, doc_end: np.ndarray, pairs: np.ndarray, middle: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs inside [low, high) that hold the words on both sides of `middle`: index, start, end, period.

    pairs: where pairs of words begin that occur again in their text. The period of a run may be a multiple of its least one.
    """
    n = len(doc_end)
    found = []

    def take(which: np.ndarray, period: np.ndarray, right: bool) -> None:
        """Keep the runs of those boundaries beside which two periods are equal."""
        for k in range(0, len(which), _CHUNK):
            i, q = which[k : k + _CHUNK], period[k : k + _CHUNK]
            m = middle[i]
            inside = m + 2 * q <= high[i] if right else m - 2 * q >= low[i]
            i, q, m = i[inside], q[inside], m[inside]
            a = m if right else m - 2 * q
            same = blocks.equal(a, a + q, q)
            i, q, a = i[same], q[same], a[same]
            after = blocks.common(a + q, a + 2 * q, high[i] - a - 2 * q)
            before = blocks.common(a, a + q, a - low[i], backwards=True)
            start, end = a - before, a + 2 * q + after
            enough = (end - start >= np.maximum(MIN_WORDS, MIN_PERIODS * q)) & (start < middle[i]) & (end > middle[i])
            found.append((i[enough], start[enough], end[enough], q[enough]))

    every = np.arange(len(middle))
    for q in range(1, _SHORT + 1):
        for right in (True, False):
            take(every, np.full(len(every), q), right)
    at, size = pairs, _SHORT
    while len(at) and len(middle):
        at, block = _repeated(blocks, at, doc_end, size)
        if not len(at):
            break
        place = np.full(n, -1)
        place[at] = np.arange(len(at))
        # within a block the places ascend, so block and place together ascend throughout
        both = block * (n + 1) + at
        for right in (True, False):
            begins = middle if right else middle - size
            ok = (begins >= low) & (begins + size <= high)
            which = np.flatnonzero(ok)
            which = which[place[begins[which]] >= 0]
            own = block[place[begins[which]]] * (n + 1)
            near, far = (size + 1, 2 * size) if right else (-2 * size, -size - 1)
            first = np.searchsorted(both, own + np.maximum(begins[which] + near, 0), "left")
            last = np.searchsorted(both, own + np.clip(begins[which] + far, -1, n), "right")
            for k in range(0, len(which), _CHUNK):
                a, b, w = first[k : k + _CHUNK], last[k : k + _CHUNK], which[k : k + _CHUNK]
                some = b > a
                a, b, w = a[some], b[some], w[some]
                _in_pieces(a, b, w, lambda i, j: take(i, np.abs(at[j] - begins[i]), right))
        size *= 2
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _in_pieces(first: np.ndarray, last: np.ndarray, which: np.ndarray, use) -> None:
    """`use(which, j)` for all j in [first, last), about _CHUNK of them at a time."""
    total = np.cumsum(last - first)
    k = 0
    while k < len(which):
        done = total[k - 1] if k else 0
        end = max(k + 1, int(np.searchsorted(total, done + _CHUNK, "right")))
        sizes = (last - first)[k:end]
        i = np.repeat(which[k:end], sizes)
        j = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[k:end], sizes)
        use(i, j)
        k = end


def _maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without intervals inside another one of their period, and with the least period of each interval."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    if len(start):
        reach = np.unique(period, return_inverse=True)[1] * (int(end.max()) + 1) + end
        before = np.concatenate([[-1], np.maximum.accumulate(reach)[:-1]])
        keep = reach > before
        start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def runs_of(hashes: np.ndarray, doc: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and least period of all runs, ordered by start and period.

    hashes, doc: of each word of several texts in a row; offsets: where each text begins and ends.
    """
    none = np.zeros(0, np.int64)
    if not len(hashes):
        return none, none, none
    with np.errstate(over="ignore"):
        hashes = mix(hashes + mix(doc.astype(np.uint64) + np.uint64(1)))
    grammar = Grammar(hashes, doc)
    blocks = Blocks(hashes)
    doc_end = offsets[1:][doc]
    # boundaries of the rules, each inside one place of its expansion
    node = grammar.first
    middle, low = grammar.start[node] + grammar.left[node], grammar.start[node]
    high = low + grammar.size[node]
    # boundaries that are left, inside the text; the words beside one occur together elsewhere, if it is in a run
    pairs, _ = _repeated(blocks, np.arange(len(hashes)), doc_end, 2)
    rest = np.sort(pairs + 1)
    rest = rest[~grammar.joined[rest]]
    rules = len(node)
    i, start, end, period = _crossing(
        blocks,
        doc_end,
        pairs,
        np.concatenate([middle, rest]),
        np.concatenate([low, offsets[:-1][doc[rest]]]),
        np.concatenate([high, doc_end[rest]]),
    )
    derived = i < rules
    out = [(start[~derived], end[~derived], period[~derived])]
    i, start, end, period = i[derived], start[derived], end[derived], period[derived]
    if len(i):
        # all nodes of each rule, by rule
        order = np.argsort(grammar.rule, kind="stable")
        first = np.searchsorted(grammar.rule[order], np.arange(rules + 1))

        def place(run: np.ndarray, nth: np.ndarray) -> None:
            shift = grammar.start[order[nth]] - grammar.start[node[i[run]]]
            out.append((start[run] + shift, end[run] + shift, period[run]))

        _in_pieces(first[i], first[i + 1], np.arange(len(i)), place)
    start, end, period = _maximal(*(np.concatenate(x) for x in zip(*out)))
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _kept(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words no run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:n]) == 0


def detect(docs: DataFrame) -> DataFrame:
    """All periodic runs of every text of `docs` (doc_id, text).

    Returns doc_id, n_words, runs (start word, length and least period in words, ordered by start and
    period) and collapsed: the words that no run holds after its first period, joined by one space. A run
    is a stretch of at least 6 words and 4 periods that can't be made longer on either side.

    Words are what stands between `[\\x20\\x09-\\x0D]`, in their own case. A null or empty text has no
    words, no runs and an empty collapsed text. Rows are independent: repeated rows, and rows with the
    same id or none, each give their own. Other columns of `docs` are not read. Memory grows with the
    longest text, not with their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tokens = Tokens(part.column("text"), fold_case=False)
                offsets = np.append(tokens.first, len(tokens.hashes))
                start, end, period = runs_of(tokens.hashes, tokens.doc, offsets)
                data, ends = utf8(part.column("text"))
                raw = data.tobytes()
                kept = _kept(len(tokens.hashes), start, end, period)
                begins = np.searchsorted(start, offsets)
                collapsed = []
                for k in range(part.num_rows):
                    words = raw[ends[k] : ends[k + 1]].split()
                    if begins[k] < begins[k + 1]:
                        words = [words[i] for i in np.flatnonzero(kept[offsets[k] : offsets[k + 1]])]
                    collapsed.append(b" ".join(words))
                local = start - offsets[np.searchsorted(offsets, start, "right") - 1]
                items = pa.StructArray.from_arrays([pa.array(x) for x in (local, end - start, period)], ["start", "length", "period"])
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array(tokens.counts.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(begins, pa.int32()), items),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")
