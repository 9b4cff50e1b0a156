"""Benchmark decontamination: SimHash of item-sized windows, found by Hamming blocks, then checked exactly.

Texts are cut into words, in lower case and without signs at their ends. Windows come in a few
sizes. An item is looked for by all its parts of the largest size that it holds, and by all its
parts of a third of its length: of the edits that leave an item similar enough, so few fit in that
some part has none. In a document a window begins at every `STRIDE`-th word; an item's part is
taken at each of `STRIDE` words in a row, so one of them always lines up with a window. The fingerprint of a window is the sign of
its words' summed 64-bit votes. Fingerprints that differ in at most `RADIUS` bits agree in one of
four 16-bit blocks up to RADIUS // 4 bits; an index over the blocks, holding every item under all
block values that near, therefore finds all of them. Each candidate is then compared as a whole:
the weighted Jaccard similarity of the five-word shingles of the item and of a run of the document's
words, as long as the item or cut to where shared shingles begin and end around that place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stores import written
from .texts import SHINGLE_WORDS, Tokens, inverse_powers, mix, slices

STRIDE = 4
#: Words of a window, in multiples of the stride, below 256.
SIZES = (4, 8, 12, 20, 28, 40, 60, 88, 132, 200)
RADIUS = 7
SIMILARITY = 0.8
#: Benchmark items that one pass over the documents looks for; more items take more passes.
ITEMS_A_PASS = 20_000
_BLOCKS = 4


_SIGN = np.array([0x21 <= b < 0x7F and not chr(b).isalnum() for b in range(256)])


def _near(bits: int, radius: int) -> np.ndarray:
    """All masks of `bits` bits with at most `radius` ones."""
    return np.array([sum(1 << b for b in ones) for r in range(radius + 1) for ones in combinations(range(bits), r)], np.int64)


def _votes(hashes: np.ndarray) -> np.ndarray:
    """The bits of each hash, a byte each."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _signs(ones: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints from the counts of ones among `size` votes."""
    return np.packbits(ones > size // 2, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(hashes: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """64-bit SimHash of the `size` words from each of `begins` on."""
    votes = _votes(hashes)
    return np.array([_signs(votes[b : b + size].sum(axis=0, dtype=np.uint8)[None], size)[0] for b in begins.tolist()], np.uint64)


class Steps:
    """Sums of votes over runs of steps; a step is `STRIDE` words from a place that windows may begin at."""

    def __init__(self, hashes: np.ndarray, begins: np.ndarray):
        votes, last = _votes(hashes), len(hashes) - 1
        one = votes[begins]
        for k in range(1, STRIDE):
            one += votes[np.minimum(begins + k, last)]
        self._sums = {1: one}

    def _of(self, steps: int) -> np.ndarray:
        """Sums over `steps` steps; the last `steps` - 1 rows aren't of use."""
        if steps not in self._sums:
            half = 1 << (steps.bit_length() - 1)
            a, b = (steps // 2, steps // 2) if half == steps else (half, steps - half)
            out = self._of(a).copy()
            out[: len(out) - a] += self._of(b)[a:]
            self._sums[steps] = out
        return self._sums[steps]

    def marks(self, rows: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the windows of `size` words that begin at the given steps."""
        return _signs(self._of(size // STRIDE)[rows], size)


def _shingles(words: np.ndarray) -> list[tuple[int, ...]]:
    words = words.tolist()
    return [tuple(words[i : i + SHINGLE_WORDS]) for i in range(len(words) - SHINGLE_WORDS + 1)]


def best_run(item: Counter, size: int, words: np.ndarray, place: int) -> tuple[float, int]:
    """The similarity and first word of the run most like an item among those tried about a place.

    item: its shingles; size: its words. Tried are the run at the place itself, as long as the item, and
    the runs from the first to the last shared shingle in it, and in a quarter more on either side.
    """
    total, slack = sum(item.values()), size // 4 + 2
    low, high = max(place - slack, 0), min(place + size + slack, len(words))
    around = _shingles(words[low:high])
    shared = [low + i for i, s in enumerate(around) if s in item]
    if len(shared) < SIMILARITY * total:
        return 0.0, place
    best = (0.0, place)
    begin, end = max(place, 0), min(place + size, len(words)) - SHINGLE_WORDS + 1
    inside = [i for i in shared if begin <= i < end] or shared
    for a, b in {(begin, end), (inside[0], inside[-1] + 1), (shared[0], shared[-1] + 1), (shared[0], end), (begin, shared[-1] + 1)}:
        if a < b and total * SIMILARITY <= b - a <= total / SIMILARITY:
            run = Counter(around[a - low : b - low])
            both = sum((item & run).values())
            best = max(best, (both / (total + b - a - both), -a))
    return best[0], abs(best[1])


@dataclass
class ItemIndex:
    """Items, and their leading parts by block values."""

    items: list[tuple[int, Counter, int]]
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]

    @classmethod
    def build(cls, ids: list[int], texts: list[str | None]) -> ItemIndex:
        words = Words(pa.array(texts, pa.large_string()))
        items, parts = [], {}
        for k, (i, a, n) in enumerate(zip(ids, words.first.tolist(), words.counts.tolist())):
            hashes = words.hashes[a : a + n]
            items.append((i, Counter(_shingles(hashes)), n))
            if n < SHINGLE_WORDS:
                continue
            fit = [s for s in SIZES if s + STRIDE - 1 <= n] or [SIZES[0]]
            for size in {fit[-1], max([s for s in fit if s <= n // 3], default=fit[0])}:
                # parts end to end, and the last ones; each at a few words in a row
                firsts = {min(o, max(n - size - STRIDE + 1, 0)) for o in range(0, n, size)}
                starts = np.unique([o + d for o in firsts for d in range(STRIDE) if o + d + size <= n])
                for shift, mark in zip(starts.tolist(), fingerprints(hashes, starts, size)):
                    parts.setdefault(size, []).append((k, shift, mark))
        tables = {}
        masks = _near(64 // _BLOCKS, RADIUS // _BLOCKS)
        for size, entries in parts.items():
            item, shift = (np.array([e[c] for e in entries], np.int64) for c in (0, 1))
            mark = np.array([e[2] for e in entries], np.uint64)
            blocks = []
            for b in range(_BLOCKS):
                value = (mark >> np.uint64(16 * b)).astype(np.int64) & 0xFFFF
                near = (value[:, None] ^ masks).ravel()
                order = np.argsort(near, kind="stable")
                begins = np.searchsorted(near[order], np.arange((1 << 16) + 1))
                blocks.append((begins, order // len(masks)))
            tables[size] = (item, shift, mark, blocks)
        return cls(items, tables)

    def candidates(self, size: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows and the items and shifts whose fingerprints lie within the radius; once per agreeing block."""
        item, shift, mark, blocks = self.tables[size]
        windows, entries = [], []
        for b, (begins, order) in enumerate(blocks):
            value = (marks >> np.uint64(16 * b)).astype(np.int64) & 0xFFFF
            n = begins[value + 1] - begins[value]
            window = np.repeat(np.arange(len(marks)), n)
            place = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[value], n)
            entry = order[place]
            close = np.bitwise_count(marks[window] ^ mark[entry]) <= RADIUS
            windows.append(window[close])
            entries.append(entry[close])
        window, entry = np.concatenate(windows), np.concatenate(entries)
        return window, item[entry], shift[entry]

    def find(self, texts: pa.Array) -> list[tuple[int, int, int, float]]:
        """(row, item_id, first word, similarity) of every item found in a text, at its best place."""
        words = Words(texts)
        hashes = words.hashes
        if not len(hashes) or not self.tables:
            return []
        place = np.arange(len(hashes)) - words.first[words.doc]
        left = words.counts[words.doc] - place
        begins = np.flatnonzero(place % STRIDE == 0)
        steps = Steps(hashes, begins)
        seen: set[tuple[int, int, int]] = set()
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for size in self.tables:
            if size == SIZES[0] and any(SHINGLE_WORDS <= n < size + STRIDE - 1 for _, _, n in self.items):
                # items with fewer parts than a stride has words need a window at every word
                places = np.flatnonzero(left >= size)
                marks = Steps(hashes, places).marks(np.arange(len(places)), size)
            else:
                rows = np.flatnonzero(left[begins] >= size)
                places, marks = begins[rows], steps.marks(rows, size) if len(rows) else rows
            if not len(places):
                continue
            window, item, shift = self.candidates(size, marks)
            for w, k, s in zip(places[window].tolist(), item.tolist(), shift.tolist()):
                row = int(words.doc[w])
                first, last = int(words.first[row]), int(words.first[row] + words.counts[row])
                if (row, k, w - s) in seen:
                    continue
                seen.add((row, k, w - s))
                similar, start = best_run(self.items[k][1], self.items[k][2], hashes[first:last], w - s - first)
                if similar >= SIMILARITY:
                    best[(row, k)] = max(best.get((row, k), (0.0, 0)), (similar, -start))
        return [(row, self.items[k][0], -shift, similar) for (row, k), (similar, shift) in sorted(best.items())]


class Words(Tokens):
    """Tokens in lower case, told apart without the signs at their ends."""

    def __init__(self, texts: pa.Array):
        super().__init__(pc.utf8_lower(texts))
        if not len(self.starts):
            return
        data = self.data
        begin, end = self.starts.copy(), self.ends()
        out, power = self._weighed, inverse_powers(len(data))
        total = None
        with np.errstate(over="ignore"):
            for edge, step in ((begin, 1), (end, -1)):
                at = np.flatnonzero(_SIGN[data[edge - (step < 0)]])
                while len(at):
                    at = at[end[at] - begin[at] > 1]
                    if total is None:
                        total = np.add.reduceat(out, self.starts)
                    total[at] -= out[edge[at] - (step < 0)]
                    edge[at] += step
                    at = at[_SIGN[data[edge[at] - (step < 0)]]]
            if total is not None:
                self.hashes = mix(total * power[begin])


def contaminated(docs: DataFrame, benchmark: DataFrame, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """`doc_id`, `item_id`, `start` (first word) and `similarity` of every benchmark item in a document.

    An item occurs if some run of the document's words is at least `SIMILARITY` similar to it;
    its best place is given, the first of equals. Items of fewer than five words can't be told
    from ordinary text and are never found; null texts hold nothing. Items are handled in blocks
    of about `items_a_pass`, one pass over the documents each; with several, the rows of each are written
    before the next begins, so neither a task nor the driver holds more than one block's index.
    Other columns are not read. Repeated documents each give their rows; rows of the benchmark with the same id each count.
    """
    items = benchmark.where("text is not null").select("item_id", "text")
    blocks = max(1, -(-items.count() // items_a_pass))
    placed = items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    texts = docs.select("doc_id", "text")
    found: DataFrame | None = None
    for block in range(blocks):
        rows = placed.where(F.col("_block") == block).orderBy("item_id", "text").collect()
        index = ItemIndex.build([r["item_id"] for r in rows], [r["text"] for r in rows])

        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", 1 << 18):
                    hits = index.find(part.column("text"))
                    at = pa.array([h[0] for h in hits], pa.int64())
                    columns = [pa.array([h[c] for h in hits], kind) for c, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()))]
                    yield pa.record_batch([part.column("doc_id").take(at), *columns], ["doc_id", "item_id", "start", "similarity"])

        one = texts.mapInArrow(run, "doc_id bigint, item_id bigint, start bigint, similarity double")
        if blocks > 1:
            one = written.table(one, "leaks-of-a-block")
        found = one if found is None else found.unionByName(one)
    return found
