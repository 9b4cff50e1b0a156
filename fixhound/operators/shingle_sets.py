"""Sets of word shingles in Arrow batches, as sorted 64-bit hashes of whole texts, and columns that are made of them.

A word is a run of bytes other than `[\\x20\\x09-\\x0D]`, as `\\s+` splits them; the words of a text come in lower
case. Words are told apart by a polynomial hash over their bytes, shingles by a hash of their words' hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fixhound.functions.grams import SHINGLE_WORDS

#: Bytes of text, and hashes, that are worked on at once.
TEXT_BYTES, HASHES = 1 << 20, 1 << 22
_RADIX = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_VALUES[_SPACE] = 0
_powers: list[tuple[np.ndarray, np.ndarray]] = []


class Sets(NamedTuple):
    """Rows without their text; the set of row k is `hashes[offsets[k] : offsets[k + 1]]`, in order and each once."""

    rows: pa.RecordBatch
    offsets: np.ndarray
    hashes: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def lists(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(self.offsets.astype(np.int32)), pa.array(self.hashes))


def _steps(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _powers_to(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0, 1, ... of the radix and of its inverse; those of a usual piece are kept."""
    if size > TEXT_BYTES:
        return _steps(_RADIX, size), _steps(pow(_RADIX, -1, 1 << 64), size)
    if not _powers:
        _powers.append((_steps(_RADIX, TEXT_BYTES), _steps(pow(_RADIX, -1, 1 << 64), TEXT_BYTES)))
    return _powers[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and which is the first one of each text, with their number at the end."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets, n = offsets - offsets[0], len(data)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    begins[heads] = solid[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    power, inverse = _powers_to(n)
    sums = np.add.reduceat(_VALUES[data] * power[:n], starts)
    return _mixed(sums * inverse[starts]), np.searchsorted(starts, offsets)


def _in_order(rows: pa.RecordBatch, offsets: np.ndarray, hashes: np.ndarray) -> Sets:
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        hashes[begin:end].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(hashes)]] = True
    before = np.concatenate([[0], np.cumsum(fresh)])
    return Sets(rows, before[offsets], hashes[fresh])


def _of_texts(rows: pa.RecordBatch, texts: pa.Array) -> Sets:
    with np.errstate(over="ignore"):
        words, first = _word_hashes(texts)
        counts = np.diff(first)
        left = np.repeat(first[1:], counts) - np.arange(len(words))
        at = np.flatnonzero(left >= SHINGLE_WORDS)
        hashes = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE_WORDS):
            hashes = hashes * np.uint64(0x2545F4914F6CDD1D) + words[at + k]
        hashes = _mixed(hashes).view(np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.maximum(counts - (SHINGLE_WORDS - 1), 0))])
    return _in_order(rows, offsets, hashes)


def _pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Rows in runs of about `most` in size, one row at least each."""
    filled, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        done = filled[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(filled, done + most, "right")))
        yield begin, end
        begin = end


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Sets]:
    """Sets of rows with a `content` in lower case and not null, or with hashes in `shingles`."""
    for batch in batches:
        given = "content" not in batch.schema.names
        name = "shingles" if given else "content"
        column = batch.column(name)
        others = pa.RecordBatch.from_arrays(
            [c for c, x in zip(batch.columns, batch.schema.names) if x != name], [x for x in batch.schema.names if x != name]
        )
        sizes = (pc.list_value_length(column) if given else pc.binary_length(column)).to_numpy(zero_copy_only=False)
        for begin, end in _pieces(sizes, HASHES if given else TEXT_BYTES):
            rows, part = others.slice(begin, end - begin), column.slice(begin, end - begin)
            if given:
                offsets = np.concatenate([[0], np.cumsum(sizes[begin:end])]).astype(np.int64)
                yield _in_order(rows, offsets, part.flatten().to_numpy(zero_copy_only=False).copy())
            else:
                yield _of_texts(rows, part)


def with_columns(made: dict[str, Callable[[Sets], pa.Array]]):
    """For `mapInArrow`: the rows with columns made of their sets in place of texts or shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in sets_of(batches):
            columns = [*sets.rows.columns, *[f(sets) for f in made.values()]]
            yield pa.RecordBatch.from_arrays(columns, [*sets.rows.schema.names, *made])

    return run


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For `mapInArrow`: `shingle` and `n` of those in more than one of some thousand texts that come together."""
    held: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        values = np.sort(np.concatenate(held))
        held.clear()
        begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        times = np.diff(np.append(begins, len(values)))
        twice = times > 1
        return pa.RecordBatch.from_arrays([pa.array(values[begins[twice]]), pa.array(times[twice].astype(np.int64))], ["shingle", "n"])

    for sets in sets_of(batches):
        if len(sets.hashes):
            held.append(sets.hashes)
        if sum(map(len, held)) >= HASHES:
            yield counted()
    if held:
        yield counted()


def leads(common, min_jaccard: float) -> Callable[[Sets], pa.Array]:
    """The hashes of a set that may be the first one in common with a similar set, in an order that holds for all sets.

    Hashes that aren't in `common` come first, these by number, and the smaller one before the larger. `common` is a
    broadcast pair of arrays, hashes in order and their numbers; whatever it holds, no similar set is missed.
    """
    bits = np.int64((1 << 22) - 1)
    seen: list[np.ndarray] = []

    def made(sets: Sets) -> pa.Array:
        known, numbers = common.value
        if not seen:
            seen.append(np.zeros(int(bits) + 1, bool))
            seen[0][known & bits] = True
        n, hashes = sets.sizes(), sets.hashes
        most = np.minimum(n, n - np.ceil(min_jaccard * n - 1e-9).astype(np.int64) + 1)
        row = np.repeat(np.arange(len(n)), n)
        number = np.zeros(len(hashes), np.uint16)
        at = np.flatnonzero(seen[0][hashes & bits])
        if len(known):
            found = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
            hit = known[found] == hashes[at]
            number[at[hit]] = numbers[found[hit]]
        rare = number == 0
        before = np.concatenate([[0], np.cumsum(rare)])
        rares = before[sets.offsets[1:]] - before[sets.offsets[:-1]]
        place = before[:-1] - np.repeat(before[sets.offsets[:-1]], n)
        others = np.flatnonzero(~rare & np.repeat(rares < most, n))
        others = others[np.lexsort((number[others], row[others]))]
        begins = np.searchsorted(row[others], np.arange(len(n)))
        place[others] = rares[row[others]] + np.arange(len(others)) - begins[row[others]]
        kept = rare.copy()
        kept[others] = True
        kept &= place < np.repeat(most, n)
        ends = np.concatenate([[0], np.cumsum(most)])
        lead = np.empty(ends[-1], np.int64)
        lead[ends[row[kept]] + place[kept]] = hashes[kept]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(lead))

    return made


def parities(sets: Sets) -> pa.Array:
    """For each bit, whether an odd number of hashes end in its number; as many bits as hashes or up to twice as many."""
    n = sets.sizes()
    bits = np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1)))).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(ends[:-1], n) + (sets.hashes & np.repeat(bits - 1, n))
    odd = (np.bincount(at, minlength=ends[-1]) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array((ends >> 6).astype(np.int32)), pa.array(np.packbits(odd, bitorder="little").view(np.int64)))


def sent_to(pairs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For `mapInArrow`: `doc, one, shingles`, a row for each of the broadcast pairs, which are in order of `doc`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, ones = pairs.value
        for sets in sets_of(_filtered(batches, docs)):
            doc = sets.rows.column("doc").to_numpy()
            begin = np.searchsorted(docs, doc, "left")
            times = np.searchsorted(docs, doc, "right") - begin
            row = np.repeat(np.arange(len(doc)), times)
            one = ones[begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)]
            lists = sets.lists()
            for low, high in _pieces(sets.sizes()[row], HASHES):
                some = pa.array(row[low:high])
                yield pa.RecordBatch.from_arrays([pa.array(doc[row[low:high]]), pa.array(one[low:high]), lists.take(some)], ["doc", "one", "shingles"])

    return run


def held_by(docs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For `mapInArrow`: `one, held`, the shingles of the broadcast documents, which are in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in sets_of(_filtered(batches, docs.value)):
            yield pa.RecordBatch.from_arrays([sets.rows.column("doc"), sets.lists()], ["one", "held"])

    return run


def _filtered(batches: Iterator[pa.RecordBatch], docs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc = batch.column("doc").to_numpy()
        at = np.minimum(np.searchsorted(docs, doc), max(len(docs) - 1, 0))
        yield batch.filter(pa.array(docs[at] == doc if len(docs) else np.zeros(len(doc), bool)))
