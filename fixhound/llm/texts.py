"""Helpers that the operators share: texts in Arrow batches as arrays of token hashes.

A token is a run of bytes other than `[\\x20\\x09-\\x0D]`. Tokens are told apart by a 64-bit
polynomial hash over their UTF-8 bytes; everything works on whole texts, many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5

_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _byte_values(fold_case: bool) -> np.ndarray:
    values = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
    values[_SPACE] = 0
    if fold_case:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


_ALL_VALUES = np.random.default_rng(21).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_VALUES = {fold: _byte_values(fold) for fold in (False, True)}


def _power(name: str, base: np.uint64, size: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < size:
        with np.errstate(over="ignore"):
            steps = np.full(max(size, 1 << 20), base, np.uint64)
            steps[0] = 1
            known = np.multiply.accumulate(steps)
        if size <= 1 << 23:
            _powers[name] = known
    return known


def inverse_powers(size: int) -> np.ndarray:
    """What a sum of weighed bytes is multiplied by, to make it the hash of a word that begins there."""
    return _power("inverse", _INVERSE, size)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0, 1, ... of the radix of the hashes, and of its inverse."""
    return _power("radix", _RADIX, size)[:size], _power("inverse", _INVERSE, size)[:size]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit over all others."""
    out = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        out ^= out >> np.uint64(33)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(33)
        out *= np.uint64(0xC4CEB9FE1A85EC53)
        out ^= out >> np.uint64(33)
    return out


def byte_hashes(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes; a run ends where the next begins."""
    n = len(data)
    with np.errstate(over="ignore"):
        weighed = _ALL_VALUES[data] * _power("radix", _RADIX, n)[:n]
        return mix(np.add.reduceat(weighed, begins) * _power("inverse", _INVERSE, n)[begins])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text begins and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(column) else (data[:0], np.zeros(1, np.int64))


def slices(batch: pa.RecordBatch, text: str = "text", max_bytes: int = 1 << 20, max_rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `max_bytes` of text and of `max_rows` rows, one row at least each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    filled, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        done = filled[begin - 1] if begin else 0
        end = max(begin + 1, min(begin + max_rows, int(np.searchsorted(filled, done + max_bytes, "right"))))
        yield batch.slice(begin, end - begin)
        begin = end


class Tokens:
    """The tokens of a batch of texts.

    starts: first byte of each token; doc: its row; counts: tokens of each row;
    first: index of each row's first token; hashes: unsigned 64-bit.
    """

    def __init__(self, column: pa.Array, fold_case: bool = True):
        self.data, self.offsets = utf8(column)
        data, n = self.data, len(self.data)
        solid = ~_SPACE[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        inner = self.offsets[:-1][self.offsets[:-1] < n]
        begins[inner] = solid[inner]
        self.starts = np.flatnonzero(begins)
        bounds = np.searchsorted(self.starts, self.offsets)
        self.first, self.counts = bounds[:-1], np.diff(bounds)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        with np.errstate(over="ignore"):
            if len(self.starts):
                weighed = _VALUES[fold_case][data] * _power("radix", _RADIX, n)[:n]
                self._weighed = weighed
                self.hashes = mix(np.add.reduceat(weighed, self.starts) * _power("inverse", _INVERSE, n)[self.starts])
            else:
                self.hashes = np.zeros(0, np.uint64)
        self._solid = solid

    def ends(self) -> np.ndarray:
        """One past the last byte of each token."""
        last = self._solid.copy()
        last[:-1] &= ~self._solid[1:]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(self.data))] - 1
        last[cut] = self._solid[cut]
        return np.flatnonzero(last) + 1

    def folded(self, at: np.ndarray) -> np.ndarray:
        """The bytes at these places, A to Z in lower case."""
        byte = self.data[at]
        return byte + np.where((byte >= 0x41) & (byte < 0x5B), np.uint8(0x20), np.uint8(0))

    def beginnings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first `size` bytes of the tokens that are longer, and which these are."""
        where = np.flatnonzero(self.ends() - self.starts > size) if len(self.starts) else np.zeros(0, np.int64)
        if not len(where):
            return np.zeros(0, np.uint64), where
        at = self.starts[where]
        with np.errstate(over="ignore"):
            total = self._weighed[at].copy()
            for k in range(1, size):
                total += self._weighed[at + k]
            return mix(total * _power("inverse", _INVERSE, len(self.data))[at]), where

    def shingles(self, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """Hash and row of every run of `words` tokens; a shorter text with a token has one run, all of it."""
        n = len(self.hashes)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        place = np.arange(n) - self.first[self.doc]
        left = self.counts[self.doc] - place
        keep = (left >= words) | (place == 0)
        at = np.flatnonzero(keep)
        out = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(words):
                there = left[at] > k
                out *= np.uint64(0x2545F4914F6CDD1D)
                out += np.where(there, self.hashes[np.minimum(at + k, n - 1)], np.uint64(k + 1))
        return mix(out), self.doc[at]


def hash_text(text: str, fold_case: bool = True) -> np.ndarray:
    """Token hashes of one text."""
    return Tokens(pa.array([text], pa.large_string()), fold_case).hashes


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
