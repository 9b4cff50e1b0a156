"""Cutting texts into the pieces that a byte-level tokenizer encodes one by one, many texts at once,
and remembering the ids of every piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex

from .texts import byte_hashes, signed, utf8

#: Fixed value: the split pattern of byte-level tokenizers of this family. `cut` follows it.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: Pieces remembered by one Python worker; beyond it the memory is emptied. Results don't depend on it.
REMEMBERED = 2_000_000
_classes: list[np.ndarray] = []


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _class_of() -> np.ndarray:
    """What the pattern takes each code point for."""
    if not _classes:
        table = np.full(0x110000, _OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
            found = "".join(regex.findall(pattern + "+", every))
            table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
        _classes.append(table)
    return _classes[0]


def cut(data: np.ndarray, offsets: np.ndarray, special: Iterable[bytes] = ()) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every piece, and the places among them of special tokens written out.

    data, offsets: UTF-8 of texts in a row and their bounds.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = data.tobytes()
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    point = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
    kind, n = _class_of()[point], len(point)
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(lead, offsets)] = True
    edge[n] = True
    whole = []
    bounds = None
    for token in special:
        at = raw.find(token)
        while at >= 0:
            bounds = set(offsets.tolist()) if bounds is None else bounds
            if not any(at < b < at + len(token) for b in bounds.intersection(range(at + 1, at + len(token)))):
                a, b = np.searchsorted(lead, (at, at + len(token)))
                edge[[a, b]] = True
                whole.append((a, b))
                at += len(token) - 1
            at = raw.find(token, at + 1)
    start = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= edge[:n]
    space = kind == _SPACE
    last = space & ~edge[1:]
    last[:-1] &= ~space[1:]
    at = np.flatnonzero(last)
    start[at] = True
    start[at[point[at] == 0x20] + 1] = False
    quote = np.flatnonzero(start[:-1] & (point[:-1] == 0x27) & ~edge[1:n])
    if len(quote):
        one, two = point[quote + 1], point[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n)]
        pair &= ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        begun = quote[short | pair]
        start[begun + 1] = False
        end = begun + np.where(short, 2, 3)[short | pair]
        start[end[end < n]] = True
    for a, b in whole:
        start[a + 1 : b] = False
    begins = lead[start]
    return begins, np.searchsorted(begins, lead[[a for a, _ in whole]]) if whole else np.zeros(0, np.int64)


def gather(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs pool[begins[i] : begins[i] + sizes[i]], one after another."""
    ends = np.cumsum(sizes)
    shift = np.repeat(begins - (ends - sizes), sizes)
    shift += np.arange(len(shift))
    return pool[shift]


class PieceMemory:
    """Values of pieces by the hash of their bytes, each value computed once while it is remembered.

    compute: gets the bytes, the bounds of new pieces and returns all their values in a row and the
    number of each piece's values.
    """

    def __init__(self, compute: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], kind: type, remembered: int = REMEMBERED):
        self._compute, self._kind, self._most = compute, kind, remembered
        self._empty()

    def _empty(self) -> None:
        self._hashes, self._begins, self._sizes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self._pool = np.zeros(0, self._kind)

    def values(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the pieces that begin at `begins` (each ends where the next begins), and how many each has."""
        if not len(begins):
            return np.zeros(0, self._kind), np.zeros(0, np.int32)
        hashes = signed(byte_hashes(data, begins))
        unique, first, code = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self._hashes, unique)
        known = np.zeros(len(unique), bool) if not len(self._hashes) else self._hashes[np.minimum(at, len(self._hashes) - 1)] == unique
        new = np.flatnonzero(~known)
        if len(new):
            if len(self._hashes) + len(new) > self._most and len(self._hashes):
                self._empty()
                return self.values(data, begins)
            ends = np.append(begins[1:], len(data))
            made, sizes = self._compute(data, begins[first[new]], ends[first[new]])
            filled = len(self._pool) + np.cumsum(sizes) - sizes
            self._pool = np.concatenate([self._pool, made.astype(self._kind, copy=False)])
            self._hashes = np.insert(self._hashes, at[new], unique[new])
            self._begins = np.insert(self._begins, at[new], filled)
            self._sizes = np.insert(self._sizes, at[new], sizes)
            at = np.searchsorted(self._hashes, unique)
        sizes = self._sizes[at][code]
        return gather(self._pool, self._begins[at][code], sizes), sizes


class Encoder:
    """Ids of texts, through a memory of pieces."""

    def __init__(self, compute: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], special: dict[str, int], kind: type = np.uint32):
        self.memory = PieceMemory(compute, kind)
        self._special = {token.encode(): i for token, i in special.items()}
        self._ids = sorted(self._special.items(), key=lambda x: -len(x[0]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin and end."""
        data, offsets = utf8(texts)
        begins, special = cut(data, offsets, [token for token, _ in self._ids])
        ids, sizes = self.memory.values(data, begins)
        filled = np.concatenate([[0], np.cumsum(sizes)])
        if len(special):
            keep = np.ones(len(ids), bool)
            for k in special.tolist():
                a, b = filled[k], filled[k + 1]
                stop = begins[k + 1] if k + 1 < len(begins) else len(data)
                ids[a] = self._special[data[begins[k] : stop].tobytes()]
                keep[a + 1 : b] = False
            sizes = sizes.copy()
            sizes[special] = 1
            ids, filled = ids[keep], np.concatenate([[0], np.cumsum(sizes)])
        return ids, filled[np.searchsorted(begins, offsets)]
