"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Leaf i of a part's tree holds the rank of the pair that begins at symbol i, together with i; an
inner node holds the smaller of its two children. So the root is the lowest-ranked pair, the
leftmost of equals. A merge changes three leaves (the merged pair, the one before it and the one
swallowed) and the nodes above them: logarithmic in the length of the part. It ends when the
root says that no pair can merge. Short parts are merged many at a time, one tree per row of a
matrix; long ones one by one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Encoder, default_path, gather
from .texts import slices

_NONE = np.int64(1 << 62)
_WIDEST = 64


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabularies of this kind."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer") or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space is read")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self._byte_id = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self._byte_id[byte] = vocab[letter]
        self._size = max(self.bytes_of) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self._made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self._size + right
        self._rank_of = dict(zip(keys.tolist(), range(len(pairs)), strict=True))
        self._order = np.argsort(keys)
        self._keys = keys[self._order]
        self._vocab_pool = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(self._size)), np.uint8)
        self._vocab_size = np.array([len(self.bytes_of.get(i, b"")) for i in range(self._size)])
        self._vocab_begin = np.cumsum(self._vocab_size) - self._vocab_size
        self._encoder = Encoder(self._merge_pieces, self.special)

    # ---- merging

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a number beyond all ranks."""
        keys = left * self._size + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._order[at], _NONE)

    def merge_rows(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of at most `width` bytes (a power of two), all merged side by side, and how many each has."""
        n = len(begins)
        ids = np.full((n, width), -1, np.int64)
        inside = np.arange(width) < sizes[:, None]
        ids[inside] = self._byte_id[gather(data, begins, sizes)]
        after = np.where(np.arange(width) + 1 < sizes[:, None], np.arange(width) + 1, width)
        before = np.tile(np.arange(width) - 1, (n, 1))
        leaves = np.full((n, width), _NONE)
        pair = after < width
        rank = self._ranks(ids[:, :-1][pair[:, :-1]], ids[:, 1:][pair[:, :-1]])
        place = np.nonzero(pair)[1]
        leaves[pair] = np.where(rank < _NONE, rank * width + place, _NONE)
        tree = [leaves]
        while tree[-1].shape[1] > 1:
            tree.append(np.minimum(tree[-1][:, ::2], tree[-1][:, 1::2]))

        def renew(row: np.ndarray, at: np.ndarray) -> None:
            for below, level in zip(tree, tree[1:]):
                at = at >> 1
                level[row, at] = np.minimum(below[row, 2 * at], below[row, 2 * at + 1])

        def put(row: np.ndarray, at: np.ndarray, other: np.ndarray) -> None:
            """The pair that begins at `at` and goes on at `other` (there is none at `width`)."""
            there = other < width
            rank = np.full(len(row), _NONE)
            rank[there] = self._ranks(ids[row[there], at[there]], ids[row[there], other[there]])
            leaves[row, at] = np.where(rank < _NONE, rank * width + at, _NONE)
            renew(row, at)

        row = np.flatnonzero(tree[-1][:, 0] < _NONE)
        while len(row):
            best = tree[-1][row, 0]
            at = best % width
            gone = after[row, at]
            then = after[row, gone]
            ids[row, at] = self._made[best // width]
            ids[row, gone] = -1
            after[row, at] = then
            more = then < width
            before[row[more], then[more]] = at[more]
            leaves[row, gone] = _NONE
            renew(row, gone)
            put(row, at, then)
            prior = before[row, at]
            has = prior >= 0
            put(row[has], prior[has], at[has])
            row = row[tree[-1][row, 0] < _NONE]
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def merge_one(self, piece: np.ndarray) -> np.ndarray:
        """Ids of one long piece."""
        n = len(piece)
        width = 1 << max(n - 1, 1).bit_length()
        ids = self._byte_id[piece].tolist()
        none, rank_of, size, made = int(_NONE), self._rank_of, self._size, self._made
        after, before = [*range(1, n), width], [*range(-1, n - 1)]
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = rank_of.get(ids[i] * size + ids[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                least = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == least:
                    break
                tree[i] = least

        def pair(i: int, j: int) -> int:
            rank = rank_of.get(ids[i] * size + ids[j]) if j < width else None
            return none if rank is None else rank * width + i

        while tree[1] < none:
            at, rank = tree[1] % width, tree[1] // width
            gone = after[at]
            then = after[gone]
            ids[at], ids[gone] = int(made[rank]), -1
            after[at] = then
            if then < width:
                before[then] = at
            put(gone, none)
            put(at, pair(at, then))
            if before[at] >= 0:
                put(before[at], pair(before[at], at))
        return np.array([i for i in ids if i >= 0], np.int64)

    # ---- texts

    def _merge_pieces(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = ends - begins
        widths = 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)
        made, order, counts = [], [], []
        for width in np.unique(widths).tolist():
            group = np.flatnonzero(widths == width)
            if width <= _WIDEST:
                ids, count = self.merge_rows(data, begins[group], sizes[group], width)
            else:
                each = [self.merge_one(data[begins[g] : ends[g]]) for g in group.tolist()]
                ids, count = np.concatenate(each), np.array([len(e) for e in each])
            made.append(ids)
            order.append(group)
            counts.append(count)
        ids, order, counts = np.concatenate(made), np.concatenate(order), np.concatenate(counts)
        filled = np.cumsum(counts) - counts
        back = np.argsort(order)
        return gather(ids, filled[back], counts[back]), counts[back]

    # ---- texts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (null is empty), and where each text's begin and end."""
        return self._encoder.encode(texts)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 of the text of each run of ids; what is no UTF-8 becomes U+FFFD."""
        sizes = self._vocab_size[ids]
        raw = gather(self._vocab_pool, self._vocab_begin[ids], sizes).tobytes()
        filled = np.concatenate([[0], np.cumsum(sizes)])[bounds].tolist()
        texts = [raw[a:b] for a, b in zip(filled, filled[1:])]
        try:
            for text in texts:
                text.decode()
        except UnicodeDecodeError:
            texts = [text.decode("utf-8", "replace").encode() for text in texts]
        return texts


_coders: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    """The coder of a file, made once in each Python worker."""
    if path not in _coders:
        _coders[path] = ByteBpe(path)
    return _coders[path]


def _runs(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    raw, ends = ids.astype("<u4", copy=False).tobytes(), (bounds * 4).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def encode_decode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """Each text's ids and what they decode to: id column, `ids` (binary, little-endian unsigned
    32-bit), `n_tokens`, `decoded`.

    A null text counts as empty; an empty text has no ids and decodes to an empty text. Special
    tokens written out in a text become their ids. Repeated rows each give a row.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = bpe.encode(part.column("text"))
                decoded = [text.decode() for text in bpe.decode(ids, bounds)]
                yield pa.record_batch(
                    [part.column("id"), pa.array(_runs(ids, bounds), pa.binary()), pa.array(np.diff(bounds)), pa.array(decoded, pa.string())],
                    ["id", "ids", "n_tokens", "decoded"],
                )

    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, ids binary, n_tokens bigint, decoded string").withColumnRenamed("id", id_column)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`doc_id`, `n_tokens` and the SHA-256 of the ids and of the decoded text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = bpe.encode(part.column("text"))
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(bounds)),
                        pa.array([hashlib.sha256(run).hexdigest() for run in _runs(ids, bounds)], pa.string()),
                        pa.array([hashlib.sha256(text).hexdigest() for text in bpe.decode(ids, bounds)], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
