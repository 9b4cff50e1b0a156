"""Token-id output as wavelet matrices.

A shard holds the ids of a run of documents in ascending order of their id. Its ids are a wavelet
matrix: one bit plane per bit of the largest id, highest first; behind each plane the ids are
parted, stably, into those with a 0 and those with a 1. With the number of ones before each block
of bits, any token, the count of a token in a range and the place of its k-th occurrence are found
in one step per plane, without unpacking. Shards are written as Parquet, a row each, so that they
go through Spark's own writer to any store and a lost task is simply run again.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import Encoder, default_path
from .stores import written
from .texts import slices

BLOCK = 512
#: A shard is closed at this many ids; one document is never split.
SHARD_IDS = 4_000_000
#: Bytes of input, as Spark estimates them, for each range of documents.
RANGE_BYTES = 8 << 20


class WaveletMatrix:
    """A sequence of token ids as bit planes."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], size: int):
        self.planes, self.zeros, self.size = planes, zeros, size
        self.bits = len(planes)
        self._ones: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        rest = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = (rest >> level) & 1 == 1
            planes.append(np.packbits(bit, bitorder="little"))
            low = rest[~bit]
            zeros.append(len(low))
            rest = np.concatenate([low, rest[bit]])
        return cls(planes, zeros, len(ids))

    def to_bytes(self) -> bytes:
        """size, number of planes, zeros of each plane (64-bit), then the planes."""
        head = np.array([self.size, self.bits, *self.zeros], "<u8").tobytes()
        return b"".join([head, *(p.tobytes() for p in self.planes)])

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        size, bits = np.frombuffer(raw, "<u8", 2).tolist()
        zeros = np.frombuffer(raw, "<u8", bits, 16).tolist()
        data = np.frombuffer(raw, np.uint8, offset=16 + 8 * bits)
        step = (size + 7) // 8
        return cls([data[k * step : (k + 1) * step] for k in range(bits)], zeros, size)

    def _plane(self, k: int) -> np.ndarray:
        return np.unpackbits(self.planes[k], count=self.size, bitorder="little").view(bool)

    def decode(self) -> np.ndarray:
        """All ids in order."""
        rest = np.zeros(self.size, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            bit, level = self._plane(k), self.bits - 1 - k
            out = np.empty_like(rest)
            out[~bit] = rest[: self.zeros[k]]
            out[bit] = rest[self.zeros[k] :] | rest.dtype.type(1 << level)
            rest = out
        return rest

    # ---- without unpacking

    def _directory(self) -> list[np.ndarray]:
        """Ones before each block, by plane."""
        if self._ones is None:
            self._ones = []
            for plane in self.planes:
                ones = np.bitwise_count(plane)
                sums = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK // 8), dtype=np.int64) if len(ones) else ones
                self._ones.append(np.concatenate([[0], np.cumsum(sums)]))
        return self._ones

    def _rank1(self, k: int, i: int) -> int:
        """Ones among the first `i` bits of plane `k`."""
        block = i // BLOCK
        some = self.planes[k][block * BLOCK // 8 : (i + 7) // 8]
        inside = np.unpackbits(some, bitorder="little")[: i - block * BLOCK]
        return int(self._directory()[k][block]) + int(inside.sum())

    def _select(self, k: int, one: bool, nth: int) -> int:
        """Place of the nth (from 0) bit of this kind in plane `k`."""
        ones = self._directory()[k]
        before = ones if one else np.minimum(np.arange(len(ones)) * BLOCK, self.size) - ones
        block = int(np.searchsorted(before, nth, "right")) - 1
        bits = np.unpackbits(self.planes[k][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[nth - int(before[block])])

    def access(self, i: int) -> int:
        """The id at place `i`."""
        token = 0
        for k in range(self.bits):
            bit = self.planes[k][i >> 3] >> (i & 7) & 1
            ones = self._rank1(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            token = token << 1 | int(bit)
        return token

    def _narrow(self, token: int, begin: int, end: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self._rank1(k, begin), self._rank1(k, end)
            if token >> (self.bits - 1 - k) & 1:
                begin, end = self.zeros[k] + a, self.zeros[k] + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of `token` in places begin to end."""
        if token >> self.bits:
            return 0
        a, b = self._narrow(token, begin, self.size if end is None else end)
        return b - a

    def locate(self, token: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of `token`; -1 if there are fewer."""
        if not 0 <= nth < self.count(token):
            return -1
        i = self._narrow(token, 0, self.size)[0] + nth
        for k in range(self.bits - 1, -1, -1):
            one = bool(token >> (self.bits - 1 - k) & 1)
            i = self._select(k, one, i - self.zeros[k] if one else i)
        return i


class LibraryIds:
    """Ids by the tokenizers library, which is asked once for every piece it hasn't seen."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self._tokenizer.get_added_tokens_decoder().items()}
        self._encoder = Encoder(self._pieces, special)

    def _pieces(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(begins.tolist(), ends.tolist())]
        ids = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for run in ids for i in run), np.uint32, int(sizes.sum())), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._encoder.encode(texts)


_libraries: dict[str, LibraryIds] = {}


def library(path: str) -> LibraryIds:
    if path not in _libraries:
        _libraries[path] = LibraryIds(path)
    return _libraries[path]


_SHARD = pa.schema([("shard", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("matrix", pa.binary())])


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, shard_ids: int = SHARD_IDS, ranges: int | None = None) -> None:
    """Encode `docs` (doc_id, text) and write shards in ascending order of doc_id to `folder`.

    Null texts count as empty: only the end id. Rows with the same doc_id stand in order of their
    text. An empty table gives an empty folder of Parquet with the same columns.
    """
    path = path or default_path()
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    if ranges is None:
        stats = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        ranges = max(1, min(int(str(stats)) // RANGE_BYTES, 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = library(path), TaskContext.get().partitionId() << 24
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal shard, size
            ids = np.concatenate([h[1] for h in held])
            matrix = WaveletMatrix.build(ids)
            row = {
                "shard": shard,
                "n_tokens": len(ids),
                "doc_ids": [d for h in held for d in h[0].to_pylist()],
                "sizes": np.concatenate([h[2] for h in held]),
                "matrix": matrix.to_bytes(),
            }
            held.clear()
            shard, size = shard + 1, 0
            return pa.RecordBatch.from_pylist([row], _SHARD)

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, bounds = encoder.encode(part.column("text"))
                with_end = np.insert(ids, bounds[1:], end_id)
                held.append((part.column("doc_id"), with_end, np.diff(bounds) + 1))
                size += len(with_end)
                if size >= shard_ids:
                    yield close()
        if held:
            yield close()

    ordered = docs.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(run, "shard bigint, n_tokens bigint, doc_ids array<bigint>, sizes array<bigint>, matrix binary")
    shards.write.mode("error").option("compression", "zstd").parquet(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of all shards of a folder: doc_id, `start` (ids before it), `n_tokens` and the
    unsigned CRC-32 of its ids as little-endian unsigned 32-bit integers."""
    shards = spark.read.parquet(folder)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", "n_tokens").select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                ids = WaveletMatrix.from_bytes(one.column("matrix")[0].as_buffer()).decode()
                sizes = np.array(one.column("sizes")[0].values)
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4").data.cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                yield pa.record_batch(
                    [one.column("doc_ids")[0].values, pa.array(ends - sizes + one.column("start")[0].as_py()), pa.array(sizes), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    joined = shards.select("shard", "doc_ids", "sizes", "matrix").join(starts, "shard")
    return joined.select("start", "doc_ids", "sizes", "matrix").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write shards to a fresh folder among the shared ones and read them back."""
    folder = written.fresh(docs.sparkSession, "token-shards")
    write_shards(docs, folder, path)
    return read_documents(docs.sparkSession, folder)
