"""A stored positional index of a corpus: which words and word pairs stand where in which file.

Every version of the corpus adds its new and changed files. A version has

- `postings`: for each gram (a word, or two words in a row) and block of files, the files as offsets
  in the block and the places in them. Rows are partitioned by ranges of the gram's hash and sorted
  by gram, so a lookup opens the ranges that it touches and no others. A gram that a third of all files
  hold is a row for each of its blocks, or several, never one list.
- `names`: the files with their repositories.
- `sketch`: for some hash functions, the least and the greatest number of files of the grams in each
  cell. A gram's number of files lies between the two for each function.

A log entry makes a version count; a version that was begun and not logged is never read, and is
replaced when it is written again. `append` reads texts twice, for their size and for their grams. Texts are
dealt out by block, so grams meet where they are found: neither occurrences nor postings are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixhound.functions.grams import with_words

BLOCK_FILES = 256
#: Text of a task, so that its postings are sorted in memory; less of it where that leaves cores idle.
TASK_BYTES, LEAST_BYTES = 16 << 20, 4 << 20
#: Words whose grams are put together at a time.
GATHERED_WORDS = 1 << 20
RANGE_BITS = 6
SKETCH_DEPTH = 3
SKETCH_WIDTH = 1 << 18

_LOG = "version BIGINT, changed BIGINT"
_POSTINGS = (
    "gram STRING, block BIGINT, n_files INT, files ARRAY<SMALLINT>, "
    "places ARRAY<INT>, version BIGINT, range INT"
)
_GRAMS = "gram STRING, block BIGINT, n_files INT, files ARRAY<SMALLINT>, places ARRAY<INT>"
_NAMES = "file_id BIGINT, repo_name STRING, version BIGINT"
_SKETCH = "depth INT, cell INT, low BIGINT, high BIGINT, version BIGINT"


def gram_hash(gram: Column) -> Column:
    return F.xxhash64(gram)


def hash_range(hashed: Column, bits: int) -> Column:
    """The number of the range that a hash is in; ranges are of equal size."""
    return (F.shiftright(hashed, 64 - bits) + (1 << (bits - 1))).cast("int")


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    first = np.zeros(len(keys[0]), bool)
    first[:1] = True
    for key in keys:
        first[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(first)


def _posted(files: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows of some files `(file_id, words)`."""
    table = pa.Table.from_batches(files).combine_chunks()
    table = table.take(pa.array(np.argsort(table["file_id"].to_numpy(), kind="stable"))).combine_chunks()
    lists = table["words"].combine_chunks()
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(code):
        return
    file = np.repeat(table["file_id"].to_numpy(), counts)
    place = np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts)
    # a pair stands where a word that isn't its file's first one stands behind
    at = np.flatnonzero(place[1:] > 0)
    size = len(words)
    key = np.concatenate([code, size + code[at] * size + code[at + 1]])
    file, place = np.concatenate([file, file[at]]), np.concatenate([place, place[at]])
    order = np.argsort(key, kind="stable")
    key, file, place = key[order], file[order], place[order]
    block = file // BLOCK_FILES
    begin = _runs(key, block)
    another = np.zeros(len(key), np.int64)
    another[_runs(key, file)] = 1
    single, pair = key[begin][key[begin] < size], key[begin][key[begin] >= size] - size
    grams = [words.take(pa.array(single)), pc.binary_join_element_wise(words.take(pa.array(pair // size)), words.take(pa.array(pair % size)), " ")]
    offsets = pa.array(np.append(begin, len(key)).astype(np.int32))
    made = pa.record_batch(
        [
            pa.concat_arrays([g.cast(pa.string()) for g in grams]),
            pa.array(block[begin]),
            pa.array(np.add.reduceat(another, begin).astype(np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array((file - block * BLOCK_FILES).astype(np.int16))),
            pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))),
        ],
        ["gram", "block", "n_files", "files", "places"],
    )
    for row in range(0, made.num_rows, 1 << 16):
        yield made.slice(row, 1 << 16)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows of `(file_id, words)`, some files at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + GATHERED_WORDS - size, "right")))
            held.append(batch.slice(begin, end - begin))
            size += int(ends[min(end, batch.num_rows) - 1] - done)
            begin = end
            if size >= GATHERED_WORDS or begin < batch.num_rows:
                yield from _posted(held)
                held, size = [], 0
    if held:
        yield from _posted(held)


class PairIndex:
    def __init__(self, spark: SparkSession, path: str, range_bits: int = RANGE_BITS, sketch_width: int = SKETCH_WIDTH):
        """An index keeps the `range_bits` and `sketch_width` that it was begun with."""
        self.spark, self.path = spark, path.rstrip("/")
        self.range_bits, self.sketch_width = range_bits, sketch_width

    def log(self) -> dict[int, int]:
        """Complete versions, each with how many files of earlier ones it replaced."""
        try:
            rows = self.spark.read.schema(_LOG).parquet(f"{self.path}/log").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {r.version: r.changed for r in rows}

    def version(self) -> int:
        return max(self.log(), default=0)

    def append(self, files: DataFrame) -> int:
        """Add a version with these files `(file_id, repo_name, content)`, and return its number.

        A file with the number of an earlier one takes its place. File numbers are not null.
        """
        version = self.version() + 1
        names = files.select("file_id", "repo_name")
        changed = names.join(self._names(self.log()), "file_id", "left_semi").count() if version > 1 else 0
        self._write(names, "names", version)
        self._write(self._posted(files), "postings", version, "range")
        written = self.spark.read.parquet(f"{self.path}/postings/version={version}")
        # 96 bits stand for the gram, so that no text is moved for its number
        counts = written.groupBy(gram_hash(F.col("gram")).alias("hash"), F.hash("gram").alias("check")).agg(
            F.sum("n_files").alias("n")
        )
        self._write(self._sketched(counts), "sketch", version)
        entry = self.spark.range(1).select(
            F.lit(version).cast("bigint").alias("version"), F.lit(changed).cast("bigint").alias("changed")
        )
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return version

    def _write(self, rows: DataFrame, table: str, version: int, *by: str) -> None:
        writer = rows.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{table}/version={version}")

    def _posted(self, files: DataFrame) -> DataFrame:
        """Posting rows. Texts are dealt out by block first, so the occurrences of a gram in a block are in one task."""
        octets = files.agg(F.sum(F.octet_length("content"))).first()[0] or 0
        cores = self.spark.sparkContext.defaultParallelism
        tasks = max(1, -(-octets // TASK_BYTES), min(cores, octets // LEAST_BYTES))
        block = F.floor(F.col("file_id") / F.lit(BLOCK_FILES)).cast("bigint")
        texts = files.where("file_id IS NOT NULL").select(F.col("file_id").cast("bigint").alias("file_id"), "content")
        dealt = texts.repartition(tasks, block).sortWithinPartitions("file_id")
        rows = with_words(dealt, "content").select("file_id", "words").mapInArrow(_gathered, _GRAMS)
        order = ["range", "gram"]
        return rows.withColumn("range", hash_range(gram_hash(F.col("gram")), self.range_bits)).sortWithinPartitions(*order)

    def cells(self) -> Column:
        """The cells of a gram, one for each hash function, by its columns `hash` and `check`."""
        width = F.lit(self.sketch_width)
        return F.array(
            *[
                F.struct(
                    F.lit(d).alias("depth"),
                    F.pmod(F.xxhash64(F.lit(d), "hash", "check"), width).cast("int").alias("cell"),
                )
                for d in range(SKETCH_DEPTH)
            ]
        )

    def _sketched(self, counts: DataFrame) -> DataFrame:
        rows = counts.select("n", F.inline(self.cells()))
        return rows.groupBy("depth", "cell").agg(F.min("n").alias("low"), F.max("n").alias("high"))

    def _table(self, table: str, schema: str, versions) -> DataFrame:
        """A table's rows of these versions; the others' folders aren't opened."""
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        return rows.where(F.col("version").isin([int(v) for v in versions]))

    def _names(self, versions) -> DataFrame:
        return self._table("names", _NAMES, versions)

    def names(self) -> DataFrame:
        """All entries of files, changed ones with each of their versions."""
        return self._names(self.log())

    def postings(self, grams: DataFrame, newer_than: int = 0) -> DataFrame:
        """Postings of the versions after `newer_than`, of the hash ranges that `grams` touches.

        The list of ranges has at most 2 ** range_bits numbers.
        """
        ranges = grams.select(hash_range(gram_hash(F.col("gram")), self.range_bits).alias("range")).distinct()
        touched = sorted(r[0] for r in ranges.collect())
        versions = [v for v in self.log() if v > newer_than]
        return self._table("postings", _POSTINGS, versions).where(F.col("range").isin(touched))

    def bounds(self, grams: DataFrame) -> DataFrame:
        """`gram, low, high`: bounds of the number of files that hold a gram. A gram that isn't
        returned is in no file.

        A version that replaced files makes the lower bound 1, as counts of old files are in it.
        """
        log = self.log()
        cells = self._table("sketch", _SKETCH, log).groupBy("depth", "cell").agg(
            F.min("low").alias("low"), F.sum("high").alias("high")
        )
        hashed = grams.select("gram").distinct().select("gram", gram_hash(F.col("gram")).alias("hash"), F.hash("gram").alias("check"))
        wanted = hashed.select("gram", F.inline(self.cells()))
        met = wanted.join(cells, ["depth", "cell"]).groupBy("gram").agg(
            F.count("*").alias("n"), F.max("low").alias("low"), F.min("high").alias("high")
        )
        low = F.lit(1).cast("bigint") if any(log.values()) else F.col("low")
        return met.where(F.col("n") == SKETCH_DEPTH).select("gram", low.alias("low"), "high")
