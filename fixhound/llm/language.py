"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

A text is folded to lower-case letters and single spaces; its runs of one to three code points are
hashed into a fixed number of buckets. A bucket's weight is its share of the text's n-grams times
the inverse document frequency, counted over all training documents. The classifier is trained
with follow-the-regularised-leader (per-coordinate rates, elastic net) on a bounded sample, and a
temperature fitted on a part that training didn't see makes its scores probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .texts import slices, utf8

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3)
#: Labelled documents that the classifier is fitted on, shared evenly among the languages, at most.
SAMPLE = 8_000
UNKNOWN = "und"

_ALPHA, _BETA, _L1, _L2, _EPOCHS, _SCALE = 0.5, 1.0, 0.02, 1e-4, 2, 100.0
_folded: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """The code point that each is read as: letters in lower case, all else a space."""
    if not _folded:
        table = np.full(0x110000, 0x20, np.uint32)
        for code in range(0x110000):
            letter = chr(code)
            if letter.isalpha():
                low = letter.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _folded.append(table)
    return _folded[0]


#: Rows that are counted at a time, however short: 64 MB of counts.
_ROWS = 512


def grams(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order, the buckets of all n-grams and their texts' rows; and each text's letters."""
    data, offsets = utf8(texts)
    lead = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[offsets]
    point = _fold_table()[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")]
    space = point == 0x20
    keep = np.ones(len(point), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    kept = np.concatenate([[0], np.cumsum(keep)])
    letters = np.concatenate([[0], np.cumsum(~space)])
    point, bounds, letters = point[keep], kept[at], np.diff(letters[at])
    doc = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    buckets, rows = [], []
    for order in ORDERS:
        n = max(len(point) - order + 1, 0)
        mixed = np.full(n, 0x9E3779B1 * order & 0xFFFFFFFF, np.uint32)
        for k in range(order):
            mixed = (mixed ^ point[k : k + n]) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(13)
        inside = doc[:n] == doc[order - 1 : order - 1 + n]
        buckets.append(((mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS))[inside].astype(np.int32))
        rows.append(doc[:n][inside])
    return buckets, rows, letters


@dataclass
class LanguageModel:
    """Weights by bucket and language, with the inverse document frequencies and the temperature in them."""

    languages: list[str]
    weights: np.ndarray
    base: np.ndarray

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each language for each text, and the number of its letters."""
        buckets, rows, letters = grams(texts)
        total = np.zeros((len(letters), len(self.languages)))
        for bucket, row in zip(buckets, rows):
            if len(row):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                # summed text by text in double precision, so a score doesn't hang on the batch it came in
                total[row[first]] += np.add.reduceat(self.weights[bucket], first, axis=0, dtype=np.float64)
        n = sum(np.bincount(row, minlength=len(letters)) for row in rows)
        logits = total / np.maximum(n, 1)[:, None] + self.base
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True), letters


def _document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, over all of `docs`, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 16, _ROWS):
                buckets, rows, letters = grams(part.column("text"))
                seen = np.zeros((len(letters), BUCKETS), bool)
                for bucket, row in zip(buckets, rows):
                    seen[row, bucket] = True
                found[:BUCKETS] += seen.sum(axis=0)
                n += len(letters)
        found[BUCKETS] = n
        yield pa.record_batch([pa.array(np.arange(BUCKETS + 1)), pa.array(found)], ["bucket", "docs"])

    counted = docs.select("text").mapInArrow(run, "bucket bigint, docs bigint").groupBy("bucket").agg(F.sum("docs").alias("docs")).toPandas()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[counted["bucket"].to_numpy(np.int64)] = counted["docs"].to_numpy(np.int64)
    return out[:BUCKETS], int(out[BUCKETS])


def _train(vectors: list[tuple[np.ndarray, np.ndarray, int]], check: list[tuple[np.ndarray, np.ndarray, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets and a constant, by language), divided by the temperature that suits `check` best."""
    z, squares = np.zeros((BUCKETS + 1, n)), np.zeros((BUCKETS + 1, n))

    def weight(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        rate = (_BETA + np.sqrt(squares[at])) / _ALPHA + _L2
        return np.where(np.abs(zi) > _L1, -(zi - np.sign(zi) * _L1) / rate, 0.0)

    for epoch in range(_EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(vectors)).tolist():
            at, x, y = vectors[k]
            w = weight(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            step = x[:, None] * p
            squared = step * step
            sigma = (np.sqrt(squares[at] + squared) - np.sqrt(squares[at])) / _ALPHA
            z[at] += step - sigma * w
            squares[at] += squared
    w = weight(np.arange(BUCKETS + 1))
    logits = np.array([x @ w[at] for at, x, _ in check]).reshape(-1, n)
    y = np.array([y for _, _, y in check], int)

    def loss(temperature: float) -> float:
        scaled = logits / temperature
        top = scaled.max(axis=1)
        return float((np.log(np.exp(scaled - top[:, None]).sum(axis=1)) + top - scaled[np.arange(len(y)), y]).mean())

    temperature = 1.0
    if len(y):
        grid = np.exp(np.linspace(-3, 3, 121))
        temperature = float(grid[np.argmin([loss(t) for t in grid])])
    w /= temperature
    return w[:BUCKETS], w[BUCKETS]


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """Fit on `docs` (doc_id, text, lang): rows without a text or language are left out.

    Document frequencies are counted over all rows. The classifier is fitted on about `sample` of
    them, an even number of each language, chosen by a hash of doc_id; a tenth of these only sets
    the temperature. None if no row is left.
    """
    docs = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    per_language = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not per_language:
        return None
    languages = sorted(per_language)
    frequency, n = _document_frequencies(docs)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    each = max(sample // len(languages), 1)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    limits = F.create_map(*[F.lit(x) for lang, rows in per_language.items() for x in (lang, int((1 << 20) * min(1.0, each / rows)))])
    chosen = docs.where(place < limits[F.col("lang")]).select("lang", "text", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)) == 0).alias("check"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 16, _ROWS):
                buckets, rows, letters = grams(part.column("text"))
                counts = np.zeros((len(letters), BUCKETS), np.int32)
                for bucket, row in zip(buckets, rows):
                    np.add.at(counts, (row, bucket), 1)
                at = [np.flatnonzero(c) for c in counts]
                x = [counts[k, a] * idf[a] * (_SCALE / max(counts[k].sum(), 1)) for k, a in enumerate(at)]
                yield pa.record_batch(
                    [part.column("lang"), part.column("check"), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for v in x], pa.list_(pa.float32()))],
                    ["lang", "check", "at", "x"],
                )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {lang: k for k, lang in enumerate(languages)}
        fitted: dict[bool, list] = {False: [], True: []}
        for batch in batches:
            for k in range(batch.num_rows):
                at, x = (np.array(batch.column(c)[k].values) for c in ("at", "x"))
                y = code[batch.column("lang")[k].as_py()]
                fitted[batch.column("check")[k].as_py()].append((np.append(at, BUCKETS), np.append(x, np.float32(1)), y))
        w, base = _train(fitted[False], fitted[True], len(languages))
        yield pa.record_batch([pa.array([w.astype(np.float32).tobytes()]), pa.array([base.tobytes()])], ["weights", "base"])

    made = chosen.mapInArrow(vectors, "lang string, check boolean, at array<int>, x array<float>")
    ordered = made.repartition(1).sortWithinPartitions("lang", "at")
    row = ordered.mapInArrow(train, "weights binary, base binary").first()
    weights = np.frombuffer(row["weights"], np.float32).reshape(BUCKETS, -1) * (idf * _SCALE)[:, None].astype(np.float32)
    return LanguageModel(languages, weights, np.frombuffer(row["base"], np.float64))


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """All columns of `docs` with `lang_pred` and `score` (its probability) behind them.

    A null text, or one without a letter, is `und` with score 0; so is every text if there was
    nothing to learn from. Only `text` is looked at. Columns named lang_pred or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                if model is None:
                    names, top = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                else:
                    p, letters = model.scores(part.column("text"))
                    best = p.argmax(axis=1)
                    known = letters > 0
                    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
                    top = np.where(known, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(top)], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
