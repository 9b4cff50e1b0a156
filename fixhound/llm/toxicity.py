"""Toxic passages by maximum-scoring segment search.

Units (whole words and their beginnings of a few bytes) get log-odds between toxic and other
documents under a Dirichlet prior that is in proportion to their overall use. A token scores as
its clearest toxic unit; tokens without one share a small negative score. A linear scan then finds all maximal-scoring segments of a text (those of Ruzzo and
Tompa), of which the significant ones are its toxic passages: the score of the best segment of n
clean tokens follows an extreme-value law, P(S > x) = 1 - exp(-K n exp(-lambda x)), with lambda
from the clean word scores and K from the clean documents' segments. What the passages of a
document say together becomes a probability by logistic calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stores import written
from .texts import Tokens, signed, slices

#: Labelled documents that the model is fitted on, of each class, at most.
SAMPLE = 10_000
#: Units of the lexicon at most, the clearest first.
LEXICON = 50_000
#: Total of the Dirichlet prior, as a share of all units counted.
PRIOR = 0.02
#: Log-odds count if they lie this many standard deviations above zero, and are this large.
CLEAR, LEAST = 5.0, 1.0
#: Occurrences of a unit that count in one document.
COUNTED = 3
#: Bytes of the word beginnings that are units.
BEGINNINGS = (4, 5, 6, 7, 8)
#: What a word without clear log-odds adds at least to a segment's score, downwards.
DRIFT = 0.05
#: Expected clean segments of this score or more in a document, below which a passage is significant.
E_VALUE = 0.5


def units(tokens: Tokens) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of one kind of unit after another, and the tokens that have it."""
    yield signed(tokens.hashes), np.arange(len(tokens.hashes))
    for size in BEGINNINGS:
        hashes, where = tokens.beginnings(size)
        yield signed(hashes), where


def maximal_segments(places: np.ndarray, scores: np.ndarray, background: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments: (first, one past the last, score).

    places, scores: the positive tokens in ascending order; every other token scores `background` < 0.
    """
    begins: list[int] = []
    ends: list[int] = []
    lefts: list[float] = []
    rights: list[float] = []
    total, before = 0.0, 0
    for place, score in zip(places.tolist(), scores.tolist()):
        total += (place - before) * background
        begin, left, right = place, total, total + score
        total, before = right, place + 1
        j = len(lefts) - 1
        while True:
            while j >= 0 and lefts[j] >= left:
                j -= 1
            if j < 0 or rights[j] >= right:
                break
            begin, left = begins[j], lefts[j]
            del begins[j:], ends[j:], lefts[j:], rights[j:]
            j -= 1
        begins.append(begin)
        ends.append(place + 1)
        lefts.append(left)
        rights.append(right)
    return [(b, e, r - x) for b, e, x, r in zip(begins, ends, lefts, rights)]


@dataclass
class ToxicModel:
    """Word scores, the extreme-value law of clean texts, and the calibration."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    background: float = -DRIFT
    decay: float = 1.0
    k: float = 1.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    base: float = 0.0

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, float]]]]:
        """Of each text: tokens, positive tokens, maximal segments."""
        tokens = Tokens(texts)
        n = len(tokens.counts)
        found: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
        hits = np.zeros(n, np.int64)
        if len(self.words) and len(tokens.hashes):
            best = np.zeros(len(tokens.hashes))
            for hashes, owner in units(tokens):
                at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
                hit = self.words[at] == hashes
                best[owner[hit]] = np.maximum(best[owner[hit]], self.scores[at[hit]])
            where = np.flatnonzero(best)
            doc, place = tokens.doc[where], where - tokens.first[tokens.doc[where]]
            score = best[where]
            hits = np.bincount(doc, minlength=n)
            for d in np.flatnonzero(hits).tolist():
                a, b = np.searchsorted(doc, (d, d + 1))
                found[d] = maximal_segments(place[a:b], score[a:b], self.background)
        return tokens.counts, hits, found

    def strength(self, score: float, tokens: int) -> float:
        """-log of the expected number of clean segments of this score or more."""
        return self.decay * score - np.log(self.k * max(tokens, 1))

    def features(self, tokens: int, hits: int, segments: list[tuple[int, int, float]]) -> tuple[float, float, float, float]:
        strengths = [self.strength(s, tokens) for _, _, s in segments]
        clear = [x for x in strengths if x >= -np.log(E_VALUE)]
        top = max(strengths, default=0.0)
        return float(bool(segments)), max(top, 0.0), float(np.log1p(len(clear))), float(np.log1p(hits))

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.base, -30, 30)))


def training_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and toxic of at most `sample` labelled documents of each class, in order of a hash of their id.

    Rows without an id or a label of 0 or 1 are left out; of several labels of a document the highest counts.
    """
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    classes = [one.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    return classes[0].unionByName(classes[1])


def _unit_counts(rows: DataFrame) -> DataFrame:
    """word, y0, y1: occurrences of each unit in either class, `COUNTED` of a document at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                tokens = Tokens(part.column("text"))
                toxic = part.column("toxic").to_numpy(zero_copy_only=False)
                for hashes, owner in units(tokens):
                    doc = tokens.doc[owner]
                    order = np.lexsort((doc, hashes))
                    word, doc = hashes[order], doc[order]
                    first = np.ones(len(word), bool)
                    first[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
                    at = np.flatnonzero(first)
                    times = np.minimum(np.diff(np.append(at, len(word))), COUNTED)
                    word, y = word[at], toxic[doc[at]]
                    unique, code = np.unique(word, return_inverse=True)
                    y1 = np.bincount(code, times * y, len(unique)).astype(np.int64)
                    every = np.bincount(code, times, len(unique)).astype(np.int64)
                    yield pa.record_batch([pa.array(unique), pa.array(every - y1), pa.array(y1)], ["word", "y0", "y1"])

    counted = rows.select("text", "toxic").mapInArrow(run, "word bigint, y0 bigint, y1 bigint")
    return counted.groupBy("word").agg(F.sum("y0").alias("y0"), F.sum("y1").alias("y1"))


def _lexicon(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    counts = _unit_counts(rows)
    counts = written.table(counts, "toxic-words")
    n0, n1 = counts.agg(F.coalesce(F.sum("y0"), F.lit(0)), F.coalesce(F.sum("y1"), F.lit(0))).first()
    if not n0 or not n1:
        return np.zeros(0, np.int64), np.zeros(0), -DRIFT
    whole = PRIOR * (n0 + n1)
    prior = F.lit(PRIOR) * (F.col("y0") + F.col("y1"))
    odds = {y: F.log((F.col(f"y{y}") + prior) / (F.lit(n + whole) - F.col(f"y{y}") - prior)) for y, n in ((0, n0), (1, n1))}
    delta = odds[1] - odds[0]
    z = delta / F.sqrt(1 / (F.col("y0") + prior) + 1 / (F.col("y1") + prior))
    clear = counts.select("word", "y0", "y1", delta.alias("delta"), z.alias("z")).where((F.col("z") >= CLEAR) & (F.col("delta") >= LEAST))
    rows = clear.orderBy(F.desc("z"), "word").limit(LEXICON).collect()
    rows.sort(key=lambda r: r.word)
    return np.array([r.word for r in rows], np.int64), np.array([r.delta for r in rows]), -DRIFT


def _decay(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(shares * exp(x * scores)) = 1."""
    low, high = 1e-6, 1.0
    value = lambda x: float((shares * np.exp(np.clip(x * scores, -700, 700))).sum())
    while value(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 1 else (low, middle)
    return high


def _logistic(features: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method, with a small ridge on the weights."""
    x = np.column_stack([features, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicModel:
    """Fit on the labelled documents among `docs` (doc_id, text); `labels` has doc_id and toxic.

    At most `sample` documents of each class are used. Without labels of both classes every text
    gets the share of toxic labels, or 0.
    """
    chosen = training_labels(labels, sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id")
    words, scores, background = _lexicon(rows)
    model = ToxicModel(words, scores, background)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, hits, found = model.segments(part.column("text"))
                yield pa.record_batch(
                    [part.column("toxic"), pa.array(tokens), pa.array(hits), pa.array([[s for _, _, s in f] for f in found], pa.list_(pa.float64()))],
                    ["toxic", "tokens", "hits", "segments"],
                )

    seen = rows.select("text", "toxic").mapInArrow(run, "toxic int, tokens bigint, hits bigint, segments array<double>").collect()
    y = np.array([r.toxic for r in seen], float)
    if not len(y) or y.min() == y.max():
        model.base = -30.0 if not len(y) or y.max() == 0 else 30.0
        return model
    clean = [r for r in seen if not r.toxic]
    n = sum(r.tokens for r in clean)
    every = np.array([s for r in clean for s in r.segments])
    if len(every) and n:
        share = sum(r.hits for r in clean) / n
        model.decay = _decay(np.array([every.mean(), background]), np.array([share, 1 - share]))
        middle = float(np.median(every))
        model.k = max((every >= middle).sum() / (n * np.exp(-model.decay * middle)), 1e-12)
    features = np.array([model.features(r.tokens, r.hits, [(0, 0, s) for s in r.segments]) for r in seen])
    model.weights, model.base = _logistic(features, y)
    return model


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """`doc_id`, `score` (0 to 1) and `passages` (first token, one past the last, score, expected
    clean segments as good) of every whole text.

    Null and empty texts have no passages and get the score of a text without toxic words.
    Repeated rows each give a row; other columns aren't read.
    """
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, hits, found = model.segments(part.column("text"))
                features = np.array([model.features(*x) for x in zip(tokens.tolist(), hits.tolist(), found)]).reshape(-1, 4)
                passages = []
                for n, segments in zip(tokens.tolist(), found):
                    rated = [(b, e, s, float(np.exp(-model.strength(s, n)))) for b, e, s in segments]
                    passages.append([dict(zip(("first", "last", "score", "expected"), r)) for r in rated if r[3] <= E_VALUE])
                yield pa.record_batch([part.column("doc_id"), pa.array(model.probability(features)), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, passages array<struct<first:bigint,last:bigint,score:double,expected:double>>")
