"""Near-duplicate classes with DartMinHash signatures, banded joins and exact checks.

A document is its five-word shingles, each weighing as often as it occurs. Darts are thrown into
the plane of weight and rank, for each shingle the same ones in every document: the plane is cut
into cells of doubling width, and a hash of shingle and cell gives the number of darts in it
(Poisson), their places and the coordinate each counts for. A document catches the darts below
its weights; the earliest of each coordinate is the signature. About K ln K + 2K darts are enough
for K coordinates, however long the text is; ranks are explored further where one stays empty.

Two documents agree in a coordinate with the probability of their weighted Jaccard similarity. Documents
that agree in a whole band meet in a bucket. In steps, all documents of a bucket are compared with
one of it, and those that are linked have a label in common. Documents that still share a bucket with another class are compared across classes only,
by their rarest shingles: where the first one that two documents share stands in both, in order of
rarity, bounds how much they can share, and for each such place only documents of a size that the
bound allows meet. Neither a large group of near copies nor one of different documents with a common
passage is multiplied out. Every pair is checked exactly before it counts as a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stores import written
from .texts import Tokens, mix, signed, slices

SIMILARITY = 0.8
#: Bands and coordinates in each: at a similarity of 0.8 a pair is missed once in 40,000.
BANDS, ROWS = 20, 4
_COORDINATES = BANDS * ROWS
_DARTS = _COORDINATES * np.log(_COORDINATES) + 2 * _COORDINATES
_FIRST_CELL = 0.25
#: Steps in which buckets are compared with one of their documents: until a step links fewer than this
#: share of the documents, and no more than this many.
ROUNDS, FEW = 8, 0.002
#: Bits of 64 in which the sketches of two documents of enough similarity differ at most. At a
#: similarity of 0.8 the mean is 6.4 and the standard deviation 2.4.
_SKETCH_BITS = 22


def _cell_bounds(k: int, first: float) -> tuple[float, float]:
    """Cells [0, first), [first, 2 first), [2 first, 4 first), ..."""
    return (0.0, first) if k == 0 else (first * 2.0 ** (k - 1), first * 2.0**k)


def _poisson_steps(mean: float) -> np.ndarray:
    """P(N <= n) for n = 0, 1, ... until it is all but 1."""
    n = np.arange(int(mean + 12 * np.sqrt(mean) + 20))
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, len(n))))])
    return np.cumsum(np.exp(n * np.log(mean) - mean - logs))


def _unit(bits: np.ndarray) -> np.ndarray:
    return (bits >> np.uint64(11)) * (1.0 / (1 << 53))


def _darts(elements: np.ndarray, weights: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts below each element's weight and limit of rank: element's index, rank, hash."""
    indexes, ranks, hashes = [], [], []
    column = 0
    at_weight = np.arange(len(elements))
    while len(at_weight):
        low_w, high_w = _cell_bounds(column, 1.0)
        at_weight = at_weight[weights[at_weight] > low_w]
        row, at = 0, at_weight
        while len(at):
            low, high = _cell_bounds(row, _FIRST_CELL)
            at = at[limits[at] > low]
            if not len(at):
                break
            with np.errstate(over="ignore"):
                cell = mix(elements[at] + np.uint64((column * 64 + row + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                n = np.searchsorted(_poisson_steps((high - low) * (high_w - low_w)), _unit(cell), "right")
                some = np.flatnonzero(n)
                n = n[some]
                index = np.repeat(at[some], n)
                nth = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
                dart = mix(np.repeat(cell[some], n) + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
                rank = low + (high - low) * _unit(dart)
                keep = rank < limits[index]
                if high_w > 1 or (weights[index] < high_w).any():
                    keep &= low_w + (high_w - low_w) * _unit(mix(dart ^ np.uint64(0x5851F42D4C957F2D))) < weights[index]
            indexes.append(index[keep])
            ranks.append(rank[keep])
            hashes.append(dart[keep])
            row += 1
        column += 1
    if not indexes:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return np.concatenate(indexes), np.concatenate(ranks), np.concatenate(hashes)


def signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """DartMinHash signatures, a row for each document; all zero for one without elements.

    elements: 64-bit hashes, each once in a document; weights: positive; doc: ascending row numbers.
    """
    out = np.zeros((docs, _COORDINATES), np.uint64)
    total = np.bincount(doc, weights, docs)
    reach = _DARTS / np.maximum(total, 1e-12)
    open_ = total > 0
    while open_.any():
        at = np.flatnonzero(open_[doc])
        index, rank, dart = _darts(elements[at], weights[at], reach[doc[at]])
        row = doc[at[index]]
        coordinate = ((mix(dart + np.uint64(1)) >> np.uint64(32)) * np.uint64(_COORDINATES) >> np.uint64(32)).astype(np.int64)
        key = row * _COORDINATES + coordinate
        order = np.lexsort((rank, key))
        key, dart = key[order], dart[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        out.ravel()[key[first]] = dart[first]
        filled = np.bincount(key[first] // _COORDINATES, minlength=docs)
        open_ &= filled < _COORDINATES
        reach[open_] *= 2
    return out


def _weighted_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct shingles of each text: hashes, weights, rows; and the number of texts."""
    tokens = Tokens(texts)
    shingle, doc = tokens.shingles()
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    first = np.ones(len(shingle), bool)
    first[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return shingle[at], np.diff(np.append(at, len(shingle))).astype(float), doc[at], len(tokens.counts)


def _digest() -> F.Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _signed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, shingles (with repeats), 64-bit sketch and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                shingle, weight, doc, n = _weighted_shingles(part.column("text"))
                signature = signatures(shingle, weight, doc, n)
                bits = (signature[:, :64] & np.uint64(1)).astype(np.uint8)
                sketch = np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()
                bands = np.zeros((n, BANDS), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(ROWS):
                        bands = mix(bands + signature[:, k::ROWS])
                    bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("digest"), pa.array(np.bincount(doc, weight, n).astype(np.int64)), pa.array(sketch), pa.FixedSizeListArray.from_arrays(pa.array(signed(bands.ravel())), BANDS).cast(pa.list_(pa.int64()))],
                    ["doc_id", "digest", "n", "sketch", "bands"],
                )

    return docs.select("doc_id", _digest().alias("digest"), "text").mapInArrow(run, "doc_id bigint, digest string, n bigint, sketch bigint, bands array<bigint>")


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """doc and its shingles as a set: the k-th occurrence of a shingle is an element of its own, so
    the similarity of sets is the weighted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                shingle, weight, doc, n = _weighted_shingles(part.column("text"))
                times = weight.astype(np.int64)
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                with np.errstate(over="ignore"):
                    element = signed(mix(np.repeat(shingle, times) + nth.astype(np.uint64)))
                sizes = np.bincount(np.repeat(doc, times), minlength=n)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.record_batch([part.column("doc"), pa.ListArray.from_arrays(offsets, pa.array(element))], ["doc", "elements"])

    return docs.mapInArrow(run, "doc bigint, elements array<bigint>")


def _near(a: str, b: str) -> F.Column:
    """Whether sizes and sketches allow enough similarity."""
    n = [F.col(f"{x}.n") for x in (a, b)]
    sizes = F.least(*n) >= F.lit(SIMILARITY) * F.greatest(*n)
    return sizes & (F.bit_count(F.col(f"{a}.sketch").bitwiseXOR(F.col(f"{b}.sketch"))) <= _SKETCH_BITS)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact similarity is enough."""
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("elements").alias("ea")), "a")
    both = both.join(sets.select(F.col("doc").alias("b"), F.col("elements").alias("eb")), "b")
    common = F.size(F.array_intersect("ea", "eb"))
    similarity = common / (F.size("ea") + F.size("eb") - common)
    return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= SIMILARITY).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """doc and label, the least document that links lead to; for the documents of (a, b) links.

    Labels spread along links and jump along labels until none changes; each round is written, so
    plans stay short.
    """
    both = written.table(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written.table(both.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("doc").alias("b"), "label"), "b").groupBy(F.col("a").alias("doc")).agg(F.min("label").alias("seen"))
        lower = labels.join(seen, "doc").select("doc", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("doc").alias("label"), F.col("label").alias("next"))
        new = written.table(lower.join(jump, "label").select("doc", "old", F.least("label", "next").alias("label")), "labels")
        if new.where("label < old").isEmpty():
            return new.select("doc", "label")
        labels = new.select("doc", "label")


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels with further links: these are drawn between labels, so what is settled isn't gone through again."""
    if labels is None:
        return components(links)
    for side in ("a", "b"):
        named = labels.select(F.col("doc").alias(side), F.col("label").alias(f"l{side}"))
        links = links.join(named, side, "left").withColumn(f"l{side}", F.coalesce(f"l{side}", side))
    links = written.table(links, "new-links")
    drawn = links.where("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    if drawn.isEmpty():
        return labels
    over = components(drawn).select(F.col("doc").alias("label"), F.col("label").alias("least"))
    fresh = links.select(F.col("a").alias("doc"), F.col("la").alias("label")).unionByName(links.select(F.col("b").alias("doc"), F.col("lb").alias("label")))
    every = labels.unionByName(fresh.where("doc = label")).distinct()
    return written.table(every.join(over, "label", "left").select("doc", F.coalesce("least", "label").alias("label")), "labels")


def _pivot_pairs(placed: DataFrame, step: int) -> DataFrame:
    """In each bucket, one document and all of other labels: pairs (a, b) that may be similar enough.

    placed: doc, n, sketch, bucket, degree, label. The one is of the label that most of the bucket have,
    in every second step of another; in it, the one that shares buckets with most documents first,
    as the text does that the others are copies of, and by turns any other.
    """
    sizes = placed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"))
    first = F.struct("size", "label")
    main = sizes.groupBy("bucket").agg(F.max(first).alias("m"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    if step % 2:
        others = sizes.join(main.select("bucket", F.col("m.label").alias("main")), "bucket").where("label != main")
        main = others.groupBy("bucket").agg(F.max(first).alias("m"))
    turn = F.col("degree") if step < 2 else F.xxhash64("doc", F.lit(step))
    if step == 0:
        # every document has a label of its own
        heads = placed.join(main.select("bucket"), "bucket", "left_semi")
    else:
        heads = placed.join(main.select("bucket", F.col("m.label").alias("label")), ["bucket", "label"], "left_semi")
    heads = heads.groupBy("bucket").agg(F.max(F.struct(turn.alias("turn"), "doc", "n", "sketch", "label")).alias("h"))
    pairs = placed.join(heads, "bucket").where(F.col("label") != F.col("h.label")).alias("x").where(_near("x", "x.h"))
    return pairs.select(F.least("x.h.doc", "x.doc").alias("a"), F.greatest("x.h.doc", "x.doc").alias("b")).distinct()


def _leading(left: DataFrame, sets: DataFrame) -> DataFrame:
    """The rarest elements of each document, with their places: doc, n, sketch, label, element, place.

    Two sets of n >= m elements that are similar enough share t (n + m) at least, t = s / (1 + s). If
    the first one they share, in order of rarity, is at place p of one, counted from 0, then n - p of
    them are left, so n + m <= (n - p) / t. No element from place n - s n on can be the first.
    """
    every = left.join(sets, "doc").select("doc", "n", "sketch", "label", F.explode("elements").alias("element"))
    rare = every.groupBy("element").agg(F.count(F.lit(1)).alias("df"))
    sorted_ = every.join(rare, "element").groupBy("doc", "n", "sketch", "label").agg(F.sort_array(F.collect_list(F.struct("df", "element"))).alias("e"))
    ends = F.col("n") - F.ceil(F.lit(SIMILARITY) * F.col("n") - 1e-9) + 1
    leading = sorted_.select("doc", "n", "sketch", "label", F.posexplode(F.slice("e", F.lit(1), ends.cast("int"))).alias("place", "e"))
    return leading.where("e.df > 1").select("doc", "n", "sketch", "label", F.col("e.element").alias("element"), "place")


def _size_class(n: F.Column) -> F.Column:
    """Sizes within about 2.5 % of each other are a class."""
    return F.floor(F.log(n) * 40).cast("int")


def _across(left: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs (a, b) of documents with different labels that may be similar enough.

    left: doc, n, sketch, label. Pairs meet by an element of both and the smaller one's class of sizes:
    the larger one asks for the classes that its place of the element allows. Among the documents of
    an element, those of its main label meet only the others.
    """
    leading = written.table(_leading(left, sets), "leading")
    sizes = leading.groupBy("element", "label").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("element").agg(F.max(F.struct("size", "label")).alias("m"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    # the greatest size of a partner that may share enough
    most = (F.col("n") - F.col("place")) * F.lit((1 + SIMILARITY) / SIMILARITY) - F.col("n") + 1e-6
    mixed = leading.join(main.select("element", F.col("m.label").alias("main")), "element").withColumn("most", most)
    mixed = written.table(mixed.withColumn("other", F.col("label") != F.col("main")).drop("main", "place"), "mixed")
    smaller = mixed.where("most >= n").withColumn("class", _size_class(F.col("n")))
    least = F.lit(SIMILARITY) * F.col("n") - 1e-6
    larger = mixed.where(F.col("most") >= least).withColumn("class", F.explode(F.sequence(_size_class(least), _size_class(F.least("n", "most")))))
    fits = (F.col("y.n") <= F.col("x.n")) & (F.col("y.n") <= F.col("x.most")) & (F.col("x.n") <= F.col("y.most"))
    fits &= (F.col("x.element") == F.col("y.element")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.label") != F.col("y.label")) & _near("x", "y")
    found = None
    for x, y in ((larger.where("other"), smaller), (larger.where("not other"), smaller.where("other"))):
        pairs = x.alias("x").join(y.alias("y"), fits).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def _classed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id and digest of every row; digest, class and least doc_id of every distinct text.

    Texts are told apart by their digests, and numbered; so rows without an id, or that share one,
    are compared like all others.
    """
    signed_docs = written.table(_signed_documents(docs), "signatures")
    one = F.min_by(F.struct("n", "sketch", "bands"), "doc_id")
    any_ = F.first(F.struct("n", "sketch", "bands"))
    texts = signed_docs.groupBy("digest").agg(F.coalesce(one, any_).alias("r"), F.min("doc_id").alias("least"))
    texts = written.table(texts.select("digest", "least", "r.*", F.monotonically_increasing_id().alias("doc")), "distinct-texts")
    one = texts.where("n > 0").select("doc", "n", "sketch", F.explode("bands").alias("bucket"))
    heads = one.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = one.join(heads, "bucket")
    met = written.table(met.join(met.groupBy("doc").agg(F.sum("members").alias("degree")), "doc").drop("members"), "buckets")
    wanted = texts.select("doc", "digest").join(met.select("doc").distinct(), "doc", "left_semi")
    sources = docs.select(_digest().alias("digest"), "text").join(wanted, "digest").dropDuplicates(["doc"])
    sets = written.table(_shingle_sets(sources.select("doc", "text")), "shingle-sets")
    labels, placed = None, met.withColumn("label", F.col("doc"))
    for step in range(ROUNDS):
        found = written.table(_verified(_pivot_pairs(placed, step), sets), "links")
        labels = merged(labels, found)
        placed = written.table(met.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc")), "placed")
        if step > 1 and found.count() < FEW * placed.select("doc").distinct().count():
            break
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    left = written.table(placed.join(mixed, "bucket", "left_semi").select("doc", "n", "sketch", "label").distinct(), "left")
    more = written.table(_verified(_across(left, sets), sets), "links")
    labels = merged(labels, more)
    classed = texts.select("digest", "doc", "least").join(labels, "doc", "left").select("digest", "least", F.coalesce("label", "doc").alias("class"))
    return signed_docs.select("doc_id", "digest"), written.table(classed, "classes")


def classes(docs: DataFrame) -> DataFrame:
    """`doc_id` and `class_id` (the least doc_id of its class) for every row of `docs` (doc_id, text).

    Documents are in a class if links lead from one to the other: the same text, or texts at least
    0.8 similar. Of a text with fewer than five words all its words are one shingle; null texts
    count as empty, and texts without a word are near their exact copies only. Rows without an id, or
    that share one, are rows like all others; the class_id of a class without any id is null.
    Repeated rows each give a row. Other columns are not read.
    """
    rows, classed = _classed(docs)
    named = classed.join(classed.groupBy("class").agg(F.min("least").alias("class_id")), "class")
    return rows.join(named.select("digest", "class_id"), "digest").select("doc_id", "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of `docs` of each class, as it came in: with the least doc_id, the least text digest among
    equals, and a row with an id before one without."""
    _, classed = _classed(docs)
    first = F.min(F.struct(F.isnull("least"), "least", "digest")).alias("m")
    heads = classed.groupBy("class").agg(first).select(F.col("m.digest").alias("digest"), F.col("m.least").alias("least"))
    # in a struct, the rows' own columns clash with nothing
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), _digest().alias("digest"))
    kept = rows.alias("r").join(heads.alias("h"), (F.col("r.digest") == F.col("h.digest")) & F.col("r.id").eqNullSafe(F.col("h.least")), "left_semi")
    return kept.dropDuplicates(["digest"]).select("row.*")
