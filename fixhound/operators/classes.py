"""Classes of similar files within a corpus: files of a class are copies, or similar by word shingles.

Two texts are similar if the Jaccard similarity of their sets of three-word shingles is high enough;
a class is what such links hold together. Candidates meet in buckets:

- by the rarest shingles of each (prefix filter). Of two similar sets in the same order, the first
  shingle that both have stands near the front of both. Any order will do that is the same for all
  texts: shingles that some thousand texts repeat are counted, the most frequent of them come last.
- by bands of a MinHash signature, the least hash of the shingles for each of many seeds.

A bucket is never multiplied out. All of it is compared with one text, that which shares most
buckets with others; those linked are one class. What still differs after some steps is compared
across classes only, and where the places of the first common shingle allow enough similarity;
this goes by the rarest shingles in either case, so no link is left out.
Exact copies are one text, so a class of a million copies is compared once.

Nothing that grows with the files goes through the driver or a broadcast at once: pairs are looked up
in the texts some at a time, and neither texts nor whole sets are stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixhound.operators import shingle_sets
from fixhound.operators.shingle_sets import Sets
from fixhound.operators.spread import durable, stored

MIN_JACCARD = 0.8
#: At a similarity of 0.8, a pair shares no band once in 1,600.
BANDS, BAND_ROWS = 14, 4
#: Steps at most; none after one that links no more than this share of the texts.
STEPS, FEW = 4, 0.001
#: Shingles that are told apart by how often they occur, and pairs that are looked up at once: both are collected
#: and broadcast, at 10 and 16 bytes each.
COMMON, PAIRS = 1 << 20, 1 << 20
_MOST = (1 << 16) - 1


def _contents(files: DataFrame, *more: F.Column) -> DataFrame:
    """`doc`, further columns, and the text as its shingles are read."""
    return files.select(F.col("file_id").alias("doc"), *more, F.lower(F.coalesce("content", F.lit(""))).alias("content"))


def common_shingles(sets: DataFrame) -> Broadcast:
    """The shingles that most texts have, of those that come twice in some thousand texts: hashes in order, numbers."""
    twice = sets.mapInArrow(shingle_sets.repeated, "shingle bigint, n bigint")
    counted = stored(twice.groupBy("shingle").agg(F.least(F.sum("n"), F.lit(_MOST)).cast("int").alias("n")))
    held, least = 0, None
    for n, rows in sorted(counted.groupBy("n").count().collect(), reverse=True):
        held += rows
        if held > COMMON:
            break
        least = n
    table = (counted.where(F.col("n") >= least) if least else counted.limit(0)).toArrow()
    hashes, numbers = table.column("shingle").to_numpy(), table.column("n").to_numpy().astype(np.uint16)
    order = np.argsort(hashes)
    return sets.sparkSession.sparkContext.broadcast((hashes[order], numbers[order]))


def marked(sets: DataFrame, min_jaccard: float | None, bands: int = 0, rows: int = BAND_ROWS) -> DataFrame:
    """In place of texts or shingles: their number `n`; for a similarity `lead`, those that may be the first in common,
    and parities `odd`; for bands `buckets`."""
    made: dict[str, Callable[[Sets], pa.Array]] = {"n": lambda s: pa.array(s.sizes().astype(np.int32))}
    kept = [f for f in sets.schema.fields if f.name not in ("content", "shingles")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "n int"])
    if min_jaccard is not None:
        made["lead"] = shingle_sets.leads(common_shingles(sets), min_jaccard)
        made["odd"] = shingle_sets.parities
        schema += ", lead array<bigint>, odd array<bigint>"
    if bands:
        made["least"] = _least(bands * rows)
        schema += ", least array<bigint>"
    columns = sets.select(*[f.name for f in kept], "content" if "content" in sets.columns else "shingles")
    out = columns.mapInArrow(shingle_sets.with_columns(made), schema)
    if bands:
        keys = [F.xxhash64(F.lit(b), *[F.get("least", F.lit(b * rows + r)) for r in range(rows)]) for b in range(bands)]
        out = out.withColumn("buckets", F.array(*keys)).drop("least")
    return out


def distinct_texts(files: DataFrame, min_jaccard: float = MIN_JACCARD, bands: int = 0) -> DataFrame:
    """`doc` (the least file of a text), `n_files`, and what `marked` makes of the text."""
    digest = F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest")
    every = marked(_contents(files, digest), min_jaccard, bands)
    columns = [c for c in every.columns if c not in ("doc", "digest")]
    texts = every.groupBy("digest").agg(F.min("doc").alias("doc"), F.count("*").alias("n_files"), F.first(F.struct(*columns)).alias("of"))
    return texts.where("doc IS NOT NULL").select("doc", "n_files", "of.*")


def _shared(placed: DataFrame) -> DataFrame:
    """Rows of buckets that more than one has, with the number of `members`."""
    members = F.count("*").over(Window.partitionBy("bucket"))
    return placed.withColumn("members", members).where("members > 1")


def by_rarest(sets: DataFrame, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """`doc, n, bucket, place, members`: the shingles of a text, rarest first, that can be the first common one.

    Two similar sets of n and m share at least (n + m) t, t = s / (1 + s), and at most n - place if the
    first common one is at `place`; m is at least s n. `sets` has `shingles`, or is marked.
    """
    led = sets if "lead" in sets.columns else marked(sets.select("doc", "shingles"), min_jaccard)
    return _shared(led.select("doc", "n", F.posexplode("lead").alias("place", "bucket")).select("doc", "n", "bucket", "place"))


def _most(min_jaccard: float) -> F.Column:
    """The size of the largest text that can be similar to one whose first shingle in common is at `place`."""
    return (F.col("n") - F.col("place")) * F.lit((1 + min_jaccard) / min_jaccard) - F.col("n") + F.lit(1e-6)


def _with_partner(placed: DataFrame, min_jaccard: float) -> DataFrame:
    """Rows of `by_rarest` without those that no other text of their bucket can be similar to, by size and place.

    In order of size, the next larger text is the first that can be, and the next smaller one is nearest to
    that; where there are but two, each knows the other's place.
    """
    by_size = Window.partitionBy("bucket").orderBy("n")
    sized = placed.withColumn("most", _most(min_jaccard)).withColumns(
        {f"{side}_{c}": shift(c).over(by_size) for side, shift in (("small", F.lag), ("large", F.lead)) for c in ("n", "most")}
    )
    least = F.lit(min_jaccard) * F.greatest("n", "large_n") - F.lit(1e-6)
    larger = (F.col("n") >= least) & (F.col("large_n") <= F.col("most"))
    smaller = F.col("small_n") >= F.lit(min_jaccard) * F.col("n") - F.lit(1e-6)
    both = F.when(F.col("large_n").isNotNull(), F.col("n") <= F.col("large_most")).otherwise(
        (F.col("n") <= F.col("small_most")) & (F.col("small_n") <= F.col("most"))
    )
    fits = F.coalesce(larger, F.lit(False)) | F.coalesce(smaller, F.lit(False))
    return sized.where(fits & ((F.col("members") > 2) | both)).select(*placed.columns)


_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def seeded(hashes: np.ndarray, seeds: int) -> Iterator[np.ndarray]:
    """`xxhash64(hash, seed)` as Spark gives it, for each seed; the part before the seed is computed once."""
    with np.errstate(over="ignore"):
        first = (np.uint64(42) + _P5 + np.uint64(8)) ^ (_turned(hashes.view(np.uint64) * _P2, 31) * _P1)
        begun = _mixed(_turned(first, 27) * _P1 + _P4) + _P5 + np.uint64(4)
        for seed in range(seeds):
            yield _mixed(_turned(begun ^ (np.uint64(seed) * _P1), 23) * _P2 + _P3).view(np.int64)


def _least(seeds: int, gathered: int = 1 << 16) -> Callable[[Sets], pa.Array]:
    """The least hash of each set for each seed, some sets at a time; 0 where a set is empty."""

    def made(sets: Sets) -> pa.Array:
        least = np.zeros((len(sets.offsets) - 1, seeds), np.int64)
        full = np.flatnonzero(sets.sizes())
        starts, ends = sets.offsets[full], sets.offsets[full + 1]
        begin = 0
        while begin < len(full):
            end = max(begin + 1, int(np.searchsorted(ends, starts[begin] + gathered, "right")))
            part = sets.hashes[starts[begin] : ends[end - 1]]
            for seed, values in enumerate(seeded(part, seeds)):
                least[full[begin:end], seed] = np.minimum.reduceat(values, starts[begin:end] - starts[begin])
            begin = end
        return pa.ListArray.from_arrays(pa.array(np.arange(len(least) + 1, dtype=np.int32) * seeds), pa.array(least.ravel()))

    return made


def _signatures(seeds: int, gathered: int = 1 << 16):
    """For `mapInArrow`: the rows with their sets' signatures."""
    return shingle_sets.with_columns({"least": _least(seeds, gathered)})


def by_bands(sets: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """`doc, n, bucket, members`: hashes of the bands of a text's MinHash signature, with what at least two share.

    `sets` has `shingles`, or is marked.
    """
    signed = sets if "buckets" in sets.columns else durable(marked(sets.select("doc", "shingles"), None, bands, rows))
    return _shared(signed.where("n > 0").select("doc", "n", F.explode("buckets").alias("bucket")))


def _possible(pairs: DataFrame, texts: DataFrame, min_jaccard: float) -> DataFrame:
    """The pairs `(a, b)` whose parities don't differ in more bits than the sets of similar texts can in elements.

    Sets of n and m with a similarity of s differ in (n + m) (1 - s) / (1 + s) elements, and each of these
    turns one bit over, so no similar pair is left out. Of unequal parities the longer one is folded first.
    """
    for x in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"odd{x}")), x)
    words = F.least(F.size("odda"), F.size("oddb"))
    xor = lambda x, y: x.bitwiseXOR(y)
    folded = [
        F.when(F.size(odd) > words, F.zip_with(F.slice(odd, F.lit(1), words), F.slice(odd, words + 1, words), xor)).otherwise(F.col(odd))
        for odd in ("odda", "oddb")
    ]
    bits = F.aggregate(F.zip_with(*folded, lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda total, x: total + x)
    most = (F.col("na") + F.col("nb")) * F.lit((1 - min_jaccard) / (1 + min_jaccard)) + F.lit(1e-6)
    return pairs.where(F.coalesce(bits <= most, F.lit(True))).select("a", "b").distinct()


def _similar(pairs: DataFrame, texts: DataFrame, files: DataFrame, min_jaccard: float) -> DataFrame:
    """Those of the pairs `(a, b)` whose texts are similar, in any order."""
    pairs = durable(_possible(pairs, texts, min_jaccard))
    parts = -(-pairs.count() // PAIRS)
    contents = _contents(files).where("doc IS NOT NULL")
    links = pairs.limit(0)
    for part in range(parts):
        some = pairs if parts == 1 else pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == part)
        links = links.unionByName(_compared(some, contents, min_jaccard))
    return durable(links)


def _compared(pairs: DataFrame, texts: DataFrame, min_jaccard: float) -> DataFrame:
    """The same for pairs that fit a broadcast: of each, the set of the text with fewer pairs goes to the other one."""
    context, table = texts.sparkSession.sparkContext, pairs.select("a", "b").toArrow()
    a, b = (table.column(c).to_numpy() for c in ("a", "b"))
    _, which, times = np.unique(np.concatenate([a, b]), return_inverse=True, return_counts=True)
    swapped = times[which[: len(a)]] < times[which[len(a) :]]
    one, other = np.where(swapped, b, a), np.where(swapped, a, b)
    order = np.argsort(other, kind="stable")
    sent = texts.mapInArrow(shingle_sets.sent_to(context.broadcast((other[order], one[order]))), "doc bigint, one bigint, shingles array<bigint>")
    held = texts.mapInArrow(shingle_sets.held_by(context.broadcast(np.unique(one))), "one bigint, held array<bigint>")
    common = F.size(F.array_intersect("shingles", "held"))
    jaccard = common / (F.size("shingles") + F.size("held") - common)
    return sent.join(held, "one").where(jaccard >= min_jaccard).select(F.col("doc").alias("a"), F.col("one").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """`doc, label` of all documents of the links `(a, b)`: the least document that links lead to.

    Labels go along links and from label to label, so the number of rounds grows with the
    logarithm of a chain's length.
    """
    both = durable(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("doc").alias("b"), "label"), "b").groupBy(F.col("a").alias("doc")).agg(
            F.min("label").alias("seen")
        )
        lower = labels.join(seen, "doc").select("doc", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("doc").alias("label"), F.col("label").alias("next"))
        new = durable(lower.join(jump, "label").select("doc", "old", F.least("label", "next").alias("label")))
        labels = new.select("doc", "label")
        if new.where("label < old").isEmpty():
            return labels


def _with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels of all documents after more links, which are drawn between labels."""
    for x in ("a", "b"):
        links = links.join(labels.select(F.col("doc").alias(x), F.col("label").alias(f"l{x}")), x)
    drawn = durable(links.where("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    if drawn.isEmpty():
        return labels
    over = components(drawn).select(F.col("doc").alias("label"), F.col("label").alias("least"))
    return durable(labels.join(over, "label", "left").select("doc", F.coalesce("least", "label").alias("label")))


def _with_one(placed: DataFrame, step: int, min_jaccard: float) -> DataFrame:
    """Pairs of a bucket's documents with one of it that has another label and is not too large or small.

    First the one with most neighbours in buckets, then of the main label and of the others by turns.
    """
    sizes = placed.groupBy("bucket", "label").agg(F.count("*").alias("size"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("size", "label")).alias("m"), F.count("*").alias("labels"))
    main = main.where("labels > 1").select("bucket", F.col("m.label").alias("main"))
    mixed = placed.join(main, "bucket")
    if step:
        chosen = mixed.where(F.col("label") != F.col("main") if step % 2 else F.col("label") == F.col("main"))
    else:
        chosen = mixed
    turn = F.col("degree") if step < 2 else F.xxhash64("doc", F.lit(step))
    ones = chosen.groupBy("bucket").agg(F.max(F.struct(turn.alias("turn"), "doc", "label", "n")).alias("one"))
    met = mixed.join(ones, "bucket").where(F.col("label") != F.col("one.label"))
    met = met.where(F.least("n", "one.n") >= F.lit(min_jaccard) * F.greatest("n", "one.n") - F.lit(1e-6))
    return met.select(F.least("doc", "one.doc").alias("a"), F.greatest("doc", "one.doc").alias("b")).distinct()


def _across(placed: DataFrame, min_jaccard: float) -> DataFrame:
    """All pairs of documents with different labels that may be similar, by their places in a bucket.

    The larger text asks for the classes of sizes that its place allows, the smaller one stands in its own.
    Documents of a bucket's main label meet only the others.
    """
    sizes = placed.groupBy("bucket", "label").agg(F.count("*").alias("size"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("size", "label")).alias("m"), F.count("*").alias("labels"))
    main = main.where("labels > 1").select("bucket", F.col("m.label").alias("main"))
    mixed = placed.join(main, "bucket").withColumn("most", _most(min_jaccard)).withColumn("other", F.col("label") != F.col("main"))
    mixed = stored(mixed.select("bucket", "doc", "n", "label", "most", "other"))
    # at 0.8, a text asks for two classes of sizes at most
    kind = lambda n: F.floor(F.log(n) * 4).cast("int")
    least = F.lit(min_jaccard) * F.col("n") - F.lit(1e-6)
    small = mixed.where("most >= n").withColumn("kind", kind(F.col("n")))
    large = mixed.where(F.col("most") >= least).withColumn("kind", F.explode(F.sequence(kind(least), kind(F.least("n", "most")))))
    fits = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.kind") == F.col("y.kind")) & (F.col("x.label") != F.col("y.label"))
    fits &= (F.col("y.n") <= F.col("x.n")) & (F.col("y.n") <= F.col("x.most")) & (F.col("x.n") <= F.col("y.most"))
    pairs = None
    for x, y in ((large.where("other"), small), (large.where("NOT other"), small.where("other"))):
        found = x.alias("x").join(y.alias("y"), fits)
        found = found.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs.distinct()


def similar_classes(files: DataFrame, min_jaccard: float = MIN_JACCARD, exact: bool = True) -> DataFrame:
    """`class_id, n_texts, n_files`, a row per class of files `(file_id, content)`.

    class_id is the least file of the class; texts of fewer than three words are similar to their copies only,
    null counts as empty. With `exact=False`, the first candidates come from MinHash bands; what still differs
    is compared by the rarest shingles as well, so the classes are the same. A file_id on k rows counts k k times.
    """
    texts = stored(distinct_texts(files, min_jaccard, 0 if exact else BANDS))
    rarest = stored(_with_partner(by_rarest(texts, min_jaccard), min_jaccard))
    met = rarest if exact else stored(by_bands(texts))
    degree = met.groupBy("doc").agg(F.sum("members").alias("degree"))
    met = stored(met.join(degree, "doc"))
    labels = texts.select("doc", F.col("doc").alias("label")).distinct()
    n_texts = texts.count()
    for step in range(STEPS):
        links = _similar(_with_one(met.join(labels, "doc"), step, min_jaccard), texts, files, min_jaccard)
        found = links.count()
        if found:
            labels = _with_links(labels, links)
        if step and found <= FEW * n_texts:
            break
    labels = _with_links(labels, _similar(_across(rarest.join(labels, "doc"), min_jaccard), texts, files, min_jaccard))
    rows = files.groupBy(F.col("file_id").alias("doc")).agg(F.count("*").alias("rows"))
    counts = texts.groupBy("doc").agg(F.count("*").alias("texts"), F.sum("n_files").alias("files")).join(rows, "doc")
    times = F.col("texts") * F.col("rows")
    counts = counts.select("doc", (times * times).alias("n_texts"), (F.col("files") * F.col("rows") * times).alias("n_files"))
    return labels.join(counts, "doc").groupBy(F.col("label").alias("class_id")).agg(
        F.sum("n_texts").alias("n_texts"), F.sum("n_files").alias("n_files")
    )
