"""Near-duplicate embeddings by int8 tile products with error bounds.

Vectors of a label are dealt into tiles of a bounded number of vectors, in the order of their place
between the label's directions. Every vector is brought to length one and rounded to int8, with the
length of what rounding lost beside it. For unit vectors u, v with roundings u', v':
|u.v - u'.v'| <= |u - u'| |v'| + |v - v'|, so the product of two tiles of integers, which is exact, bounds
every cosine from both sides. What is surely below the threshold needs no more, what is surely above is
a link, and only the cosines in between are computed again in double precision. Two tiles don't meet
at all if the angle between their middles exceeds both their radii and the threshold's angle.

From a pair of tiles come the number of links of each vector and a spanning forest of the links, never
the links themselves: a group of n near copies gives rows in proportion to n for each of its tiles.
Equal vectors of a label are one vector with a number. Components follow from the forests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import components
from .stores import written

THRESHOLD = 0.93
#: Vectors of a tile. A tile of 768 dimensions has about 4 MB, a product of two as much again.
TILE = 1024
#: Integer products of this many dimensions are exact in single precision: 127 * 127 * 1024 < 2 ** 24.
_EXACT = 1024
#: More than rounding can change a cosine computed in double precision.
_SLACK = 1e-9

_VECTOR = "label {label}, dims int, digest binary, place double, vector binary, codes binary, scale double, lost double, size double"
_TILE = "tile bigint, label {label}, dims int, n int, middle array<double>, radius double, nodes binary, times binary, vectors binary, codes binary, scales binary, losts binary, sizes binary"


def rounded(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, lengths of what is lost, and lengths of the rounded vectors, of unit vectors."""
    scale = np.maximum(np.abs(units).max(axis=1, initial=0), 1e-300) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    lost = np.linalg.norm(units - back, axis=1) + _SLACK
    return codes, scale, lost, np.linalg.norm(back, axis=1) + _SLACK


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision; first scaled by their largest part, so no square overflows."""
    largest = np.abs(vectors).max(axis=1, keepdims=True, initial=0)
    scaled = vectors / largest
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Tile:
    """The vectors of a tile: their doubles, codes and bounds."""

    def __init__(self, row: dict, side: str):
        n, dims = row[f"n_{side}"], row["dims"]
        of = lambda name, kind: np.frombuffer(row[f"{name}_{side}"], kind)
        self.nodes, self.times = of("nodes", np.int64), of("times", np.int64)
        self.vectors = of("vectors", np.float64).reshape(n, dims)
        self.codes = of("codes", np.int8).reshape(n, dims)
        self.scales, self.losts, self.sizes = of("scales", np.float64), of("losts", np.float64), of("sizes", np.float64)


def linked(a: Tile, b: Tile, threshold: float) -> np.ndarray:
    """Which vectors of `a` and `b` have a cosine of at least `threshold`, as a matrix of booleans."""
    product = np.zeros((len(a.codes), len(b.codes)))
    for k in range(0, a.codes.shape[1], _EXACT):
        product += a.codes[:, k : k + _EXACT].astype(np.float32) @ b.codes[:, k : k + _EXACT].astype(np.float32).T
    product *= a.scales[:, None]
    product *= b.scales
    bound = a.losts[:, None] * b.sizes + b.losts + _SLACK
    links = product - bound >= threshold
    x, y = np.nonzero(~links & (product + bound >= threshold))
    for k in range(0, len(x), 1 << 16):
        i, j = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
        exact = np.einsum("ij,ij->i", a.vectors[i], b.vectors[j]) >= threshold
        links[i[exact], j[exact]] = True
    return links


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a spanning forest of the links between rows and columns."""
    rows, columns = [], []
    open_rows, open_columns = links.any(axis=1), links.any(axis=0)
    while open_rows.any():
        fresh = np.array([np.argmax(open_rows)])
        open_rows[fresh] = False
        while len(fresh):
            at = np.flatnonzero(open_columns)
            near = links[np.ix_(fresh, at)]
            some = near.any(axis=0)
            new = at[some]
            rows.append(fresh[near[:, some].argmax(axis=0)])
            columns.append(new)
            open_columns[new] = False
            at = np.flatnonzero(open_rows)
            near = links[np.ix_(at, new)]
            some = near.any(axis=1)
            fresh = at[some]
            rows.append(fresh)
            columns.append(new[near[some].argmax(axis=1)] if len(fresh) else fresh)
            open_rows[fresh] = False
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(columns)


def _vectors(rows: DataFrame) -> DataFrame:
    """Row key, label and the rounded unit vector; null for a vector that can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding").cast(pa.large_list(pa.float64()))
            offsets = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)
            sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
            out = {name: [None] * batch.num_rows for name in ("dims", "digest", "place", "vector", "codes", "scale", "lost", "size")}
            for dims in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == dims)
                vectors = flat[offsets[at][:, None] + np.arange(dims)]
                # nulls have become NaN
                fine = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
                at, vectors = at[fine], vectors[fine]
                if not len(at):
                    continue
                units = unit(vectors) + 0.0  # so -0.0 is 0.0
                codes, scale, lost, size = rounded(units)
                direction = np.random.default_rng(int(dims)).standard_normal(dims)
                place = units @ direction
                for k, i in enumerate(at):
                    out["dims"][i], out["place"][i] = int(dims), place[k]
                    out["vector"][i], out["codes"][i] = units[k].tobytes(), codes[k].tobytes()
                    out["digest"][i] = hashlib.blake2b(out["vector"][i], digest_size=16).digest()
                    out["scale"][i], out["lost"][i], out["size"][i] = scale[k], lost[k], size[k]
            kinds = [pa.int32(), pa.binary(), pa.float64(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.float64()]
            columns = [pa.array(values, kind) for values, kind in zip(out.values(), kinds)]
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), *columns], ["vec_id", "label", *out])

    kinds = dict(rows.dtypes)
    schema = f"vec_id {kinds['vec_id']}, " + _VECTOR.format(label=kinds["label"])
    return rows.select("vec_id", "label", "embedding").mapInArrow(run, schema)


def _tiles(distinct: DataFrame, size: int) -> DataFrame:
    """Distinct vectors in rows of at most `size`, each of one label and of neighbouring places.

    Range partitioning by label, dimensions and place also splits a label that has many rows.
    """
    names = ["node", "times", "vector", "codes", "scale", "lost", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = []
        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field("label").type
            for row in batch.to_pylist():
                if kept and (len(kept) >= size or (row["label"], row["dims"]) != (kept[0]["label"], kept[0]["dims"])):
                    yield packed(kept, kind)
                    kept = []
                kept.append(row)
        if kept:
            yield packed(kept, kind)

    def packed(rows: list[dict], label: pa.DataType) -> pa.RecordBatch:
        raw = {name: b"".join(r[name] for r in rows) for name in ("vector", "codes")}
        raw |= {name: np.array([r[name] for r in rows], kind).tobytes() for name, kind in (("node", np.int64), ("times", np.int64), ("scale", float), ("lost", float), ("size", float))}
        vectors = np.frombuffer(raw["vector"]).reshape(len(rows), -1)
        middle = vectors.mean(axis=0)
        length = np.linalg.norm(middle)
        middle = middle / length if length > 1e-6 else np.eye(1, vectors.shape[1])[0]
        radius = float(np.arccos(np.clip((vectors @ middle).min(), -1, 1)))
        kinds = [pa.int64(), label, pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), *[pa.binary()] * 7]
        values = [rows[0]["node"], rows[0]["label"], rows[0]["dims"], len(rows), middle.tolist(), radius, *(raw[name] for name in names)]
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds)], schema=pa.schema(list(zip(columns, kinds))))

    schema = _TILE.format(label=distinct.schema["label"].dataType.simpleString())
    columns = [part.split()[0] for part in schema.split(", ")]
    dealt = distinct.repartitionByRange("label", "dims", "place", "node").sortWithinPartitions("label", "dims", "place", "node")
    return dealt.select("label", "dims", *names).mapInArrow(run, schema)


def _products(pairs: DataFrame, threshold: float) -> DataFrame:
    """For each pair of tiles: rows (node, links) and rows (node, other) of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                a, b = Tile(row, "a"), Tile(row, "b")
                links = linked(a, b, threshold)
                node, count = [], []
                if row["tile_a"] == row["tile_b"]:
                    np.fill_diagonal(links, False)
                    links |= links.T
                else:
                    node.append(b.nodes)
                    count.append(a.times @ links)
                node.append(a.nodes)
                count.append(links @ b.times)
                x, y = forest(links)
                node, count = np.concatenate([*node, a.nodes[x]]), np.concatenate([*count, np.zeros(len(x), np.int64)])
                other = pa.array([None] * (len(node) - len(x)), pa.int64())
                other = pa.concat_arrays([other, pa.array(b.nodes[y])])
                out = pa.record_batch([pa.array(node), pa.array(count), other], ["node", "links", "other"])
                yield out.filter(pa.array((count > 0) | (np.arange(len(node)) >= len(node) - len(x))))

    return pairs.mapInArrow(run, "node bigint, links bigint, other bigint")


def link_classes(rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """`vec_id`, `n_links` and `component_id` for every row of `rows` (vec_id, embedding, label).

    Two rows are linked if their labels are equal and not null, their vectors have the same number of
    dimensions, and the cosine of these is at least `threshold`. n_links counts the other rows that a row is
    linked with, its copies included; component_id is the least vec_id that links lead to, its own
    included. Rows whose label is null, or whose vector is null, empty, zero or holds a null, NaN or
    infinite number, have no link and are their own component. Rows that repeat a vec_id are rows of
    their own; one without vec_id has the least of its component, or null. Other columns are not read.
    """
    known = written.table(_vectors(rows).withColumn("row", F.monotonically_increasing_id()), "vectors")
    comparable = F.col("label").isNotNull() & F.col("digest").isNotNull()
    same = ["label", "dims", "digest"]
    first = F.min_by(F.struct("row", "place", "vector", "codes", "scale", "lost", "size"), "row").alias("v")
    # equal vectors first, so a vector that many rows repeat is compared once
    distinct = known.where(comparable).groupBy(*same).agg(first, F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least"))
    distinct = written.table(distinct.select(*same, "times", "least", "v.*").withColumnRenamed("row", "node"), "distinct-vectors")
    tiles = written.table(_tiles(distinct, tile), "tiles")
    about = tiles.select("tile", "label", "dims", "middle", "radius")
    a, b = (about.select("label", "dims", *(F.col(c).alias(f"{c}_{x}") for c in ("tile", "middle", "radius"))) for x in "ab")
    cosine = F.aggregate(F.zip_with("middle_a", "middle_b", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) - F.col("radius_a") - F.col("radius_b")
    near = (F.col("tile_a") == F.col("tile_b")) | (apart <= float(np.arccos(threshold)) + 1e-6)
    met = a.join(b, ["label", "dims"]).where("tile_a <= tile_b").where(near).select("tile_a", "tile_b", "dims")
    data = ["n", "nodes", "times", "vectors", "codes", "scales", "losts", "sizes"]
    for side in "ab":
        met = met.join(tiles.select(F.col("tile").alias(f"tile_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in data)), f"tile_{side}")
    found = written.table(_products(met, threshold), "products")
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct())
    joined = distinct.select("digest", "label", "dims", "node", "times", "least").join(labels.select(F.col("doc").alias("node"), F.col("label").alias("class")), "node", "left")
    joined = written.table(joined.withColumn("class", F.coalesce("class", "node")), "classed")
    heads = joined.groupBy("class").agg(F.min("least").alias("head"))
    counted = joined.join(heads, "class").join(links, "node", "left")
    counted = counted.select(*same, (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "head")
    linked_rows = known.where(comparable).select("vec_id", *same).join(counted, same).select("vec_id", "links", "head")
    alone = known.where(~comparable).select("vec_id", F.lit(0).cast("bigint").alias("links"), F.col("vec_id").alias("head"))
    return linked_rows.unionByName(alone).select("vec_id", F.col("links").alias("n_links"), F.col("head").alias("component_id"))
