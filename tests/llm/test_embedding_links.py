"""Embedding links and components against brute force."""

import numpy as np
import pytest

from fixhound.llm import embedding_links as links

SCHEMA = "vec_id bigint, embedding array<double>, label int, n_links string, component_id string, row int"


def vectors_around(seed, n, dims, spread):
    """Vectors near a few directions, so that many cosines are close to the threshold."""
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((max(n // 12, 1), dims))
    return (centre[rng.integers(0, len(centre), n)] + spread * rng.standard_normal((n, dims))) * rng.uniform(0.01, 50, (n, 1))


def brute(rows, threshold=links.THRESHOLD):
    usable = [v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (i, j))
                linked[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = set(np.flatnonzero(linked[todo.pop()]).tolist()) - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], int(linked[i].sum()), min(ids, default=None)))
    return sorted(out, key=str)


def result(spark, rows, **options):
    table = spark.createDataFrame([(i, v, label, "x", "y", 3) for i, v, label in rows], SCHEMA)
    return sorted(map(tuple, links.link_classes(table.repartition(3), **options).collect()), key=str)


def test_links_equal_brute_force_over_many_tiles(spark):
    rows = [(1000 - k, v.tolist(), k % 3) for k, v in enumerate(vectors_around(1, 300, 16, 0.27))]
    assert result(spark, rows, tile=17) == brute(rows)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0, 3.0]
    rows = [
        *[(10 - k, one, 1) for k in range(4)],
        (20, [2.0, 4.0, 6.0], 1),
        (21, [1e300, 2e300, 3e300], 1),
        (22, [1e-300, 2e-300, 3e-300], 1),
        (23, one, 2),
        (24, one, None),
        (25, one, None),
        (26, [1.0, 2.0], 1),
        (27, [0.0, -0.0, 0.0], 1),
        (28, [nan, 2.0, 3.0], 1),
        (29, [inf, 2.0, 3.0], 1),
        (30, [None, 2.0, 3.0], 1),
        (31, None, 1),
        (32, [], 1),
        (None, one, 1),
        (None, [3.0, -1.0, 0.0], 1),
        (5, [-1.0, -2.0, -3.0], 1),
        (5, [-1.0, -2.0, -3.1], 1),
        (5, [3.0, -1.0, 0.1], 1),
    ]
    assert result(spark, rows) == brute(rows)
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert links.link_classes(empty).count() == 0


def test_bounds_hold_and_few_cosines_are_computed_again():
    rng = np.random.default_rng(4)
    for dims in (1, 3, 64, 1500):
        units = links.unit(vectors_around(dims, 80, dims, 0.3))
        codes, scale, lost, size = links.rounded(units)
        rough = (codes.astype(float) @ codes.astype(float).T) * scale[:, None] * scale
        assert (np.abs(rough - units @ units.T) <= lost[:, None] * size + lost).all()
    near = rng.standard_normal(64)
    a, b = (np.stack([near + s * rng.standard_normal(64) for s in rng.uniform(0, 0.5, 500)]) for _ in range(2))
    units = links.unit(np.concatenate([a, b]))
    codes, scale, lost, size = links.rounded(units)
    assert (lost < 0.02).all()


def test_forest_spans_the_links():
    rng = np.random.default_rng(5)
    for _ in range(50):
        table = rng.random((rng.integers(1, 30), rng.integers(1, 30))) < rng.random() * 0.2
        rows, columns = links.forest(table)
        assert table[rows, columns].all()
        parent = list(range(sum(table.shape)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in zip(rows, columns):
            assert root(i) != root(table.shape[0] + j)
            parent[root(i)] = root(table.shape[0] + j)
        assert all(root(i) == root(table.shape[0] + j) for i, j in zip(*np.nonzero(table)))


@pytest.mark.parametrize("copies", [500])
def test_a_group_of_near_copies_gives_few_rows(spark, copies):
    base = np.random.default_rng(6).standard_normal(8)
    rows = [(k, (base + 0.001 * np.random.default_rng(k).standard_normal(8)).tolist(), 1) for k in range(copies)]
    assert result(spark, rows, tile=64) == sorted([(k, copies - 1, 0) for k in range(copies)], key=str)
