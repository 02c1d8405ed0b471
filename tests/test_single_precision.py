"""Tiles are multiplied in single precision, and results are those of double precision."""

from __future__ import annotations

import numpy as np

from answerloom.operators import similarity as S


def vectors(n, seed, dims=16):
    m = np.random.default_rng(seed).normal(size=(n, dims))
    return (m / np.linalg.norm(m, axis=1)[:, None]).astype("f4")


def run(task, a, b, floor, b_ids=None, own=False):
    products = S.Products(a, b, S._norms(b).max())
    ids = np.arange(len(b)) if b_ids is None else b_ids
    found = task(np.arange(len(a)), np.full(len(a), floor), np.full(len(a), own), ids, products.rough, {"products": products})
    return [(int(x), int(y), float(s)) for c in found for x, y, s in zip(*c)]


def test_tiles_are_rough_and_hits_exact():
    a, b = vectors(200, 1), vectors(300, 2)
    exact = a.astype("f8") @ b.astype("f8").T
    assert S.Products(a, b, S._norms(b).max()).rough.dtype == np.float32
    for floor in (0.5, float(np.round(np.sort(exact.ravel())[-50], 6))):  # the second is a product itself
        got = run(S._pairs(False), a, b, floor)
        assert {(x, y) for x, y, _ in got} == set(zip(*np.nonzero(np.round(exact, 6) >= floor)))
        assert max(abs(s - exact[x, y]) for x, y, s in got) < 1e-12


def test_ties_after_rounding_go_to_the_lowest_id():
    a = vectors(40, 3)
    near = vectors(5, 4)
    b = np.repeat(near, 30, axis=0) * np.linspace(1 - 4e-7, 1, 150, dtype="f4")[:, None]  # differ by less than the sixth digit, or by more
    rank = np.round(a.astype("f8") @ b.astype("f8").T, 6)
    for k in (1, 3, 400):
        want = {(i, int(j)) for i in range(40) for j in np.lexsort((np.arange(150), -rank[i]))[:k] if rank[i, j] >= 0.1}
        assert {(x, y) for x, y, _ in run(S._top(k), a, b, 0.1)} == want


def test_zero_huge_and_broken_vectors():
    a = np.vstack([vectors(4, 5), np.zeros((1, 16), "f4"), np.full((1, 16), 1e25, "f4")])
    b = np.vstack([vectors(6, 6), np.zeros((2, 16), "f4"), np.full((1, 16), -1e20, "f4"), np.full((1, 16), np.nan, "f4")])
    exact = a.astype("f8") @ b.astype("f8").T
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.nan_to_num(np.round(exact, 6), nan=-np.inf) >= 0.0))}
    assert {(x, y) for x, y, _ in run(S._pairs(False), a, b, 0.0)} == want
    got = run(S._top(1), a[:5], b[:8], -1.0)
    assert [y for x, y, _ in got] == [int(np.lexsort((np.arange(8), -np.round(exact[i, :8], 6)))[0]) for i in range(5)]


def test_forest_connects_exactly_what_is_similar(spark):
    m = vectors(150, 7, 4)
    sims = np.round(m.astype("f8") @ m.astype("f8").T, 6)
    floor = float(np.sort(sims[np.triu_indices(150, 1)])[-60])
    edges = [(r.a, r.b) for r in S.cluster_edges(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<float>"), floor).collect()]
    assert all(sims[a, b] >= floor for a, b in edges)

    def parts(pairs):
        root = list(range(150))
        for _ in range(150):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert parts(edges) == parts([(int(a), int(b)) for a, b in zip(*np.nonzero(sims >= floor)) if a < b])
