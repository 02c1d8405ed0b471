from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.functions import vectors as V
from answerloom.operators import similarity as S
from answerloom.operators.components import connected_components
from answerloom.operators.ranking import with_positions


def make_vectors(n, dims=16, groups=5, seed=1, hot=0.33):
    """Unit vectors in groups; a third of all rows are near copies of one vector,
    some rows are exact copies, some are zero."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dims))
    rows = []
    for i in range(n):
        if rng.random() < hot:
            v = centers[0] + rng.normal(size=dims) * 0.05
        elif rng.random() < 0.2 and rows:
            rows.append(rows[rng.integers(len(rows))])
            continue
        else:
            v = centers[rng.integers(groups)] + rng.normal(size=dims) * 0.6
        rows.append((v / np.linalg.norm(v)).astype("f4"))
    rows[3] = np.zeros(dims, dtype="f4")
    return np.array(rows)


def frame(spark, matrix, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(matrix)], "id long, embedding array<float>")


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_PIVOT", 25)
    monkeypatch.setattr(S, "MIN_BLOCK_ROWS", 20)


@pytest.mark.parametrize("threshold, block", [(0.9, 16 << 20), (0.99, 640), (0.5, 16 << 20)])
def test_pairs_equal_brute_force(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    m = make_vectors(300)
    lowest = {}
    for i, v in enumerate(m):
        lowest.setdefault(v.tobytes(), i)
    rep = [lowest[v.tobytes()] for v in m]
    sims = np.round(m.astype("f8") @ m.astype("f8").T, 6)
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if rep[a] == a and rep[b] == b and sims[a, b] >= threshold}
    want |= {(rep[b], b) for b in range(300) if rep[b] != b and sims[b, b] >= threshold}
    got = [(r.a, r.b) for r in S.similar_pairs(frame(spark, m), threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def roots_of(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("threshold", [0.6, 0.9, 0.98])
def test_cluster_edges_connect_what_all_pairs_connect(spark, threshold):
    m = make_vectors(300, seed=2)
    sims = np.round(m.astype("f8") @ m.astype("f8").T, 6)
    a, b = np.nonzero(np.triu(sims >= threshold, 1))
    want = roots_of(300, zip(a, b))
    edges = S.cluster_edges(frame(spark, m), threshold)
    # only similar pairs, and where most rows are alike far fewer than all of them;
    # with blocks this small the bound per pair of blocks is loose
    found = {(r.a, r.b) for r in edges.collect()}
    assert found <= set(zip(a.tolist(), b.tolist()))
    if threshold == 0.6:
        assert len(found) < len(a) / 4
    got = {r.id: r.root for r in connected_components(edges).collect()}
    assert got == {i: r for i, r in enumerate(want) if want.count(r) > 1}


@pytest.mark.parametrize("k, cutoff, block", [(1, -1.0, 16 << 20), (3, 0.35, 640), (3, 0.9, 16 << 20)])
def test_top_matches_equal_brute_force(spark, monkeypatch, k, cutoff, block):
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    left, right = make_vectors(90, seed=3), make_vectors(200, seed=4)
    sims = np.round(left.astype("f8") @ right.astype("f8").T, 6)
    want = set()
    for i in range(90):
        order = sorted(range(200), key=lambda j: (-sims[i, j], j))[:k]
        want |= {(i, 500 + j, r + 1) for r, j in enumerate(order) if sims[i, j] >= cutoff}
    got = {(r.a, r.b, r["rank"]) for r in S.top_matches(frame(spark, left), frame(spark, right, 500), k, cutoff).collect()}
    assert got == want


def clustered(n, dims, groups, seed):
    """Sparse rows of word buckets: few buckets each, groups apart."""
    rng = np.random.default_rng(seed)
    rows = np.zeros((n, dims), "f8")
    for i in range(n):
        group = i % groups
        rows[i, rng.choice(np.arange(group * dims // groups, (group + 1) * dims // groups), 5, replace=False)] = rng.integers(1, 4, 5)
        rows[i, rng.integers(dims)] += 1
    return (rows / np.linalg.norm(rows, axis=1)[:, None]).astype("f4")


@pytest.mark.parametrize("k, cutoff", [(1, -1.0), (3, 0.35)])
def test_best_matches_visit_few_cells(spark, k, cutoff):
    left, right = clustered(60, 64, 8, 1), clustered(400, 64, 8, 2)
    a, b = (S._vectors(frame(spark, m), "id", "embedding") for m in (left, right))
    index = S.build_index(b)
    size = dict(zip(index.bounds.cells["cell"], index.bounds.cells["rows"]))
    near = S.home_visits(a, index.bounds, cutoff).select("id", "cell").collect()
    sims = np.round(left.astype("f8") @ right.astype("f8").T, 6)
    home = {r.id: r.cell for r in near}
    cells = {r.id: r.cell for r in index.rows.select("id", "cell").collect()}
    floors = []
    for i in range(60):
        there = sorted((sims[i, j] for j in range(400) if cells[j] == home[i]), reverse=True)[:k]
        floors.append((i, left[i].tolist(), float(max(cutoff, there[-1]) if len(there) == k else cutoff)))
    far = S.further_visits(spark.createDataFrame(floors, "id long, vec array<float>, floor double"), index.bounds).select("id", "cell").collect()
    compared = sum(size[r.cell] for r in near) + sum(size[r.cell] for r in far)
    assert compared < 0.6 * 60 * 400
    want = set()
    for i in range(60):
        order = sorted(range(400), key=lambda j: (-sims[i, j], j))[:k]
        want |= {(i, j, r + 1) for r, j in enumerate(order) if sims[i, j] >= cutoff}
    got = {(r.a, r.b, r["rank"]) for r in S.top_matches(frame(spark, left), frame(spark, right), k, cutoff).collect()}
    assert got == want


def test_bounds_hold_for_every_row(spark):
    m = make_vectors(300, seed=8)
    m[7] *= 3
    index = S.build_index(S._vectors(frame(spark, m), "id", "embedding"), 0.9)
    cells = {r.id: r.cell for r in index.rows.select("id", "cell").collect()}
    upper = index.bounds.upper(m.astype("f8"))
    place = {c: n for n, c in enumerate(index.bounds.number)}
    for j in range(300):
        assert (m.astype("f8") @ m[j].astype("f8") <= upper[:, place[cells[j]]]).all()


def test_empty_sides(spark):
    empty = spark.createDataFrame([], "id long, embedding array<float>")
    some = frame(spark, make_vectors(5))
    assert S.similar_pairs(empty, 0.9).count() == 0
    assert S.top_matches(some, empty, 1).count() == 0
    assert S.pairs_between(empty, some, 0.5).count() == 0


def test_components_on_random_graphs(spark):
    random.seed(5)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(700, i) for i in range(701, 760)]
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots_of(800, [e for e in edges if e[0] != e[1]])
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}


def test_codec_and_default_embedding(spark):
    df = spark.createDataFrame([("Hello hello world",), ("",), (None,)], "t string").select("t", V.hashed_embedding("t").alias("v"))
    rows = df.select("t", "v", V.decode_vector(V.encode_vector("v")).alias("back"), F.octet_length(V.encode_vector("v"))).collect()
    assert rows[0].v == rows[0].back and rows[0][3] == 4 * V.HASHED_DIMENSIONS
    assert abs(sum(x * x for x in rows[0].v) - 1) < 1e-6 and sum(rows[1].v) == 0 and rows[2].v is None


def test_model_embedding_runs_per_batch(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([("ab",), (None,), ("abc",)], "t string").select(V.model_embedding(load)("t").alias("v"))
    assert [r.v for r in df.collect()] == [[2.0, 1.0], None, [3.0, 1.0]]


def test_positions_across_ranges(spark):
    df = spark.createDataFrame([(g, o) for g in range(3) for o in range(g, 100, g + 1)], "g int, o long")
    got = with_positions(df, ["g"], "o", width=7).collect()
    for g in range(3):
        mine = sorted((r.o, r.position) for r in got if r.g == g)
        assert [p for _, p in mine] == list(range(1, len(mine) + 1))
