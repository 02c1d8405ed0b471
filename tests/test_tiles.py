"""Tiles, visits and copies stay bounded, and results stay those of brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from answerloom.operators import similarity as S


def vectors(n, seed, dims=8):
    m = np.random.default_rng(seed).normal(size=(n, dims))
    return (m / np.linalg.norm(m, axis=1)[:, None]).astype("f4")


def frame(spark, ids, matrix):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, matrix)], "id long, embedding array<float>")


def test_copies_of_entries_are_compared_once(spark):
    some, asked = vectors(12, 1), vectors(9, 2)
    ids = np.arange(600)
    right = frame(spark, ids, some[ids % 12])
    sims = np.round(asked.astype("f8") @ some.astype("f8").T, 6)
    for k in (1, 3):
        kept = S._lowest_copies(S._vectors(right, "id", "embedding"), k)
        assert kept.count() == 12 * k and sorted(kept.columns) == ["id", "vec"]
        got = {(r.a, r.b, r["rank"]) for r in S.top_matches(frame(spark, range(9), asked), right, k).collect()}
        assert got == {(i, j, r + 1) for i in range(9) for r, j in enumerate(sorted(range(600), key=lambda j: (-sims[i, j % 12], j))[:k])}


def test_products_of_a_tile_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE_PRODUCTS", 64)
    sizes = spark.sparkContext.accumulator(0)
    pairs = S._pairs

    def watched(same):
        task = pairs(same)

        def run(a_ids, floor, own, b_ids, sims, state):
            sizes.add(int(sims.size > max(64, sims.shape[1])))
            return task(a_ids, floor, own, b_ids, sims, state)

        return run

    monkeypatch.setattr(S, "_pairs", watched)
    m = vectors(90, 3)
    sims = np.round(m.astype("f8") @ m.astype("f8").T, 6)
    got = {(r.a, r.b) for r in S.similar_pairs(frame(spark, range(90), m), 0.5).collect()}
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if sims[i, j] >= 0.5}
    assert sizes.value == 0


def test_parts_of_short_vectors_are_no_larger(spark):
    assert S._part_rows(10_000_000, 64, 8) == S._part_rows(10_000_000, 256, 8) == S.MAX_PART_ROWS
    assert S._part_rows(10_000_000, 1024, 8) < S.MAX_PART_ROWS


def test_visits_are_chosen_in_slices(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_ROWS", 7)
    m = vectors(50, 4)
    rows = S._vectors(frame(spark, range(50), m), "id", "embedding").withColumn("floor", F.col("id").cast("double")).coalesce(1)
    largest = spark.sparkContext.accumulator(0)

    def choose(columns, vecs):
        largest.add(int(len(vecs) > 7 or len(columns["floor"]) != len(vecs)))
        return np.ones((len(vecs), 2), bool), np.array([0, 2]), np.full(len(vecs), -1)

    got = [(r.id, r.floor, r.cell) for r in S._visits(rows, choose).collect()]
    assert sorted(got) == [(i, float(i), c) for i in range(50) for c in (0, 2)]
    assert largest.value == 0
