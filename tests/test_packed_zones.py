"""Vectors meet packed, in few tiles; known pairs are left out there, texts stand as digests in joins."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from answerloom.functions import text as X
from answerloom.operators import duplicates as D, extraction as E, knowledge as KB, matching as M, similarity as S
from answerloom.operators.packed import digests, pack, unpack


def counts(n, dims, seed):
    c = np.random.default_rng(seed).poisson(0.4, (n, dims)).astype("f8")
    return (c / np.maximum(np.linalg.norm(c, axis=1)[:, None], 1e-9)).astype("f4")


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<float>")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("m", [counts(700, 256, 1), counts(3, 13, 2), np.random.default_rng(3).normal(size=(50, 64)).astype("f4"), np.array([[0.0, -0.0, np.nan, np.inf]] * 2, "f4")])
def test_packed_vectors_come_back_bit_by_bit(m):
    back = unpack(pack(m))
    assert back.shape == m.shape and (back.view("u4") == m.view("u4")).all()


def test_word_counts_are_packed_to_a_tenth():
    m = counts(1000, 256, 4)
    assert len(pack(m)) < m.nbytes / 10


def test_equal_vectors_share_a_digest():
    a = digests(np.array([[0.0, np.nan], [-0.0, -np.nan], [1e-30, np.nan]], "f4"))
    assert a[0] == a[1] != a[2]


def test_a_row_meets_every_cell_in_a_bounded_number_of_zones():
    cells = np.array([5, 1, 1000, 3, 400, 0, 90])
    for wanted in (1, 4, 9):
        zones = S._zones(cells, wanted)
        assert wanted <= len(zones.places) <= wanted + len(cells)
        ids = np.arange(2000) * 7919
        held = np.zeros(len(zones.places), int)
        for place, n in enumerate(cells):
            at = zones.of(np.full(n, place), ids[:n])
            assert all(place in zones.places[z] for z in set(at.tolist()))
            held += np.bincount(at, minlength=len(held))
        assert held.sum() == cells.sum() and held.max() <= 2.5 * cells.sum() / wanted + 5


@pytest.mark.parametrize("held", [1500, 4000])
def test_joins_in_many_zones_and_splits(spark, monkeypatch, held):
    monkeypatch.setattr(S, "ROWS_PER_PIVOT", 20)
    monkeypatch.setattr(S, "MIN_BLOCK_ROWS", 10)
    monkeypatch.setattr(S, "ZONE_BYTES", held)
    monkeypatch.setattr(S, "PAIRS_SENT", 7)
    m = counts(90, 32, 5)
    m[60:] = m[:30]
    sims = np.round(m.astype("f8") @ m.astype("f8").T, 6)
    got = [(r.a, r.b) for r in S.similar_pairs(frame(spark, m), 0.7, every_copy=True).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(90) for j in range(i + 1, 90) if sims[i, j] >= 0.7}
    best = {(r.a, r.b, r["rank"]) for r in S.top_matches(frame(spark, m[:40]), frame(spark, m), 3, 0.2).collect()}
    assert best == {(i, j, n + 1) for i in range(40) for n, j in enumerate(sorted(range(90), key=lambda j: (-sims[i, j], j))[:3]) if sims[i, j] >= 0.2}


def test_known_pairs_are_left_out_without_a_shuffle_of_pairs(spark):
    m = counts(40, 16, 6)
    kb = frame(spark, m).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    fresh = spark.createDataFrame([(i,) for i in range(0, 40, 4)], "id long")
    sims = np.round(m.astype("f8") @ m.astype("f8").T, 6)
    every = {(min(i, j), max(i, j)) for i in range(0, 40, 4) for j in range(40) if j % 4 and sims[i, j] >= 0.5}
    known = sorted(every)[::3] + [(9, 4), (None, 3)]
    reviews = spark.createDataFrame([*known, *known[:2]], "entry_a_id long, entry_b_id long")
    found = D.flag_new_duplicates(kb, fresh, reviews, 0.5)
    assert rows(found.select("entry_a_id", "entry_b_id")) == rows(spark.createDataFrame(sorted(every - set(known)), "a long, b long"))
    assert "LeftAnti" not in plan(found)  # before, all pairs were shuffled to meet the reviews


def test_texts_are_joined_by_their_digests(spark):
    asked = spark.createDataFrame([(1, 0, "what is the name"), (1, 1, "what is the name"), (1, 2, None), (2, 0, "zebra crossing")], "doc_id long, question_index long, question_text string")
    kb = M.live(spark.createDataFrame([(1, "c", "what is the name", "Ann", None), (2, "c", "what is the name", "Bob", None)], "id long, category string, question string, answer string, deleted_at timestamp_ntz"))
    from answerloom.functions.vectors import hashed_embedding

    kb = kb.withColumn("embedding", hashed_embedding("question"))
    best = M.best_match(asked, kb)
    assert rows(best.select("doc_id", "question_index", "kb_id", F.round("similarity", 3))) == [(1, 0, 1, 1.0), (1, 1, 1, 1.0), (1, 2, None, 0.0), (2, 0, 1, 0.0)]
    joins = [line for line in plan(best).splitlines() if "Join" in line]
    assert joins and not any("question_text" in line for line in joins)  # before, texts were the keys
    merged = E.merge_items(asked, asked)
    assert not any("lower" in line for line in plan(merged).splitlines() if "Join" in line)


def test_only_new_wordings_are_embedded(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def embed(text):
        seen.add(text is not None)
        return None if text is None else [float(len(text)), 1.0]

    kb = spark.createDataFrame([(1, "c", "Known", "a", None, [5.0, 1.0], None, None)], "id long, category string, question string, answer string, deleted_at timestamp_ntz, embedding array<float>, created_at timestamp_ntz, updated_at timestamp_ntz")
    records = spark.createDataFrame([(i, "c", "known" if i < 20 else f"a very new wording {i % 2}", f"b{i}") for i in range(30)], "row_no long, category string, question string, answer string")
    after, _ = KB.upsert_kb(kb, records, "2024-01-01", 1e6, embed)
    assert rows(after.select("id", "question", "answer")) == [(1, "Known", "b19"), (2, "a very new wording 0", "b28"), (3, "a very new wording 1", "b29")]
    assert seen.value == 2  # before, every record was
    assert [[round(x) for x in r.embedding] for r in after.orderBy("id").collect()] == [[5, 1], [20, 1], [20, 1]]


def test_digests_of_texts(spark):
    got = spark.createDataFrame([("a",), ("A",), (None,)], "t string").select(X.digest(F.col("t")).alias("d")).collect()
    assert len(got[0].d) == 16 and got[0].d != got[1].d and got[2].d is None
