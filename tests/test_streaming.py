from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.operators import similarity as S
from answerloom.operators.duplicates import flag_new_duplicates
from answerloom.plans.standins import table, with_vectors
from answerloom.streaming.cells import CellTable
from answerloom.streaming.duplicates import REVIEW_SCHEMA, flag_arrivals, stream_duplicates

SMALL = "/root/testdata/sf0.001"


def vectors(rows):
    return rows.filter("embedding IS NOT NULL").select("id", F.col("embedding").alias("vec"))


def triples(rows):
    return {(r.entry_a_id, r.entry_b_id, r.similarity_score) for r in rows.collect()}


def test_stream_equals_batch(spark, tmp_path):
    with_vectors(table(spark, SMALL, "kb_docs")).write.parquet(str(tmp_path / "kb"))
    kb = spark.read.parquet(str(tmp_path / "kb")).filter("deleted_at IS NULL")
    arrivals, reviews, cells = (str(tmp_path / n) for n in ("arrivals", "reviews", "cells"))
    cut = kb.agg(F.percentile_approx("id", 0.7)).head()[0]
    fresh = kb.filter(F.col("id") > cut).select("id", "embedding")
    CellTable(spark, cells).create(vectors(kb))
    fresh.coalesce(1).write.mode("append").parquet(arrivals)

    def run():
        stream = spark.readStream.schema("id long, embedding array<float>").parquet(arrivals)
        stream_duplicates(stream, cells, reviews, str(tmp_path / "state")).awaitTermination()
        return triples(spark.read.parquet(reviews))

    none = spark.createDataFrame([], REVIEW_SCHEMA)
    want = triples(flag_new_duplicates(kb, fresh, none))
    assert want and run() == want

    # later arrivals add their pairs with the rest and repeat none
    later = kb.filter(F.col("id") <= cut).select("id", "embedding")
    later.coalesce(1).write.mode("append").parquet(arrivals)
    found = run()
    pairs = [(r.entry_a_id, r.entry_b_id) for r in spark.read.parquet(reviews).collect()]
    assert len(pairs) == len(set(pairs)) and want <= found


def groups(n, seed, first=0):
    """Rows (id, embedding) in eight far-apart groups."""
    rng = np.random.default_rng(seed)
    centers = np.eye(16)[:8]
    rows = []
    for i in range(n):
        v = centers[i % 8] + rng.normal(size=16) * 0.03
        rows.append((first + i, (v / np.linalg.norm(v)).astype("f4").tolist()))
    return rows


@pytest.fixture
def stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_PIVOT", 10)
    kb = spark.createDataFrame(groups(400, 1), "id long, embedding array<float>")
    made = CellTable(spark, str(tmp_path / "cells"))
    made.create(vectors(kb))
    return kb, made


def test_a_small_batch_reads_few_cells(spark, stored):
    kb, made = stored
    fresh = spark.createDataFrame([r for r in groups(80, 2, 1000) if r[0] % 8 == 3], "id long, embedding array<float>")
    visits = S.reaching(vectors(fresh), made.bounds(), 0.92)
    cells = [r.cell for r in visits.select("cell").distinct().collect()]
    read = made.near(cells)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:60]
    assert 0 < read.count() < 120
    none = spark.createDataFrame([], REVIEW_SCHEMA)
    both = kb.unionByName(fresh).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    assert triples(flag_arrivals(made, fresh, none, 0)) == triples(flag_new_duplicates(both, fresh.select("id"), none)) != set()


def test_replay_removal_and_compaction(spark, stored):
    kb, made = stored
    none = spark.createDataFrame([], REVIEW_SCHEMA)
    batch = spark.createDataFrame(groups(20, 3, 2000), "id long, embedding array<float>")
    first = triples(flag_arrivals(made, batch, none, 7))
    made.append(vectors(batch), 7)
    everything = made.bounds().number.tolist()
    assert made.near(everything).count() == 420
    assert triples(flag_arrivals(made, batch, none, 7)) == first  # what the batch added itself is passed over
    made.append(vectors(batch), 7)
    made.append(vectors(batch), 8)  # known ids are not added again
    assert made.near(everything).count() == 420
    made.remove(batch.limit(5), 9)
    assert made.near(everything).count() == 415
    before = made.version()
    assert made.compact() == before + 1 == made.version()
    assert made.near(made.bounds().number.tolist()).count() == 415
    far = np.full(16, -0.25, "f4").tolist()  # an empty reach finds nothing
    assert triples(flag_arrivals(made, spark.createDataFrame([(1, far)], "id long, embedding array<float>"), none, 10)) == set()
