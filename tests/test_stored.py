"""Stored tables: compressed, freed of their shuffles, and of no size that a plan could trust."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from answerloom import session
from answerloom.operators import inference as I
from answerloom.session import durable


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parsed_decisions_are_not_broadcast_for_the_size_of_their_files(spark):
    """Before, their compressed files looked small enough, however many rows they held."""
    content = '{"decisions": [{"id": "q_0", "action": "answer", "answer": "same", "confidence": 0.5, "reason": "r"}]}'
    responses = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("chunk_no"), F.lit(content).alias("content"))
    items = durable(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("question_index"), F.lit("t").alias("question_text")))
    decisions, failed = I.normalize_decisions(responses, items)
    assert "BroadcastHashJoin" not in plan(decisions) and "BroadcastHashJoin" not in plan(items.join(failed, "doc_id", "left"))
    assert decisions.count() == 20_000 and failed.filter("failed_chunks = 0").count() == 20_000


def shuffles(spark) -> int:
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(f.startswith("shuffle_") for d in manager.localDirsString() for _, _, files in os.walk(d) for f in files)


def size(at: str) -> int:
    at = at.removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(at) for f in files)


def test_a_stored_table_leaves_no_shuffle_and_little_on_disk(spark):
    before = shuffles(spark)
    rows = spark.range(50_000).select((F.col("id") % 5000).alias("k"), F.array_repeat(F.lit(0.5).cast("float"), 256).alias("v")).repartition(4, "k")
    kept = durable(rows)
    until = time.time() + 20
    while shuffles(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert shuffles(spark) <= before
    assert size(kept._stored_at) < 50_000 * 256  # a byte for each float of four, where it took more than four
    assert kept.count() == 50_000 and kept.schema["v"].dataType == rows.schema["v"].dataType
    session.release(kept, rows)
    assert not os.path.exists(kept._stored_at.removeprefix("file:"))


def test_columns_without_a_type_are_stored_too(spark):
    kept = durable(spark.range(3).withColumn("nothing", F.lit(None)))
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2]
