"""Resolving flags normalises each question once."""

from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from answerloom.functions import text as X
from answerloom.operators import flags as FL, similarity as S


def test_resolving_normalises_each_question_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    key = X.question_key

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    monkeypatch.setattr(X, "question_key", lambda text: key(counted(text)))
    never = "CAST(NULL AS TIMESTAMP_NTZ)"
    flags = spark.range(40).selectExpr(
        "id", "id AS job_id", "concat('What is ', id % 4, '?') AS extracted_question", "id % 8 = 7 AS resolved", "CAST(NULL AS STRING) AS resolved_answer",
        f"{never} AS resolved_at", "CAST(NULL AS STRING) AS assigned_to",
    )
    kb = spark.createDataFrame([], "id long, category string, question string, answer string, embedding array<float>, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz")
    given = spark.createDataFrame([(1, "one", True, "c"), (2, "two", False, None), (6, "late", False, None)], "flag_id long, answer string, add_to_kb boolean, category string")
    after, kb_after, _, errors = FL.resolve_flags(flags, kb, given, "2024-01-01")
    assert rows(after.groupBy("resolved_answer").count()) == [("one", 10), ("two", 10), (None, 20)]
    assert rows(kb_after.select("question", "answer")) == [("What is 1?", "one")] and rows(errors) == [(6, "Already resolved")]
    assert seen.value == 40


def test_similar_pairs_embed_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def embed(n):
        seen.add(1)
        return [1.0, float(n % 5), 0.5]

    table = spark.range(30).select("id", embed("id").alias("embedding"))
    assert S.similar_pairs(table, 0.5).count() > 0 and seen.value == 30
    assert S.cluster_edges(table, 0.5).count() > 0 and seen.value == 60
