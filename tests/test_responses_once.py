"""Model responses are parsed once, however often their decisions are used."""

from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from answerloom.functions.responses import extract_json_object
from answerloom.operators import inference as I


def test_decisions_do_not_parse_their_responses_again(spark):
    good = '```json\n{"decisions":[{"id":"q_0","action":"answer","answer":" a ","confidence":2},{"id":"q_9","action":"answer","answer":"x"}]}\n```'
    given = [(1, 1, good), (1, 2, '{"decisions":[]}'), (2, 1, "no"), (3, 1, None), (None, 1, '{"decisions":null}'), (4, 1, good), (4, 1, "{}")]
    responses = spark.createDataFrame(given, "doc_id long, chunk_no long, content string")
    items = spark.createDataFrame([(d, i, f"{d}?{i}") for d in (1, 2, 3, 4) for i in (0, 1)], "doc_id long, question_index int, question_text string")
    decisions, failed = I.normalize_decisions(responses, items)
    assert rows(decisions.select("doc_id", "chunk_no", "at", "answer", "confidence", "question")) == [(1, 1, 0, "a", 1.0, "1?0"), (4, 1, 0, "a", 1.0, "4?0")]
    assert rows(failed) == [(1, 1), (2, 1), (3, 1), (4, 1), (None, 1)]
    for table in (decisions, failed):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan and "parseJson" not in plan


def test_json_objects_in_responses(spark):
    given = ['{"a":1}', '  {"a":1}\t', '```json\n {"a":1} \n```', '```{"a":1}', 'x {"a":1} y', "[1]", '"{}"', "{", "{} {}", "[{}]", "", None, "```python\n{}\n```", "﻿{}"]
    found = spark.createDataFrame(list(enumerate(given)), "n int, content string").select("n", extract_json_object(F.col("content")).alias("o"))
    assert [r.o for r in found.orderBy("n").collect()] == ['{"a":1}'] * 5 + [None, "{}", None, "{} {}", "{}", None, None, "{}", "{}"]
