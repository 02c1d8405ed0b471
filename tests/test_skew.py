"""Hot keys, numbering and star graphs: results and final plans."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from answerloom.operators import components, flags, matching
from answerloom.operators.ranking import running_total, with_positions
from answerloom.operators.skew import hot_keys, lookup


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def hot(spark, n=2000, share=0.8):
    return spark.range(n).select("id", F.when(F.col("id") < int(n * share), F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"))


def test_hot_keys_are_found_and_nulls_are_none(spark):
    found = hot_keys(hot(spark).unionByName(spark.range(5000).select("id", F.lit(None).cast("string").alias("key"))), ["key"])
    assert found == [r[0] for r in spark.sql("SELECT xxhash64('hot')").collect()]
    whole = spark.range(10).select(F.lit(4).alias("key"))
    assert hot_keys(whole, ["key"]) == hot_keys(whole.select(F.col("key").cast("long")), ["key"]) != []
    assert hot_keys(hot(spark).limit(0), ["key"]) == []
    assert hot_keys(spark.range(1000).select(F.col("id").alias("key")), ["key"]) == []


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_equals_a_plain_join(spark, how):
    big = hot(spark).unionByName(spark.createDataFrame([(9001, None), (9002, "lacking")], "id long, key string"))
    table = hot(spark).filter("key <> 'k1700'").groupBy("key").agg(F.max("id").alias("top"))
    assert rows(lookup(big, table, ["key"], how)) == rows(big.join(table, ["key"], how))


def test_lookup_of_keys_of_other_width(spark):
    big = spark.range(50).select(F.lit(4).alias("key"), "id")
    table = spark.createDataFrame([(4, "four"), (5, "five")], "key long, name string")
    assert lookup(big, table, ["key"]).filter("name = 'four'").count() == 50


def test_hot_rows_are_not_shuffled(spark):
    big = hot(spark)
    table = big.groupBy("key").agg(F.max("id").alias("top"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup(big, table.hint("merge"), ["key"])
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the branch of hot rows goes from the scan to the broadcast join without an exchange
    branch = plan.split("BroadcastHashJoin")[1].split("BroadcastQueryStage")[0]
    assert "Exchange" not in branch and "Range" in branch


@pytest.mark.parametrize("operation", ["sync", "prefill", "rebuild", "resolved"])
def test_operators_on_a_hot_question(spark, operation):
    n = 400
    asked = spark.range(n).select(F.col("id"), F.when(F.col("id") < 320, "What is it?").otherwise(F.concat(F.lit("What is "), F.col("id").cast("string"), F.lit("?"))).alias("q"))
    if operation == "sync":
        flag = asked.select(
            "id", F.lit(1).alias("job_id"), F.col("q").alias("extracted_question"), F.lit(False).alias("resolved"),
            F.lit(None).cast("string").alias("resolved_answer"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
        )
        kb = spark.createDataFrame([(1, "What is it?", "A", None, None)], "id long, question string, answer string, updated_at timestamp_ntz, deleted_at timestamp_ntz")
        after, summary = flags.sync_flags(flag, kb, "2024-01-01")
        assert after.filter("resolved_answer = 'A'").count() == 320 and tuple(summary.head()) == (400, 320, 1, 80)
    items = asked.select(
        F.lit(1).alias("doc_id"), F.col("id").alias("question_index"), F.col("q").alias("question_text"), F.lit(None).cast("string").alias("answer_text"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("matched_source"),
    )
    if operation == "prefill":
        answers = spark.createDataFrame([(1, 7, "what is it", "T"), (2, 7, "What is it?", "U")], "id long, template_id long, question_text string, answer_text string")
        assert matching.prefill(items, answers, 7).filter("answer_text = 'U' AND matched_source = 'template'").count() == 320
    if operation == "rebuild":
        prior = spark.createDataFrame([(1, 5, "What is it?", 0.5, "c", "b")], "doc_id int, question_index long, extracted_question string, similarity_score double, context string, best_match_question string")
        again = matching.rebuild_flags(items, prior)
        assert again.count() == 400 and again.filter("similarity_score = 0.5 AND context = 'c'").count() == 320
    if operation == "resolved":
        kb = spark.createDataFrame([], "id long, category string, question string, answer string, embedding array<float>, deleted_at timestamp_ntz")
        flag = spark.createDataFrame([(1, "What is it?", True, "R", None)], "id long, extracted_question string, resolved boolean, resolved_answer string, resolved_at timestamp_ntz")
        done = matching.match_cascade(items.drop("answer_text", "confidence", "matched_source"), kb, flag)
        assert done.count() == 400 and done.filter("answer_text = 'R' AND matched_source = 'resolved_flagged'").count() == 320


def test_running_total_and_positions_without_a_global_window(spark):
    given = spark.range(500).select(((F.col("id") * 7919) % 100_003).alias("o"), (F.col("id") % 5).alias("amount"))
    done = running_total(given, "o", F.col("amount"))
    plan = final_plan(done)
    want, before = {}, 0
    for o, amount in sorted((r.o, r.amount) for r in given.collect()):
        want[o] = before
        before += amount
    assert {r.o: r.before for r in done.collect()} == want
    placed = with_positions(given, [], "o")
    assert [r.position for r in placed.orderBy("o").collect()] == list(range(1, 501))
    assert "SinglePartition" not in plan and "SinglePartition" not in final_plan(placed)
    assert with_positions(given.limit(0), [], "o").count() == 0


def test_a_star_is_split(spark):
    star = [(0, i) for i in range(1, 401)] + [(1000 + i, 1001 + i) for i in range(100)]
    edges = spark.createDataFrame(star, "a long, b long").select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = components._large_star(edges)
        plan = final_plan(large).split("== Initial Plan ==")[0]
        small = final_plan(components._small_star(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "BroadcastHashJoin" in small
    got = {r.id: r.root for r in components.connected_components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(401)} | {1000 + i: 1000 for i in range(101)}
