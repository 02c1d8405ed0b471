"""Import files, review chains, agent mode, backups and profiles: cases the queries' tables do not hold."""

from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from answerloom import constants as K
from answerloom.operators import duplicates as D, extraction as E, knowledge as KB, matching as M
from answerloom.sources import backup, grids, records

KB_SCHEMA = "id long, category string, question string, answer string, embedding array<float>, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz"


def files(spark, **contents):
    return spark.createDataFrame([(n, bytearray(c) if c is not None else None) for n, c in contents.items()], "source_file string, content binary")


def test_csv_rows_short_long_quoted_and_broken(spark):
    got = records.parse_qa_csv(files(
        spark, a=b"question,answer\nq1,a1,extra,more\nq2\n\n", b=b"\xef\xbb\xbfAnswer , CATEGORY,question,question\n\"x, \"\"y\"\"\nz\",c,old,new\n",
        c=b"category,question\nc\xff,q\n", d=b"", e=None, f=b"nothing,known\n1,2\n", g=b"question\n" + b"x" * 200_000,
    ))
    done = [(r.source_file, r.row_no, r.category, r.question and r.question[:5], r.answer, r.error is not None) for r in got.collect()]
    assert sorted(done, key=lambda r: (r[0], r[1])) == [
        ("a", 1, None, "q1", "a1", False), ("a", 2, None, "q2", None, False), ("b", 1, "c", "new", 'x, "y"\nz', False),
        ("c", 1, None, None, None, True), ("f", 1, None, None, None, False), ("g", 1, None, "xxxxx", None, False),
    ]


def test_read_qa_csv_of_a_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"question,answer\nq1,a1,extra\n")
    (tmp_path / "b.csv").write_bytes(b"question\n\xff\n")
    assert rows(records.read_qa_csv(spark, str(tmp_path)).select("row_no", "category", "question", "answer")) == [(1, None, "q1", "a1")]
    assert [r.row_no for r in records.qa_csv_errors(spark, str(tmp_path)).collect()] == [1]


def test_imports_of_several_files_apply_in_one_order(spark):
    kb = spark.createDataFrame([], KB_SCHEMA)
    given = [("b", 1, "C", "Same question here?", "from b"), ("a", 2, "C", "Same question here?", "from a2"), ("a", 1, "C", "Same question here?", "from a1"), ("b", 2, " ", "x", "y")]
    for order in (given, given[::-1]):
        several = spark.createDataFrame(order, "source_file string, row_no long, category string, question string, answer string").repartition(3)
        after, _ = KB.upsert_kb(kb, several.filter("category = 'C'"), "2024-01-01")
        assert [r.answer for r in after.collect()] == ["from b"]
        after, summary, errors, _ = KB.import_kb(kb, several, "2024-01-01")
        assert [r.answer for r in after.collect()] == ["from a1"] and summary.head().total_rows == 4
        assert [(r.source_file, r.error[:6]) for r in errors.collect()] == [("b", "Row 2:")]


def test_a_chain_of_actions_takes_few_rounds(spark, monkeypatch):
    n = 32  # review i joins entries i and i + 1 and its action deletes i + 1: every second one succeeds
    schema = (
        "id long, entry_a_id long, entry_b_id long, similarity_score double, classification string, contradicts boolean, reason string, "
        "recommended_keep_id long, status string, reviewed_action string, source string, created_at timestamp_ntz, reviewed_at timestamp_ntz"
    )
    reviews = spark.createDataFrame([(i, i, i + 1, 0.9, None, None, None, None, "pending", None, "x", None, None) for i in range(n)], schema)
    kb = spark.range(n + 1).select("id", F.lit(None).cast("timestamp_ntz").alias("deleted_at"), F.lit("a").alias("answer"))
    actions = spark.range(n).select(F.col("id").alias("seq"), F.col("id").alias("review_id"), F.lit("keep_left").alias("action"))
    rounds = []
    settle = D._settle
    monkeypatch.setattr(D, "_settle", lambda *state: rounds.append(1) or settle(*state))
    _, _, summary, errors, _ = D.apply_review_actions(reviews, kb, actions, "2024-01-01")
    assert sorted(r.seq for r in errors.collect()) == list(range(1, n, 2)) and tuple(summary.head()) == (n // 2, n // 2)
    assert len(rounds) <= 8  # log2(32) and a few


def test_backup_reads_each_table_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)
    table = spark.range(5).select("id", F.lit("x").alias("question"))
    counted = spark.createDataFrame(table.rdd.map(lambda r: (reads.add(1), r)[1]), table.schema)
    summary = {r["table"]: (r["rows"], r["status"]) for r in backup.backup_tables({"qa_pairs": counted}, str(tmp_path)).collect()}
    assert summary["qa_pairs"] == (5, "ok") and summary["audit_logs"] == (0, "skipped") and reads.value == 5


def test_grid_rows_and_errors_of_one_parse(spark):
    given = spark.createDataFrame([(1, bytearray(b"a,b\n1,2")), (2, bytearray(b"\xff")), (3, None), (4, bytearray(b""))], "doc_id long, content binary")
    parsed = grids.parse(given).persist()
    assert rows(grids.cells_of(parsed).select("doc_id", "row_idx")) == [(1, 0), (1, 1)]
    assert [r.doc_id for r in grids.errors_of(parsed).collect()] == [2]
    parsed.unpersist()


def test_profiles_of_unreadable_and_empty_documents(spark):
    cells = spark.createDataFrame([(1, 0, ["Describe your backup policy?", ""])], "doc_id long, row_idx long, cells array<string>")
    errors = spark.createDataFrame([(2, "broken")], "doc_id long, error string")
    report = E.profile_report(cells, errors=errors)
    assert rows(report.filter("profile_name = 'default'").select("doc_id", "question_count", "error_message")) == [(1, 1, None), (2, 0, "broken")]
    assert report.filter("doc_id = 2 AND fallback_reason = 'parser_error'").count() == len(K.PROFILE_OVERRIDES)
    advice = {r.doc_id: (r.recommended_profile, r.reason) for r in E.recommend_profile(report).collect()}
    assert advice[1][0] == K.DEFAULT_PROFILE and advice[2] == (None, E.ALL_FAILED)
    documents = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    items = spark.createDataFrame([(1, "A")], "doc_id long, answer_text string")
    jobs = M.finished_jobs(documents, items, report.filter("profile_name = 'default'"), errors)
    got = {r.job_id: (r.status, r.total_questions, r.matched_questions, r.fallback_reason, r.error_message) for r in jobs.collect()}
    assert got == {1: ("done", 1, 1, None, None), 2: ("error", None, None, None, "broken"), 3: ("done", 0, 0, "no_questions_found", None)}


def test_no_profile_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, row_idx long, cells array<string>")
    assert E.profile_report(none).count() == 0
