from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from answerloom import constants as K
from answerloom.operators import extraction as E, layouts as L
from answerloom.sources import backup, grids, records


def grid(spark, *tables, **options):
    data = [(d, i, list(row)) for d, table in enumerate(tables) for i, row in enumerate(table)]
    return E.with_options(spark.createDataFrame(data, "doc_id int, row_idx long, cells array<string>"), **options)


def mapping(spark, *tables, skip_blank=True, **options):
    got = E.infer_mapping(grid(spark, *tables, **options), E.GRID, skip_blank).orderBy("doc_id").collect()
    return [(r.q_col, r.a_col, r.header_rows) for r in got]


Q1, Q2, Q3 = "Do you encrypt data at rest?", "Describe your backup process", "Is access reviewed yearly?"


def test_mapping(spark):
    assert mapping(
        spark,
        [["Category", "Question", "Response", "Evidence"], ["A", Q1, "", ""]],
        [["Answer", "Question"], ["", Q1]],
        [["1", Q1, ""], ["2", Q2, ""]],
        [["1", Q1, "filled", ""], ["2", Q2, "", ""], ["3", Q3, "", ""]],
        [[Q1, ""], [Q2, ""]],
        [["a", "b", "c"]],
    ) == [(1, 2, 1), (1, 0, 1), (1, 2, 0), (1, 2, 0), (0, 1, 0), (0, 1, 0)]


def test_mapping_keeps_options_without_detection(spark):
    assert mapping(spark, [["x", "Question", "Answer"], ["1", Q1, ""]], profile="three_column_table") == [(1, 2, 1)]
    assert mapping(spark, [["Question", "Answer"]], profile="strict_two_column") == [(0, 1, 0)]


def test_grid_counts_headers_among_rows_with_text(spark):
    table = [["", ""], ["Question", "Answer"], ["", ""], [Q1, ""], [Q2, "yes"], ["short", ""]]
    got = E.extract_grid(grid(spark, table)).orderBy("question_row_idx").collect()
    assert [(r.question_text, r.question_row_idx, r.header_rows, r.source_block_id) for r in got] == [
        (Q1, 3, 1, "csv-row-3-q0-a1"), (Q2, 4, 1, "csv-row-4-q0-a1"),
    ]


def test_header_rows_option_skips_rows(spark):
    got = E.extract_grid(grid(spark, [["", ""], [Q3, ""], [Q1, ""], [Q2, ""]], hints={"header_rows": "2"})).collect()
    assert [r.question_text for r in got] == [Q2]


def test_strict_profile_rejects_wider_rows(spark):
    table = [[Q1, ""], [Q2, "", "extra"]]
    assert [r.question_text for r in E.extract_grid(grid(spark, table, profile="strict_two_column")).collect()] == [Q1]


def test_merged_row_sends_answer_below(spark):
    tables = [[Q1, Q1, Q1], ["", " ", "x"], [Q2, Q2, Q2], ["filled", "", ""], [Q3, Q3, Q3], [""]]
    cells = grid(spark, tables).withColumn("table_idx", F.lit(0))
    got = {r.question_text: (r.answer_row_idx, r.answer_col_idx, r.layout_hint, r.confidence) for r in E.extract_tables(cells).collect()}
    assert got == {Q1: (1, 1, "row_block", 0.85), Q2: (2, 1, "same_row", 0.9), Q3: (5, 0, "row_block", 0.85)}


def test_lines_are_dropped_when_seen_before(spark):
    lines = E.with_options(spark.createDataFrame(
        [(0, 0, 0, Q1), (0, 0, 1, Q2.upper()), (0, 1, 0, Q2), (0, 1, 1, Q3), (1, 0, 0, Q3)], "doc_id int, page_idx int, line_idx int, line string"
    ))
    tables = spark.createDataFrame([(0, Q1.lower(), 0), (0, Q3, 2)], "doc_id int, question_text string, page_idx int")
    got = E.extract_lines(lines, tables).orderBy("doc_id", "page_idx", "line_idx").collect()
    assert [(r.doc_id, r.page_idx, r.question_text) for r in got] == [(0, 0, Q2.upper()), (0, 1, Q3), (1, 0, Q3)]


def test_merge_keeps_repeated_paragraphs(spark):
    tables = spark.createDataFrame([(0, Q1)], "doc_id int, question_text string")
    paragraphs = spark.createDataFrame([(0, Q1.upper()), (0, Q2), (0, Q2)], "doc_id int, question_text string")
    assert sorted(r.question_text for r in E.merge_items(tables, paragraphs).collect()) == sorted([Q1, Q2, Q2])


@pytest.mark.parametrize(
    "rows, table, text, total, expected",
    [
        (5, 0, 0, 0, (0.0, "no_questions_found")), (0, 0, 4, 4, (0.75, "low_confidence_parse")), (3, 2, 1, 3, (0.95, None)),
        (3, 2, 0, 2, (0.9, None)), (0, 0, 0, 1, (0.5, "low_confidence_parse")),
    ],
)
def test_parse_score(spark, rows, table, text, total, expected):
    stats = spark.createDataFrame([(rows, table, text, total)], "table_rows_scanned int, table_items int, text_items int, items_total int")
    r = E.score_parse(stats).head()
    assert (r.confidence, r.fallback_reason) == expected and r.fallback_recommended == (expected[1] is not None)


def test_profiles_and_recommendation(spark):
    wide = [["Nr", "Topic", "x"], ["1", Q1, ""], ["2", Q2, ""]]
    plain = [["nothing here", "at all"]]
    report = E.profile_report(grid(spark, wide, plain).select("doc_id", "row_idx", "cells"))
    counts = {(r.doc_id, r.profile_name): r.question_count for r in report.collect()}
    assert counts[(0, "default")] == 2 and counts[(0, "strict_two_column")] == 0 and counts[(0, "three_column_table")] == 2
    best = {r.doc_id: r for r in E.recommend_profile(report, "pdf").collect()}
    assert best[0].recommended_profile == "default" and best[0].hints == [E.SUITABLE_HINT]
    assert best[1].recommended_profile is None and best[1].reason == E.NONE_FOUND and len(best[1].hints) == 4


def test_hints_ignore_unusable_values():
    base = K.profile_options()
    assert E.apply_hints(base, {"header_rows": "3", "answer_column_index": -1, "question_column_index": True, "detect_row_blocks": "no", "other": 1}) == {**base, "header_rows": 3}
    assert E.apply_hints(base, {"detect_row_blocks": False, "answer_column_index": 2.9})["answer_column_index"] == 2


def test_document_context_is_cut(spark):
    lines = spark.createDataFrame([(0, i, "x" * 20) for i in range(200)], "doc_id int, line_idx int, line string")
    items = spark.createDataFrame([(0, i, f"Question {i}?") for i in range(60)], "doc_id int, position long, question_text string")
    whole = E.document_context(lines, items, max_chars=100_000).head().context.split("\n")
    assert len(whole) == 120 + 1 + 40 and whole[120] == "Extracted question preview:" and whole[-1] == "- Question 39?"
    cut = E.document_context(lines, items, max_chars=10).head().context
    assert cut == "\n".join(whole)[:500] + "\n...[truncated]"


def test_context_of_text_and_paged_documents(spark):
    paragraphs = spark.createDataFrame([(0, i, f"p{i}") for i in range(130)], "doc_id int, line_idx int, line string")
    cells = spark.createDataFrame([(0, t, r, [f"t{t}", "", f"r{r}"]) for t in range(11) for r in range(41)], "doc_id int, table_idx int, row_idx long, cells array<string>")
    items = spark.createDataFrame([(0, 0, "Why so?")], "doc_id int, position long, question_text string")
    whole = E.document_context(E.document_opening(paragraphs, cells), items, None, 1_000_000).head().context.split("\n")
    assert len(whole) == 120 + 400 + 2 and whole[119:121] == ["p119", "t0 | r0"] and whole[-3:] == ["t9 | r39", "Extracted question preview:", "- Why so?"]
    pages = spark.createDataFrame([(0, p, i, f"{p}-{i}") for p in range(10) for i in range(3)], "doc_id int, page_idx int, line_idx int, line string")
    paged = E.document_context(E.page_opening(pages), items, None).head().context.split("\n")
    assert len(paged) == 8 * 3 + 2 and paged[:4] == ["0-0", "0-1", "0-2", "1-0"]


def test_grid_files_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Question;Response\nDo you encrypt it "daily"?;\n\n Describe the process ; yes\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("Question,Answer\nIs it safe today?,\n", encoding="utf-8")
    cells = grids.read_grids(spark, str(tmp_path))
    by_file = {}
    for r in cells.orderBy("row_idx").collect():
        by_file.setdefault(r.doc_id.rsplit("/", 1)[1], []).append((r.row_idx, r.cells, r.delimiter))
    assert by_file["a.csv"] == [
        (0, ["Question", "Response"], ";"), (1, ['Do you encrypt it "daily"?', ""], ";"), (2, [], ";"), (3, ["Describe the process", "yes"], ";"),
    ]
    items = E.extract_grid(E.with_options(cells))
    assert items.count() == 3
    answers = items.select("doc_id", "answer_row_idx", "answer_col_idx", F.when(F.col("question_row_idx") == 3, "Done").alias("answer_text"))
    filled = grids.fill_grids(cells, answers)
    lines = filled.select("doc_id", "row_idx", grids.delimited_line(F.col("cells"), F.col("delimiter"), F.col("quote")).alias("l"))
    got = {r.doc_id.rsplit("/", 1)[1]: r.l for r in lines.filter("row_idx = 3 OR (doc_id LIKE '%b.csv' AND row_idx = 1)").collect()}
    assert got == {"a.csv": "Describe the process;Done", "b.csv": f"Is it safe today?,{K.REVIEW_PLACEHOLDER}"}
    grids.write_grids(filled.withColumn("doc_id", F.element_at(F.split("doc_id", "/"), -1)), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("doc_id=*")) == ["doc_id=a.csv", "doc_id=b.csv"]


def test_fill_pads_short_rows(spark):
    cells = spark.createDataFrame([(0, 0, ["q"])], "doc_id int, row_idx long, cells array<string>")
    answers = spark.createDataFrame([(0, 0, 3, "A")], "doc_id int, answer_row_idx long, answer_col_idx int, answer_text string")
    assert grids.fill_grids(cells, answers).head().cells == ["q", "", "", "A"]


def test_import_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text('﻿ Category ,QUESTION,Answer\nSec,"Is ""it"" on?\nReally?",Yes\n,Q,A\n', encoding="utf-8")
    got = records.read_qa_csv(spark, str(tmp_path / "r.csv")).orderBy("row_no").collect()
    assert [(r.row_no, r.category, r.question, r.answer) for r in got] == [(1, "Sec", 'Is "it" on?\nReally?', "Yes"), (2, None, "Q", "A")]
    (tmp_path / "r.json").write_text('[{" Category":"Sec","Question":"Q1","ANSWER":5}, 3, "x", {"question":"Q2"}]', encoding="utf-8")
    good, bad = records.read_qa_json(spark, str(tmp_path / "r.json"))
    assert [(r.row_no, r.category, r.question, r.answer) for r in good.orderBy("row_no").collect()] == [(1, "Sec", "Q1", "5"), (2, None, "Q2", None)]
    assert sorted(r.error for r in bad.collect()) == ["Row 2: invalid record format (expected object)", "Row 3: invalid record format (expected object)"]
    (tmp_path / "o.json").write_text('{"a":1}', encoding="utf-8")
    assert [r.error for r in records.read_qa_json(spark, str(tmp_path / "o.json"))[1].collect()] == ["JSON import must be an array of records"]


def test_import_files_with_different_headers(spark, tmp_path):
    for name, content in (("a", "category,question,answer\nc1,q1,a1\n"), ("b", "\ufeffAnswer, Category ,Question\na2,c2,q2\n\na3,,q3\n"), ("c", "question,note\nq4,n\n"), ("d", "")):
        (tmp_path / f"{name}.csv").write_text(content, encoding="utf-8")
    got = records.read_qa_csv(spark, str(tmp_path)).orderBy("source_file", "row_no").collect()
    assert [(r.row_no, r.category, r.question, r.answer) for r in got] == [(1, "c1", "q1", "a1"), (1, "c2", "q2", "a2"), (2, None, "q3", "a3"), (1, None, "q4", None)]


def test_json_string_with_object_text_is_no_record(spark):
    files = spark.createDataFrame([("f", '[{"question":"Q"}, "{\\"question\\":\\"from a string\\"}", null]')], "source_file string, content string")
    good, bad = records.parse_records(files)
    assert [(r.row_no, r.question) for r in good.collect()] == [(1, "Q")]
    assert sorted(r.error[:5] for r in bad.collect()) == ["Row 2", "Row 3"]


def test_unreadable_grid_leaves_the_others(spark):
    files = spark.createDataFrame([(1, b"Question,Answer\nA,B"), (2, "Fran\u00e7ais,x".encode("latin-1"))], "doc_id long, content binary")
    assert {(r.doc_id, r.row_idx) for r in grids.parse_grids(files).collect()} == {(1, 0), (1, 1)}
    assert [r.doc_id for r in grids.grid_errors(files).collect()] == [2]


def test_backup_and_restore(spark, tmp_path):
    flags = spark.sql("SELECT 1L AS id, 'a \"b\"\nc' AS extracted_question, true AS resolved, TIMESTAMP_NTZ'2024-01-02 03:04:05' AS created_at, array(1.5f) AS embedding UNION ALL SELECT 2L, NULL, false, NULL, NULL")
    summary = {r.table: (r.rows, r.status) for r in backup.backup_tables({"flagged_questions": flags}, str(tmp_path / "b")).collect()}
    assert summary["flagged_questions"] == (2, "ok") and summary["qa_pairs"] == (0, "skipped") and len(summary) == 10
    tables, report = backup.restore_tables(spark, str(tmp_path / "b"))
    got = tables["flagged_questions"].orderBy("id").collect()
    assert got[0].asDict() == {"id": "1", "extracted_question": 'a "b"\nc', "resolved": True, "created_at": flags.first().created_at}
    assert got[1].extracted_question is None and got[1].resolved is False and got[1].created_at is None
    assert {r.status for r in backup.restore_tables(spark, str(tmp_path / "b"), dry_run=True)[1].collect()} == {"dry-run", "skipped"}


def test_fingerprints(spark):
    a, b = [["Question Nr", "Answer"], ["x", "y"]], [["answer  question", "NR"], ["p", "q"]]
    prints = L.fingerprint(grid(spark, a, b, [["Answer", "Question", "Nr"]])).orderBy("doc_id").collect()
    assert prints[0].header_words == ["answer", "nr", "question"] and prints[0].fingerprint_hash == prints[1].fingerprint_hash != prints[2].fingerprint_hash
    other = L.fingerprint(grid(spark, a, b), "xlsx").collect()
    assert len({r.fingerprint_hash for r in other}) == 1 and other[0].column_count == 0


def test_fingerprints_of_files_split_at_commas(spark):
    files = spark.createDataFrame([(0, b"\xef\xbb\xbfNr;Question\n1;x"), (1, b'"a,\nb",C'), (2, b""), (3, b"\xff")], "doc_id int, content binary")
    heads = {r.doc_id: r.cells for r in grids.header_cells(files).collect()}
    assert heads == {0: ["Nr;Question"], 1: ["a,\nb", "C"], 2: []}
    prints = {r.doc_id: (r.column_count, r.header_words) for r in L.fingerprint(grids.header_cells(files)).collect()}
    assert prints == {0: (1, ["nr;question"]), 1: (2, ["a,", "b", "c"]), 2: (0, [])}
