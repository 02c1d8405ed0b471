from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from answerloom import constants as K
from answerloom.operators import (
    audit as A, duplicates as D, flags as FL, inference as I, jobs as J, knowledge as KB, matching as M, review_queue as RQ, templates as TP,
)
from answerloom.plans.fill import fill_pipeline
from answerloom.plans.standins import with_vectors

NOW = "2024-06-01 00:00:00"
KB_SCHEMA = "id long, category string, question string, answer string, updated_at string, deleted_at string"


def kb_table(spark, *entries):
    """Entries are (id, category, question, answer[, updated_at[, deleted_at]])."""
    data = [tuple(e) + (None,) * (6 - len(e)) for e in entries]
    base = spark.createDataFrame(data, KB_SCHEMA)
    ts = lambda c: F.col(c).cast("timestamp_ntz")
    return with_vectors(base.select("id", "category", "question", "answer", F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"), ts("updated_at").alias("updated_at"), ts("deleted_at").alias("deleted_at")))


def flag_table(spark, *entries):
    """Entries are (id, job_id, question, resolved, answer, created_at)."""
    base = spark.createDataFrame([tuple(e) for e in entries], "id long, job_id long, extracted_question string, resolved boolean, resolved_answer string, created_at string")
    return base.select(
        "id", "job_id", "extracted_question", F.lit(None).cast("string").alias("context"), (F.col("id") / 100).alias("similarity_score"),
        F.lit(None).cast("string").alias("best_match_question"), "resolved", "resolved_answer",
        F.when(F.col("resolved"), F.col("created_at")).cast("timestamp_ntz").alias("resolved_at"), F.col("created_at").cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("string").alias("assigned_to"),
    )


def asked(spark, *texts):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "doc_id int, question_index long, question_text string")


KB_ROWS = [
    (1, "Security", "Do you encrypt customer data at rest?", "Yes, AES-256."), (2, "HR", "How many employees do you have?", "Forty."),
    (3, "Old", "Is this entry gone for good?", "Gone.", None, "2024-01-02"),
]


# --- matching --------------------------------------------------------------


def test_match_levels(spark):
    kb = kb_table(spark, *KB_ROWS)
    flags = flag_table(spark, (1, 9, "7. Where are your offices?", True, "Paris", "2024-01-01"), (2, 9, "Where are your offices?:", True, "Rome", "2024-02-01"),
                       (3, 9, "Who is the CISO?", True, K.DISMISSED, "2024-02-01"), (4, 9, "Any remarks left?", True, "", "2024-02-01"))
    texts = ["Do you encrypt customer data at rest?", "where are your offices?", "Who is the CISO?", "Any remarks left?", "Is this entry gone for good?"]
    got = {r.question_text: r for r in M.match_cascade(asked(spark, *texts), kb, flags).collect()}
    assert [got[t].matched_source for t in texts] == ["kb_match", "resolved_flagged", None, "resolved_flagged", None]
    assert got[texts[0]].answer_text == "Yes, AES-256." and abs(got[texts[0]].confidence - 1) < 1e-6 and got[texts[0]].matched_qa_id == 1
    assert got[texts[1]].answer_text == "Rome" and got[texts[1]].confidence == 1.0
    assert got[texts[3]].answer_text == ""
    assert got[texts[2]].best_match_question is not None and got[texts[2]].similarity_score < 0.75


def test_empty_knowledge_base(spark):
    kb = kb_table(spark, KB_ROWS[2])
    flags = flag_table(spark, (1, 9, "Known before?", True, "Yes", "2024-01-01"))
    got = {r.question_text: r for r in M.match_cascade(asked(spark, "Known before?", "Never seen?"), kb, flags).collect()}
    assert got["Known before?"].matched_source == "resolved_flagged"
    assert got["Never seen?"].similarity_score == 0.0 and got["Never seen?"].best_match_question is None
    matched, flagged = M.match(asked(spark, "Never seen?"), kb)
    assert matched.count() == 0 and flagged.head().similarity_score == 0.0


def test_ties_go_to_the_lowest_id(spark):
    kb = kb_table(spark, (8, "A", "same words here", "eight"), (5, "A", "Same words HERE", "five"), (9, "A", "here same words", "nine"))
    assert M.best_match(asked(spark, "same words here"), kb).head().kb_id == 5
    ranks = {r["rank"]: r.kb_id for r in M.candidates(asked(spark, "same words here"), kb, k=2).collect()}
    assert ranks == {1: 5, 2: 8}


def test_routing_and_repeats(spark):
    kb = kb_table(spark, *KB_ROWS)
    items = asked(spark, KB_ROWS[0][2], "something else entirely", KB_ROWS[0][2].upper() + " ")
    routed, remaining = M.route(items, M.candidates(items, kb))
    assert {r.question_index for r in routed.collect()} == {0, 2} and routed.head().matched_source == "kb_direct"
    assert [r.question_index for r in remaining.collect()] == [1]
    done = fill_pipeline(full_items(spark, KB_ROWS[0][2], "something else entirely", KB_ROWS[0][2].upper() + " "), kb, flag_table(spark, (1, 1, "x", False, None, "2024-01-01")), agent_mode=True)
    got = {r.question_index: (r.answer_text, r.source) for r in done.results.collect()}
    assert got == {0: ("Yes, AES-256.", "kb_direct"), 1: (None, "unmatched"), 2: ("Yes, AES-256.", "agent")}
    assert [r.extracted_question for r in done.flags.collect()] == ["something else entirely"]


def full_items(spark, *texts):
    return asked(spark, *texts).withColumns({
        "answer_text": F.lit(None).cast("string"), "confidence": F.lit(0.88), "matched_qa_id": F.lit(None).cast("long"), "matched_source": F.lit(None).cast("string"),
    })


def test_fill_off_mode_replaces_template_answers(spark):
    kb = kb_table(spark, *KB_ROWS)
    template = spark.createDataFrame([(1, 4, "1) " + KB_ROWS[0][2], "old"), (2, 4, "Other topic, please?", "first"), (3, 4, "other topic, please?", "later")], "id long, template_id long, question_text string, answer_text string")
    done = fill_pipeline(full_items(spark, KB_ROWS[0][2], "Other topic, please?", "Unknown thing?"), kb, flag_table(spark, (1, 1, "x", False, None, "2024-01-01")), template_answers=template, template_id=4)
    got = {r.question_index: (r.answer_text, r.source, r.confidence_score) for r in done.results.collect()}
    assert got[0][:2] == ("Yes, AES-256.", "kb_match") and got[1] == ("later", "template", 0.95) and got[2] == (None, "unmatched", 0.88)
    job = done.jobs.head()
    assert (job.total_questions, job.matched_questions, job.flagged_questions_count) == (3, 2, 1)


# --- knowledge base --------------------------------------------------------


def record_table(spark, *records):
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(records)], "row_no long, category string, question string, answer string")


def test_import_counts_and_folding(spark):
    kb = kb_table(spark, *KB_ROWS)
    recs = record_table(
        spark, ("Sec", KB_ROWS[0][2].lower(), "exact"), ("Sec", "New question about backups", "n1"), ("Sec", "NEW QUESTION ABOUT BACKUPS ", "dup"), ("", "q", "a"),
        ("Sec", "Do you encrypt customer data at rest? rest rest", "semantic"), ("HR", "  ", "a"), (None, "q2", "a"),
    )
    after, summary, errors, audit = KB.import_kb(kb, recs, NOW, threshold=0.8)
    assert summary.head().asDict() == {"imported": 1, "updated": 2, "semantic_merges": 1, "skipped": 3, "total_rows": 7}
    assert sorted(r.error for r in errors.collect()) == [f"Row {i}: missing category, question, or answer" for i in (4, 6, 7)]
    got = {r.id: r for r in after.collect()}
    assert got[1].answer == "semantic" and got[1].question == "Do you encrypt customer data at rest? rest rest" and got[1].category == "Sec"
    assert got[4].question == "New question about backups" and got[4].answer == "n1" and got[4].deleted_at is None and len(got) == 4
    assert audit.count() == 1


def test_upsert_keeps_the_longer_wording(spark):
    kb = kb_table(spark, (1, "A", "How many employees work for you today?", "ten"))
    after, audit = KB.upsert_kb(kb, record_table(spark, ("B", "how many employees work for you TODAY?", "twenty"), ("C", "Entirely unrelated matter", "x")), NOW)
    got = {r.id: (r.category, r.question, r.answer) for r in after.collect()}
    assert got == {1: ("B", "How many employees work for you today?", "twenty"), 2: ("C", "Entirely unrelated matter", "x")}
    assert sorted(r.action_type for r in audit.collect()) == ["kb_create", "kb_update"]


def test_edits_and_deletes_report_errors(spark):
    kb = kb_table(spark, *KB_ROWS)
    changes = spark.createDataFrame([(1, None, "New wording?", None), (2, "  ", None, "x"), (3, "A", None, None), (77, "A", None, None)], "id long, category string, question string, answer string")
    after, audit, errors = KB.update_kb(kb, changes, NOW)
    got = {r.id: r for r in after.collect()}
    assert got[1].question == "New wording?" and got[1].answer == "Yes, AES-256." and got[2].answer == "Forty."
    assert {r.id: r.error for r in errors.collect()} == {2: "Category is required", 3: "Entry not found", 77: "Entry not found"}
    after, audit, errors = KB.delete_kb(kb, spark.createDataFrame([(1,), (3,), (77,)], "id long"), NOW)
    assert {r.id for r in after.collect() if r.deleted_at is None} == {2} and audit.count() == 1
    assert {r.id: r.error for r in errors.collect()} == {3: "Entry already deleted", 77: "Entry not found"}


@pytest.mark.parametrize("merges, message", [([(1, 3, [1])], "Entry to keep"), ([(1, 1, [1])], "Cannot delete"), ([(1, 1, [3])], "Entry to delete"), ([(1, 1, [2]), (2, 2, [4])], "Entry to keep")])
def test_bad_merges_fail_as_a_whole(spark, merges, message):
    kb = kb_table(spark, *KB_ROWS, (4, "A", "d", "e"))
    with pytest.raises(ValueError, match=message):
        KB.merge_clusters(kb, spark.createDataFrame(merges, "merge_no long, keep_id long, delete_ids array<long>"), NOW)


def test_merge(spark):
    kb = kb_table(spark, *KB_ROWS, (4, "A", "d", "e"))
    after, summary, audit = KB.merge_clusters(kb, spark.createDataFrame([(1, 1, [2, 4])], "merge_no long, keep_id long, delete_ids array<long>"), NOW)
    assert {r.id for r in after.collect() if r.deleted_at is None} == {1}
    assert tuple(summary.head()) == (1, 2) and audit.count() == 1


# --- duplicates ------------------------------------------------------------


def review_table(spark, *rows):
    """Rows are (id, a, b, status, recommended)."""
    base = spark.createDataFrame(list(rows), "id long, entry_a_id long, entry_b_id long, status string, recommended_keep_id long")
    none = lambda t: F.lit(None).cast(t)
    return base.select(
        "id", "entry_a_id", "entry_b_id", F.lit(0.9).alias("similarity_score"), none("string").alias("classification"), none("boolean").alias("contradicts"),
        none("string").alias("reason"), "recommended_keep_id", "status", none("string").alias("reviewed_action"), F.lit("manual_scan").alias("source"),
        none("timestamp_ntz").alias("created_at"), none("timestamp_ntz").alias("reviewed_at"),
    )


def run_sequentially(reviews, live, actions):
    state = {r[0]: list(r) + [None] for r in reviews}
    live = set(live)
    ok = []
    for seq, rid, action in actions:
        r = state.get(rid)
        if r is None or r[3] != "pending" or r[1] not in live or r[2] not in live:
            continue
        ok.append(seq)
        left = action == "keep_left" or (action == "merge" and r[4] == r[1])
        r[3], r[5] = ("dismissed", action) if action == "keep_both" else ("reviewed", "merged" if action == "merge" else action)
        if action != "keep_both":
            gone = r[2] if left else r[1]
            live.discard(gone)
            for o in state.values():
                if o[3] == "pending" and gone in (o[1], o[2]):
                    o[3], o[5] = "dismissed", "auto_dismissed"
    return {k: (v[3], v[5]) for k, v in state.items()}, live, ok


@pytest.mark.parametrize("seed", [1, 2])
def test_review_actions_equal_sequential_run(spark, seed):
    rng = random.Random(seed)
    reviews = []
    for i in range(60):
        a, b = rng.sample(range(1, 26), 2)
        if rng.random() < 0.3:
            a = 1  # one entry in very many reviews
            b = rng.randrange(2, 26)
        a, b = min(a, b), max(a, b)
        reviews.append((i, a, b, rng.choice(["pending"] * 8 + ["reviewed", "dismissed"]), rng.choice([a, b, None])))
    actions = [(s, rng.randrange(63), rng.choice(["keep_left", "keep_right", "keep_both", "merge"])) for s in range(80)]
    kb = kb_table(spark, *[(i, "A", f"q{i}", "a", None, "2024-01-01" if i in (5, 9) else None) for i in range(1, 26)])
    want_reviews, want_live, want_ok = run_sequentially(reviews, set(range(1, 26)) - {5, 9}, actions)
    after, kb_after, summary, errors, audit = D.apply_review_actions(
        review_table(spark, *reviews), kb, spark.createDataFrame(actions, "seq long, review_id long, action string"), NOW
    )
    assert {r.id: (r.status, r.reviewed_action) for r in after.collect()} == want_reviews
    assert {r.id for r in kb_after.collect() if r.deleted_at is None} == want_live
    assert summary.head().processed == len(want_ok) and {r.seq for r in errors.collect()} == {s for s, _, _ in actions} - set(want_ok)
    assert audit.count() == len(want_ok)


def test_merge_without_recommendation_keeps_the_right_entry(spark):
    kb = kb_table(spark, (1, "A", "q", "a"), (2, "A", "r", "a"))
    actions = spark.createDataFrame([(1, 1, "merge"), (2, 9, "merge"), (3, 1, "merge")], "seq long, review_id long, action string")
    _, after, _, errors, _ = D.apply_review_actions(review_table(spark, (1, 1, 2, "pending", None)), kb, actions, NOW)
    assert {r.id for r in after.collect() if r.deleted_at is None} == {2}
    assert {r.seq: r.error for r in errors.collect()} == {2: "Review 9 not found", 3: "Review 1 already reviewed"}


def test_cluster_mean_covers_all_members(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.28, 0.96]), (4, [-1.0, 0.0]), (5, [-1.0, 0.0])]
    kb = spark.createDataFrame(rows, "id long, embedding array<float>").selectExpr(
        "id", "embedding", "'A' AS category", "'q' AS question", "'a' AS answer", "TIMESTAMP_NTZ'2024-01-01' AS created_at",
        "CASE WHEN id = 2 THEN TIMESTAMP_NTZ'2024-05-01' END AS updated_at", "CAST(NULL AS TIMESTAMP_NTZ) AS deleted_at",
    )
    report, summary = D.cluster_report(kb, 0.75)
    got = [(r.root, r.canonical_id, r.size, r.similarity) for r in report.collect()]
    assert got == [(1, 2, 3, round((0.8 + 0.28 + 0.8) / 3, 4)), (4, 4, 2, 1.0)]
    assert tuple(summary.head()) == (5, 2, 5)


# --- flags -----------------------------------------------------------------


def jobs_table(spark, *ids):
    return spark.createDataFrame([(i, f"job{i}.csv", "pending") for i in ids], "id long, original_filename string, review_status string")


def test_flag_groups(spark):
    flags = flag_table(
        spark, (1, 1, "1. Do you have a policy?", False, None, "2024-01-01"), (2, 2, "Do you have a policy?", True, "Yes", "2024-01-03"),
        (3, 1, "do you have a POLICY?:", False, None, "2024-01-02"), (4, 9, "Orphan without a job?", False, None, "2024-01-02"),
    )
    groups, sources = FL.grouped_flags(flags, jobs_table(spark, 1, 2))
    g = groups.collect()
    assert len(g) == 1 and (g[0].id, g[0].occurrence_count, g[0].job_count, g[0].resolved) == (2, 3, 2, False)
    assert sorted((r.job_id, r.filename, r.newest_id) for r in sources.collect()) == [(1, "job1.csv", 3), (2, "job2.csv", 2)]
    assert FL.export_flags(flags, jobs_table(spark, 1, 2), resolved=True).head().asDict() == {"category": "", "question": "Do you have a policy?", "answer": "Yes"}


def test_sync_counts_and_is_stable(spark):
    flags = flag_table(spark, (1, 1, "1. Is MFA on?", False, None, "2024-01-01"), (2, 2, "Is MFA on?", False, None, "2024-01-01"), (3, 1, "Other?", False, None, "2024-01-01"))
    kb = kb_table(spark, (1, "A", "is mfa on", "no"), (2, "A", "Is MFA on?", "old", "2024-01-01"), (3, "A", "2) is MFA on?", "new", "2024-02-01"), (4, "A", "Is MFA on?", "none"))
    after, summary = FL.sync_flags(flags, kb, NOW)
    assert tuple(summary.head()) == (3, 2, 1, 1)
    assert {r.id: r.resolved_answer for r in after.collect()} == {1: "new", 2: "new", 3: None}
    assert tuple(FL.sync_flags(after, kb, NOW)[1].head()) == (1, 0, 0, 1)


def test_resolve_routes_and_writes_back(spark):
    flags = flag_table(
        spark, (1, 1, "1. Is MFA on?", False, None, "2024-01-01"), (2, 2, "Is MFA on?", False, None, "2024-01-01"), (3, 1, "Other?", True, "x", "2024-01-01"),
    )
    kb = kb_table(spark, (7, "Old", " IS mfa ON? ", "no"))
    resolutions = spark.createDataFrame([(1, "Yes", True, " Security "), (3, "y", False, None), (99, "z", False, None)], "flag_id long, answer string, add_to_kb boolean, category string")
    after, kb_after, audit, errors = FL.resolve_flags(flags, kb, resolutions, NOW, {"Security": "s@x"})
    assert {r.id: (r.resolved_answer, r.assigned_to) for r in after.collect()} == {1: ("Yes", "s@x"), 2: ("Yes", "s@x"), 3: ("x", None)}
    assert {r.id: (r.category, r.question, r.answer) for r in kb_after.collect()} == {7: ("Security", "Is MFA on?", "Yes"), 8: ("Security", "1. Is MFA on?", "Yes")}
    assert {r.flag_id: r.error for r in errors.collect()} == {3: "Already resolved", 99: "Flagged question not found"}
    unmapped = FL.resolve_flags(flags, kb, resolutions, NOW, {"HR": "h@x"})[0]
    assert {r.assigned_to for r in unmapped.collect()} == {None}


def test_dismiss_dedupe_purge(spark):
    flags = flag_table(
        spark, (1, 1, "1. Is MFA on?", False, None, "2024-01-02"), (2, 1, "Is MFA on?", False, None, "2024-01-01"), (3, 2, "Is MFA on?", False, None, "2024-01-01"), (4, 1, "Done?", True, "x", "2024-01-01"),
    )
    after, summary, missing, _ = FL.dismiss_flags(flags, spark.createDataFrame([(1,), (3,), (4,), (50,), (50,)], "id long"), NOW)
    assert tuple(summary.head()) == (4, 1, 3, 1, 1) and [r.id for r in missing.collect()] == [50]
    kept, counts = FL.dedupe_flags(flags)
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4] and tuple(counts.head()) == (4, 1, 3)
    purged, total, _ = FL.purge_dismissed(after, NOW)
    assert [r.id for r in purged.collect()] == [4] and total.head().purged == 3


# --- review, templates, jobs -----------------------------------------------


def result_table(spark):
    rows = [
        (1, 5, 0, "Q one?", "A", "A", 0.9, "kb_match"), (2, 5, 1, "Q two?", None, "B", None, "unmatched"), (3, 5, 2, "Q two? ", "X", "C", 0.5, "kb_match"),
        (4, 5, 3, "Q four?", "D", "", 0.5, None), (5, 5, 4, "Q five?", None, None, 0.6, "unmatched"),
    ]
    return spark.createDataFrame(rows, "id long, job_id long, question_index long, question_text string, answer_text string, edited_answer_text string, confidence_score double, source string").withColumns(
        {"kb_pair_id": F.lit(1).cast("long"), "reviewed": F.col("id") < 3}
    )


def test_finalize_feeds_corrections_back(spark):
    results = result_table(spark)
    corrections, summary = RQ.corrections_from_results(results, NOW, 5)
    assert tuple(summary.head()) == (5, 3, 2)
    kb = kb_table(spark, (1, "Kept", "Q TWO?", "old"))
    after, linked, audit = RQ.feedback_to_kb(kb, corrections, NOW)
    assert {r.id: (r.category, r.question, r.answer) for r in after.collect()} == {1: ("Kept", "Q TWO?", "C")}
    assert {r.question_result_id: (r.kb_pair_id, r.auto_added_to_kb) for r in linked.collect()} == {2: (1, True), 3: (1, True)} and audit.count() == 2
    strict = RQ.feedback_to_kb(kb_table(spark, (1, "K", "none", "x")), corrections, NOW, min_confidence=0.4)
    assert {r.id: (r.category, r.answer) for r in strict[0].collect()} == {1: ("K", "x"), 2: (K.AUTO_LEARNED, "C")}
    sheet, jobs = RQ.finalize(results, jobs_table(spark, 5, 6), 5)
    assert {r.question_index: r.answer_text for r in sheet.collect()} == {0: "A", 1: "B", 2: "C", 3: "D", 4: None}
    assert {r.id: r.review_status for r in jobs.collect()} == {5: "finalized", 6: "pending"}


def test_edits_and_approval(spark):
    results = result_table(spark)
    edits = spark.createDataFrame([(4, "new"), (99, "x")], "id long, edited_answer_text string")
    after, jobs, audit = RQ.apply_edits(results, jobs_table(spark, 5, 6), edits, NOW)
    row = after.filter("id = 4").head()
    assert (row.edited_answer_text, row.reviewed) == ("new", True) and {r.id: r.review_status for r in jobs.collect()} == {5: "in_review", 6: "pending"}
    assert [(r.before_value, r.after_value) for r in audit.collect()] == [("D", "new")]
    assert RQ.approve(results, NOW, job_id=5)[1].head().approved == 3
    assert {r.id for r in RQ.review_filter(results, "low_confidence").collect()} == {3, 4, 5}


def test_templates(spark):
    template, answers = TP.make_template(result_table(spark), jobs_table(spark, 5), 5, 1, " T ", NOW)
    t = template.head()
    assert (t.name, t.question_count, t.source_filename) == ("T", 4, "job5.csv") and {r.question_index for r in answers.collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        TP.make_template(result_table(spark), jobs_table(spark, 5), 6, 1, "T", NOW)


def test_batches(spark):
    rows = [
        (1, "b", "done", "x.csv", "o1.csv", 3, 3, 0, False), (2, "b", "done", "x.csv", "o2.csv", 3, 2, 1, False), (3, "b", "error", "y.csv", None, 0, 0, 0, False),
        (4, "b", "pending", "z.csv", None, 0, 0, 0, False), (5, "b", "done", "x.docx", "o5.docx", 3, 3, 0, False), (6, "c", "done", "n.csv", "o6.csv", 0, 0, 0, False),
        (7, "d", "done", "n.csv", "o7.csv", 2, 2, 0, False),
    ]
    jobs = spark.createDataFrame(rows, "id long, batch_id string, status string, original_filename string, output_filename string, total_questions long, matched_questions long, flagged_questions_count long, fallback_recommended boolean")
    got = {r.batch_id: r for r in J.batch_summary(jobs).collect()}
    assert (got["b"].total, got["b"].done_count, got["b"].completed_count, got["b"].progress_percent, got["b"].needs_attention) == (5, 3, 4, 80, True)
    assert got["c"].needs_attention and not got["d"].needs_attention and got["d"].progress_percent == 100
    names = {r.id: r.download_name for r in J.batch_manifest(jobs).collect()}
    assert names == {1: "filled_x.csv", 2: "filled_x_2.csv", 5: "filled_x.docx", 6: "filled_n.csv", 7: "filled_n.csv"}


def test_presets_and_audit(spark):
    presets = spark.sql("SELECT 1L AS id, 'a' AS name, 'i' AS instructions, false AS is_builtin, TIMESTAMP_NTZ'2024-01-01' AS created_at UNION ALL SELECT 2L, 'b', 'i', true, TIMESTAMP_NTZ'2024-02-01'")
    assert [r.id for r in J.list_presets(presets).collect()] == [2, 1]
    kept, errors = J.delete_presets(presets, spark.createDataFrame([(1,), (2,), (3,)], "id long"))
    assert [r.id for r in kept.collect()] == [2] and {r.id: r.error for r in errors.collect()} == {2: "Cannot delete built-in presets", 3: "Preset not found"}
    log = A.audit_rows(presets, NOW, "x", "preset", F.col("id")).withColumn("id", F.col("entity_id"))
    assert A.list_audit(log, since=NOW, until=NOW)[1].head().total == 2


# --- model responses -------------------------------------------------------


def test_decisions_and_verification(spark):
    items = asked(spark, *[f"Question {i}?" for i in range(4)]).withColumn("answer_text", F.lit("before"))
    content = '{"decisions":[{"id":"q_0","action":"Answer","answer":" yes ","confidence":"1.5"},{"id":"q_1","action":"answer","answer":" "},{"id":"q_9","action":"answer","answer":"x"},{"id":"x_2","action":"answer","answer":"x"},7,{"id":"q_3","action":"shrug","answer":"x","issues":["i"],"confidence":"n"}]}'
    responses = spark.createDataFrame([(0, 1, content), (0, 2, "sorry")], "doc_id int, chunk_no long, content string")
    decisions, failed = I.normalize_decisions(responses, items)
    got = {r.question_index: (r.action, r.answer, r.confidence, r.issues) for r in decisions.collect()}
    assert got == {0: ("answer", "yes", 1.0, []), 1: ("flag", None, None, []), 3: ("flag", None, None, ["i"])}
    assert failed.head().failed_chunks == 1
    filled = I.apply_decisions(items, decisions)
    assert {r.question_index: r.answer_text for r in filled.collect()} == {0: "yes", 1: None, 2: "before", 3: None}
    chosen, context = I.verification_set(decisions)
    assert [r.question_index for r in chosen.collect()] == [0] and context.count() == 2
    stats = I.outcome_stats(items, filled, failed).head()
    assert (stats.questions_considered, stats.answers_generated, stats.flags_recommended, stats.overrides, stats.unresolved_questions, stats.status) == (4, 0, 2, 1, 2, "completed_with_warnings")


def test_verification_is_skipped_when_confident_and_capped(spark):
    rows = [(0, i, "answer", 0.9) for i in range(4)] + [(1, i, "answer", 0.9) for i in range(3)] + [(2, i, "answer", i / 100) for i in range(60)]
    decisions = spark.createDataFrame([(d, 1, i, i, a, c) for d, i, a, c in rows], "doc_id int, chunk_no long, at int, question_index int, action string, confidence double")
    chosen = I.verification_set(decisions)[0].collect()
    assert {r.doc_id for r in chosen} == {1, 2} and sorted(r.question_index for r in chosen if r.doc_id == 2) == list(range(40))


def test_classifications(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "batch_no long, pair_index int")
    responses = spark.createDataFrame([(0, '{"pairs":[{"pair_index":1},{"pair_index":8}]}'), (1, "oops")], "batch_no long, content string")
    got = {(r.batch_no, r.pair_index): (r.classification, r.reason) for r in D.apply_classifications(pairs, responses).collect()}
    assert got == {(0, 0): (None, None), (0, 1): ("probably_same", ""), (1, 0): ("probably_same", K.CLASSIFY_FAILED_REASON)}


def test_requests_are_chunked(spark):
    items = asked(spark, *[f"Question {i}?" for i in range(95)])
    found = spark.createDataFrame([], "doc_id int, question_index long, rank int, kb_id long, category string, kb_question string, kb_answer string, similarity double")
    got = {r.chunk_no: r.n_questions for r in I.fill_requests(items, found).collect()}
    assert got == {1: 40, 2: 40, 3: 15}


def test_corrections_change_the_first_decision_of_their_id(spark):
    items = spark.createDataFrame([(1, i, None) for i in range(7)], "doc_id int, question_index int, answer_text string")
    rows = [(1, 0, 0, "q_5", 5, "answer", "a", 0.9, "r"), (1, 0, 1, "q_5", 5, "answer", "b", 0.9, "r"), (1, 1, 0, "q_6", 6, "answer", "c", 0.9, "r")]
    decisions = spark.createDataFrame(rows, "doc_id int, chunk_no int, at int, id string, question_index int, action string, answer string, confidence double, reason string")
    notes = [(1, 1, "q_5", "revise", "new", "0.4", "x"), (1, 2, "q_06", "revise", "other", None, "y"), (1, 3, "bad", "flag", None, None, "z")]
    corrections = spark.createDataFrame(notes, "doc_id int, seq int, id string, action string, revised_answer string, revised_confidence string, reason string")
    after, changed = I.apply_corrections(items, decisions, corrections)
    assert {r.question_index: r.answer_text for r in after.collect() if r.answer_text} == {5: "new", 6: "other"}
    got = [(r.answer, r.confidence, r.reason) for r in changed.orderBy("chunk_no", "at").collect()]
    assert got == [("new", 0.4, "r [Revised by verification: x]"), ("b", 0.9, "r"), ("c", 0.9, "r")]
