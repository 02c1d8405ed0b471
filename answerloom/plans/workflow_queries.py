"""Flags, review, templates, jobs, audit and request tables over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from answerloom import constants as K
from answerloom.operators import (
    audit as A, extraction as E, flags as FL, inference as I, jobs as J, matching as M, review_queue as RQ, templates as TP,
)
from answerloom.plans import checks as C
from answerloom.plans.matching_queries import ITEMS, NOW, TALK, TOP3, docs_kb, items
from answerloom.plans.registry import query
from answerloom.plans.standins import raw, table, with_vectors

stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")

# --- flagged questions -----------------------------------------------------

KEYED = f"keyed AS (SELECT f.*, {C.key('extracted_question')} AS k FROM ({{flags}}) f)"
GROUPS = f"""{KEYED}, groups AS (SELECT id, {C.clean('extracted_question')} AS extracted_question, k AS normalized_question, context, similarity_score, best_match_question,
    bool_and(resolved) OVER w AS resolved, resolved_answer, resolved_at, created_at, count(*) OVER w AS occurrence_count, row_number() OVER (PARTITION BY k ORDER BY created_at DESC, id DESC) AS rn
    FROM keyed WINDOW w AS (PARTITION BY k)), jc AS (SELECT k, count(DISTINCT job_id) AS job_count FROM keyed GROUP BY k)"""


@query(
    "grouped_flags",
    f"""WITH {GROUPS} SELECT id, extracted_question, normalized_question, context, similarity_score, best_match_question, resolved, resolved_answer, {C.stamp('resolved_at')} AS resolved_at,
        {C.stamp('created_at')} AS created_at, occurrence_count, job_count FROM groups JOIN jc ON k = normalized_question WHERE rn = 1""",
)
def grouped_flags(spark, d):
    groups = FL.grouped_flags(table(spark, d, "flags"), table(spark, d, "doc_jobs"))[0]
    return groups.withColumns({"resolved_at": stamp("resolved_at"), "created_at": stamp("created_at")})


@query(
    "flag_sources",
    f"""WITH {KEYED} SELECT k AS normalized_question, job_id, min(concat(best_match_question, '_', context, '.csv')) AS filename, max(id) AS newest_id FROM keyed WHERE NOT resolved GROUP BY k, job_id""",
)
def flag_sources(spark, d):
    return FL.grouped_flags(table(spark, d, "flags"), table(spark, d, "doc_jobs"), resolved=False)[1].drop("newest_at")


@query(
    "flag_view",
    f"""WITH {GROUPS}, named AS (SELECT DISTINCT k FROM keyed WHERE contains(concat(best_match_question, '_', context, '.csv'), 'src1'))
    SELECT id, normalized_question FROM groups WHERE rn = 1 AND resolved AND coalesce(resolved_answer <> '[Dismissed]', true)
      AND (contains(lower(extracted_question), 'src1') OR contains(lower(best_match_question), 'src1') OR contains(lower(coalesce(resolved_answer, '')), 'src1') OR normalized_question IN (SELECT k FROM named))""",
)
def flag_view(spark, d):
    groups, sources = FL.grouped_flags(table(spark, d, "flags"), table(spark, d, "doc_jobs"))
    return FL.flag_view(groups, sources, "resolved", " SRC1 ").select("id", "normalized_question")


SYNC = f"""{KEYED}, kb AS (SELECT {C.key('question')} AS k, answer FROM ({{kb_lines}}) l WHERE deleted_at IS NULL QUALIFY row_number() OVER (PARTITION BY {C.key('question')} ORDER BY updated_at DESC NULLS LAST, id DESC) = 1)"""


@query("sync_flags", f"WITH {SYNC} SELECT id, resolved OR answer IS NOT NULL AS resolved, CASE WHEN NOT resolved AND answer IS NOT NULL THEN answer ELSE resolved_answer END AS resolved_answer FROM keyed LEFT JOIN kb USING (k)")
def sync_flags(spark, d):
    return FL.sync_flags(table(spark, d, "flags"), table(spark, d, "kb_lines"), NOW)[0].select("id", "resolved", "resolved_answer")


@query(
    "sync_summary",
    f"""WITH {SYNC} SELECT count(*) AS scanned_occurrences, count(answer) AS synced_occurrences, count(DISTINCT CASE WHEN answer IS NOT NULL THEN k END) AS synced_groups, count(*) - count(answer) AS remaining_unresolved
        FROM keyed LEFT JOIN kb USING (k) WHERE NOT resolved""",
)
def sync_summary(spark, d):
    return FL.sync_flags(table(spark, d, "flags"), table(spark, d, "kb_lines"), NOW)[1]


@query("dedupe_flags", f"WITH {KEYED} SELECT min(id) AS id FROM keyed GROUP BY k, job_id")
def dedupe_flags(spark, d):
    return FL.dedupe_flags(table(spark, d, "flags"))[0].select("id")


@query("dedupe_summary", f"WITH {KEYED} SELECT count(*) AS total_before, count(*) - count(DISTINCT (k, job_id)) AS duplicates_removed, count(DISTINCT (k, job_id)) AS total_after FROM keyed")
def dedupe_summary(spark, d):
    return FL.dedupe_flags(table(spark, d, "flags"))[1]


@query("purge_dismissed", "SELECT id FROM ({flags}) f WHERE resolved_answer IS NULL OR resolved_answer <> '[Dismissed]'")
def purge_dismissed(spark, d):
    return FL.purge_dismissed(table(spark, d, "flags"), NOW)[0].select("id")


def _resolutions(spark, d) -> DataFrame:
    """Every labelled document resolves its first line; good ones go to the knowledge base."""
    rows = raw(spark, d, "labels").join(raw(spark, d, "documents"), "doc_id")
    return rows.select(
        (F.col("doc_id") * 4294967296).alias("flag_id"), F.concat(F.lit("Resolved by "), "source").alias("answer"), (F.col("quality") == 0).alias("add_to_kb"),
        F.when(F.col("lang") != "es", F.concat(F.lit(" "), "lang")).alias("category"),
    )


RESOLVE = f"""{KEYED}, res AS (SELECT doc_id * 4294967296 AS flag_id, concat('Resolved by ', source) AS answer, quality = 0 AS add_to_kb, CASE WHEN lang <> 'es' THEN lang END AS category FROM labels JOIN documents USING (doc_id)),
    turn AS (SELECT r.*, f.k, row_number() OVER (PARTITION BY f.k ORDER BY flag_id) AS nth, (SELECT count(*) FROM keyed o WHERE o.k = f.k AND NOT o.resolved) AS n FROM res r JOIN keyed f ON f.id = r.flag_id),
    good AS (SELECT * FROM turn WHERE nth = 1 AND n > 0 AND NOT (add_to_kb AND category IS NULL))"""


@query(
    "resolve_flags",
    f"""WITH {RESOLVE} SELECT f.id, f.resolved OR g.k IS NOT NULL AS resolved, CASE WHEN NOT f.resolved AND g.k IS NOT NULL THEN g.answer ELSE f.resolved_answer END AS resolved_answer,
      CASE WHEN NOT f.resolved AND g.add_to_kb AND g.category = 'en' THEN 'en@example.com' END AS assigned_to FROM keyed f LEFT JOIN good g USING (k)""",
)
def resolve_flags(spark, d):
    kb = with_vectors(table(spark, d, "kb_lines"))
    after = FL.resolve_flags(table(spark, d, "flags"), kb, _resolutions(spark, d), NOW, {"en": "en@example.com"})[0]
    return after.select("id", "resolved", "resolved_answer", "assigned_to")


@query(
    "resolve_flags_kb",
    f"""WITH {RESOLVE}, kb AS (SELECT * FROM ({{kb_lines}}) l), known AS (SELECT {C.exact_key('question')} AS w, max(id) AS target FROM kb WHERE deleted_at IS NULL GROUP BY ALL),
    words AS (SELECT f.extracted_question AS question, min(f.id) AS row_no, any_value(g.answer) AS answer, any_value(g.category) AS category FROM keyed f JOIN good g USING (k) WHERE NOT f.resolved AND g.add_to_kb GROUP BY f.k, f.extracted_question),
    fold AS (SELECT {C.exact_key('question')} AS w, arg_max(answer, row_no) AS answer, arg_max(category, row_no) AS category, arg_max(question, row_no) AS question, min(row_no) AS row_no FROM words GROUP BY ALL),
    hit AS (SELECT * FROM fold LEFT JOIN known USING (w))
    SELECT kb.id, coalesce(h.category, kb.category) AS category, coalesce(h.question, kb.question) AS question, coalesce(h.answer, kb.answer) AS answer FROM kb LEFT JOIN hit h ON h.target = kb.id
    UNION ALL SELECT (SELECT max(id) FROM kb) + row_number() OVER (ORDER BY row_no), category, question, answer FROM hit WHERE target IS NULL""",
)
def resolve_flags_kb(spark, d):
    kb = with_vectors(table(spark, d, "kb_lines"))
    return FL.resolve_flags(table(spark, d, "flags"), kb, _resolutions(spark, d), NOW)[1].select("id", "category", "question", "answer")


@query(
    "resolve_flags_errors",
    f"""WITH {RESOLVE} SELECT flag_id, CASE WHEN n = 0 OR nth > 1 THEN 'Already resolved' ELSE 'Category is required' END AS error FROM turn WHERE n = 0 OR nth > 1 OR (add_to_kb AND category IS NULL)""",
)
def resolve_flags_errors(spark, d):
    kb = with_vectors(table(spark, d, "kb_lines"))
    return FL.resolve_flags(table(spark, d, "flags"), kb, _resolutions(spark, d), NOW)[3]


def _dismissals(spark, d) -> DataFrame:
    """Supplier s dismisses line s of document 3 s, where the document has that many lines."""
    return raw(spark, d, "supplier").select((F.col("s_suppkey") * (3 * 4294967296 + 1)).alias("id"))


DISMISS = f"""{KEYED}, want AS (SELECT s_suppkey * (3 * 4294967296 + 1) AS id FROM supplier), hit AS (SELECT DISTINCT k FROM keyed JOIN want USING (id))"""


@query(
    "dismiss_flags",
    f"""WITH {DISMISS} SELECT id, resolved OR h.k IS NOT NULL AS resolved, CASE WHEN NOT resolved AND h.k IS NOT NULL THEN '[Dismissed]' ELSE resolved_answer END AS resolved_answer FROM keyed LEFT JOIN hit h USING (k)""",
)
def dismiss_flags(spark, d):
    return FL.dismiss_flags(table(spark, d, "flags"), _dismissals(spark, d), NOW)[0].select("id", "resolved", "resolved_answer")


@query(
    "dismiss_summary",
    f"""WITH {DISMISS}, g AS (SELECT k, count(*) FILTER (NOT resolved) AS n FROM keyed JOIN hit USING (k) GROUP BY k) SELECT (SELECT count(DISTINCT id) FROM want) AS requested_ids, count(*) FILTER (n > 0) AS dismissed_groups,
        CAST(sum(n) AS BIGINT) AS dismissed_occurrences, count(*) FILTER (n = 0) AS already_resolved_groups, (SELECT count(*) FROM want WHERE id NOT IN (SELECT id FROM keyed)) AS not_found_ids FROM g""",
)
def dismiss_summary(spark, d):
    return FL.dismiss_flags(table(spark, d, "flags"), _dismissals(spark, d), NOW)[1]


@query("flag_detail", f"WITH {KEYED} SELECT id, {C.clean('extracted_question')} AS extracted_question, k AS normalized_question, concat(best_match_question, '_', context, '.csv') AS filename, job_id FROM keyed")
def flag_detail(spark, d):
    return FL.flag_detail(table(spark, d, "flags"), table(spark, d, "doc_jobs")).select(
        "id", "extracted_question", "normalized_question", "filename", "job_id"
    )


# --- review ----------------------------------------------------------------

@query(
    "review_queue",
    """SELECT r.id, r.job_id, r.question_index, k.id AS kb_id, k.question AS kb_question FROM ({results}) r LEFT JOIN ({kb_parts}) k ON k.id = r.kb_pair_id""",
)
def review_queue(spark, d):
    rows = RQ.review_queue(table(spark, d, "results"), table(spark, d, "kb_parts"))[0]
    return rows.select("id", "job_id", F.col("question_index").cast("long").alias("question_index"), F.col("source_kb.id").alias("kb_id"), F.col("source_kb.question").alias("kb_question"))


@query("review_totals", "SELECT job_id, count(*) AS total, count(*) FILTER (reviewed) AS reviewed, count(*) FILTER (NOT reviewed) AS unreviewed FROM ({results}) r GROUP BY job_id")
def review_totals(spark, d):
    return RQ.review_queue(table(spark, d, "results"), table(spark, d, "kb_parts"))[1]


@query("review_filter", "SELECT id FROM ({results}) r WHERE NOT reviewed AND confidence_score < 0.7")
def review_filter(spark, d):
    return RQ.review_filter(RQ.review_filter(table(spark, d, "results"), "low_confidence"), "unreviewed").select("id")


def _edits(spark, d) -> DataFrame:
    return table(spark, d, "results").filter("source = 'unmatched'").select("id", F.concat(F.lit("Edit of "), "question_text").alias("edited_answer_text"))


@query("apply_edits", "SELECT id, CASE WHEN source = 'unmatched' THEN concat('Edit of ', question_text) ELSE edited_answer_text END AS edited_answer_text, reviewed OR source = 'unmatched' AS reviewed FROM ({results}) r")
def apply_edits(spark, d):
    return RQ.apply_edits(table(spark, d, "results"), table(spark, d, "order_jobs"), _edits(spark, d), NOW)[0].select("id", "edited_answer_text", "reviewed")


@query("apply_edits_jobs", "SELECT id, CASE WHEN id IN (SELECT job_id FROM ({results}) r WHERE source = 'unmatched') THEN 'in_review' ELSE 'pending' END AS review_status FROM ({order_jobs}) j")
def apply_edits_jobs(spark, d):
    return RQ.apply_edits(table(spark, d, "results"), table(spark, d, "order_jobs"), _edits(spark, d), NOW)[1].select("id", "review_status")


@query("apply_edits_audit", "SELECT id AS entity_id, job_id, coalesce(edited_answer_text, answer_text) AS before_value, concat('Edit of ', question_text) AS after_value FROM ({results}) r WHERE source = 'unmatched'")
def apply_edits_audit(spark, d):
    return RQ.apply_edits(table(spark, d, "results"), table(spark, d, "order_jobs"), _edits(spark, d), NOW)[2].select("entity_id", "job_id", "before_value", "after_value")


@query("approve", "SELECT id, reviewed OR confidence_score >= 0.5 AS reviewed FROM ({results}) r WHERE confidence_score IS NOT NULL UNION ALL SELECT id, reviewed FROM ({results}) r WHERE confidence_score IS NULL")
def approve(spark, d):
    rows = table(spark, d, "results")
    return RQ.approve(rows, NOW, ids=rows.filter("confidence_score >= 0.5").select("id"))[0].select("id", "reviewed")


@query("corrections_from_results", "SELECT job_id, id AS question_result_id, answer_text AS original_answer, edited_answer_text AS corrected_answer, source AS original_source FROM ({results}) r WHERE edited_answer_text <> coalesce(answer_text, '')")
def corrections_from_results(spark, d):
    return RQ.corrections_from_results(table(spark, d, "results"), NOW)[0].select("job_id", "question_result_id", "original_answer", "corrected_answer", "original_source")


@query("edit_counts", "SELECT job_id, count(*) AS total_edited, count(*) FILTER (edited_answer_text <> coalesce(answer_text, '')) AS corrections_captured FROM ({results}) r WHERE edited_answer_text <> '' GROUP BY job_id")
def edit_counts(spark, d):
    return RQ.corrections_from_results(table(spark, d, "results"), NOW)[1]


FEEDBACK = """cor AS (SELECT id AS rid, question_text, edited_answer_text AS answer, lower(question_text) AS w FROM ({results}) r WHERE edited_answer_text <> coalesce(answer_text, '') AND coalesce(confidence_score, 0) >= 0.4),
    kb AS (SELECT * FROM ({kb_parts}) k), known AS (SELECT lower(question) AS w, min(id) AS target FROM kb WHERE deleted_at IS NULL GROUP BY ALL),
    fold AS (SELECT w, arg_max(answer, rid) AS answer, arg_min(question_text, rid) AS question, min(rid) AS rid FROM cor GROUP BY w), hit AS (SELECT * FROM fold LEFT JOIN known USING (w)),
    fresh AS (SELECT *, (SELECT max(id) FROM kb) + row_number() OVER (ORDER BY rid) AS id FROM hit WHERE target IS NULL)"""


def _feedback(spark, d):
    corrections = RQ.corrections_from_results(table(spark, d, "results"), NOW)[0]
    kb = with_vectors(table(spark, d, "kb_parts"))
    return RQ.feedback_to_kb(kb, corrections, NOW, 0.4)


@query(
    "feedback_to_kb",
    f"""WITH {FEEDBACK} SELECT kb.id, kb.category, kb.question, coalesce(h.answer, kb.answer) AS answer FROM kb LEFT JOIN hit h ON h.target = kb.id UNION ALL SELECT id, 'Auto-Learned', question, answer FROM fresh""",
)
def feedback_to_kb(spark, d):
    return _feedback(spark, d)[0].select("id", "category", "question", "answer")


@query(
    "feedback_corrections",
    f"""WITH {FEEDBACK} SELECT r.id AS question_result_id, coalesce(h.target, f.id) AS kb_pair_id, coalesce(h.target, f.id) IS NOT NULL AS auto_added_to_kb FROM ({{results}}) r LEFT JOIN cor c ON c.rid = r.id LEFT JOIN hit h ON h.w = c.w LEFT JOIN fresh f ON f.w = c.w
        WHERE r.edited_answer_text <> coalesce(r.answer_text, '')""",
)
def feedback_corrections(spark, d):
    return _feedback(spark, d)[1].select("question_result_id", "kb_pair_id", "auto_added_to_kb")


@query("finalize", "SELECT job_id, CAST(question_index AS BIGINT) AS question_index, question_text, coalesce(nullif(edited_answer_text, ''), answer_text) AS answer_text FROM ({results}) r")
def finalize(spark, d):
    sheet = RQ.finalize(table(spark, d, "results"), table(spark, d, "order_jobs"))[0]
    return sheet.withColumn("question_index", F.col("question_index").cast("long"))


@query("list_corrections", "SELECT id, corrected_answer FROM ({corrections}) c WHERE auto_added_to_kb = false ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 25")
def list_corrections(spark, d):
    return RQ.list_corrections(table(spark, d, "corrections"), auto_added=False, page=2, size=25)[0].select("id", "corrected_answer")


@query("correction_stats", "SELECT coalesce(original_source, 'unknown') AS source, count(*) AS n FROM ({corrections}) c GROUP BY ALL UNION ALL SELECT ':total', count(*) FROM ({corrections}) c UNION ALL SELECT ':auto', count(*) FILTER (auto_added_to_kb) FROM ({corrections}) c")
def correction_stats(spark, d):
    totals, by_source = RQ.correction_stats(table(spark, d, "corrections"))
    return by_source.unionByName(totals.select(F.lit(":total").alias("source"), F.col("total_corrections").alias("n"))).unionByName(
        totals.select(F.lit(":auto").alias("source"), F.col("auto_added_to_kb").alias("n"))
    )


# --- templates -------------------------------------------------------------

@query("template_rows", "SELECT job_id, CAST(question_index AS BIGINT) AS question_index, question_text, coalesce(edited_answer_text, answer_text) AS answer_text FROM ({results}) r WHERE coalesce(edited_answer_text, answer_text) IS NOT NULL")
def template_rows(spark, d):
    return TP.template_rows(table(spark, d, "results")).withColumn("question_index", F.col("question_index").cast("long"))


@query("list_templates", "SELECT id, name FROM ({templates}) t WHERE deleted_at IS NULL ORDER BY updated_at DESC, id DESC LIMIT 40 OFFSET 80")
def list_templates(spark, d):
    return TP.list_templates(table(spark, d, "templates"), 3, 40)[0].select("id", "name")


@query("template_detail", "SELECT id, question_text, question_index FROM ({template_answers}) t WHERE template_id = 7 AND template_id IN (SELECT id FROM ({templates}) p WHERE deleted_at IS NULL)")
def template_detail(spark, d):
    return TP.template_detail(table(spark, d, "templates"), table(spark, d, "template_answers"), 7).select("id", "question_text", "question_index")


def _template_changes(spark, d) -> DataFrame:
    return raw(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") > 10, F.concat(F.lit("  "), "s_name", F.lit(" "))).alias("name"),
        F.when(F.col("s_nationkey") < 15, F.lit("changed")).alias("description"), F.concat(F.lit(" "), "s_name").alias("answer_text"),
    )


@query(
    "update_templates",
    """SELECT t.id, CASE WHEN s_nationkey > 10 AND deleted_at IS NULL THEN s_name ELSE name END AS name, CASE WHEN s_nationkey < 15 AND deleted_at IS NULL THEN 'changed' ELSE description END AS description FROM ({templates}) t LEFT JOIN supplier ON s_suppkey = id""",
)
def update_templates(spark, d):
    return TP.update_templates(table(spark, d, "templates"), _template_changes(spark, d), NOW)[0].select("id", "name", "description")


@query("update_template_answers", "SELECT id, coalesce(s_name, answer_text) AS answer_text FROM ({template_answers}) t LEFT JOIN supplier ON s_suppkey = id")
def update_template_answers(spark, d):
    return TP.update_template_answers(table(spark, d, "template_answers"), _template_changes(spark, d), NOW)[0].select("id", "answer_text")


@query("delete_templates", "SELECT id FROM ({template_answers}) t WHERE template_id NOT IN (SELECT n_nationkey FROM nation)")
def delete_templates(spark, d):
    gone = raw(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return TP.delete_templates(table(spark, d, "templates"), table(spark, d, "template_answers"), gone, NOW)[1].select("id")


# --- jobs, audit, presets --------------------------------------------------

@query("list_jobs", "SELECT id, status FROM ({order_jobs}) j ORDER BY uploaded_at DESC, id DESC LIMIT 50 OFFSET 100")
def list_jobs(spark, d):
    return J.list_jobs(table(spark, d, "order_jobs"), 3, 50)[0].select("id", "status")


@query("batch_jobs", "SELECT id, status FROM ({order_jobs}) j WHERE batch_id = 11")
def batch_jobs(spark, d):
    return J.batch_jobs(table(spark, d, "order_jobs"), 11).select("id", "status")


NEEDS = "(status = 'done' AND (coalesce(flagged_questions_count, 0) > 0 OR fallback_recommended OR total_questions = 0))"


@query("needs_review", f"SELECT id, {NEEDS} AS needs_review FROM ({{order_jobs}}) j")
def needs_review(spark, d):
    return table(spark, d, "order_jobs").select("id", J.needs_review().alias("needs_review"))


@query(
    "batch_summary",
    f"""SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'done') AS done_count, count(*) FILTER (status = 'error') AS error_count, count(*) FILTER (status = 'processing') AS processing_count,
        count(*) FILTER (status = 'pending') AS pending_count, CAST(sum(matched_questions) AS BIGINT) AS matched_total, CAST(sum(flagged_questions_count) AS BIGINT) AS flagged_total, CAST(sum(total_questions) AS BIGINT) AS found_total,
        bool_or(status = 'error' OR {NEEDS}) AS needs_attention, count(*) FILTER (status IN ('done', 'error')) AS completed_count,
        CAST(floor(count(*) FILTER (status IN ('done', 'error')) * 100.0 / count(*) + 0.5) AS INTEGER) AS progress_percent FROM ({{order_jobs}}) j GROUP BY batch_id""",
)
def batch_summary(spark, d):
    return J.batch_summary(table(spark, d, "order_jobs"))


@query(
    "trace_timeline",
    """SELECT batch_id, job_id, seq, CAST(n AS INTEGER) AS from_end FROM (SELECT j.batch_id, t.job_id, t.seq, row_number() OVER (PARTITION BY j.batch_id ORDER BY t.timestamp DESC, t.job_id DESC, t.seq DESC) AS n FROM ({trace}) t JOIN ({order_jobs}) j ON j.id = t.job_id) x WHERE n <= 160""",
)
def trace_timeline(spark, d):
    return J.trace_timeline(table(spark, d, "trace"), table(spark, d, "order_jobs")).select("batch_id", "job_id", "seq", "from_end")


@query("job_trace", "SELECT job_id, seq FROM ({trace}) t QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) <= 120")
def job_trace(spark, d):
    return J.job_trace(table(spark, d, "trace")).select("job_id", "seq")


@query(
    "append_trace",
    """SELECT job_id, seq, step FROM ({trace}) t UNION ALL SELECT j.id, 1 + coalesce((SELECT max(seq) FROM ({trace}) t WHERE t.job_id = j.id), 0), 'finish' FROM ({order_jobs}) j""",
)
def append_trace(spark, d):
    events = table(spark, d, "order_jobs").select(
        F.col("id").alias("job_id"), F.lit(1).cast("long").alias("seq"), F.col("uploaded_at").alias("timestamp"), F.lit("finish").alias("step"),
        "status", F.lit("").alias("message"),
    )
    return J.append_trace(table(spark, d, "trace"), events).select("job_id", "seq", "step")


@query(
    "audit_rows",
    """SELECT event_id AS entity_id, concat('log_', event_type) AS action_type, '{"value":' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '}' AS details, props AS after_value, 'user' AS actor FROM events""",
)
def audit_rows(spark, d):
    rows = A.audit_rows(
        raw(spark, d, "events"), NOW, F.concat(F.lit("log_"), "event_type"), "event", F.col("event_id"),
        details=F.to_json(F.struct(F.floor("value").cast("long").alias("value"))), after=F.col("props"),
    )
    return rows.select("entity_id", "action_type", "details", "after_value", "actor")


@query(
    "list_audit",
    """SELECT id, action_type FROM ({audit}) a WHERE action_type = 'click' AND timestamp >= TIMESTAMP '2024-01-02 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY timestamp DESC, id DESC LIMIT 50 OFFSET 50""",
)
def list_audit(spark, d):
    rows = A.list_audit(table(spark, d, "audit"), action_type="click", since="2024-01-02 00:00:00", until="2024-01-20 00:00:00", page=2)[0]
    return rows.select("id", "action_type")


@query("list_presets", "SELECT id, name, is_builtin FROM ({presets}) p")
def list_presets(spark, d):
    return J.list_presets(table(spark, d, "presets")).select("id", "name", "is_builtin")


@query(
    "edit_presets",
    """SELECT id, name, instructions FROM ({presets}) p WHERE is_builtin OR id NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 1000000 + s_suppkey, s_name, 'Use it' FROM supplier""",
)
def edit_presets(spark, d):
    supplier = raw(spark, d, "supplier")
    new = supplier.select((F.col("s_suppkey") + 1000000).alias("id"), F.concat(F.lit(" "), "s_name").alias("name"), F.lit(" Use it ").alias("instructions"))
    kept = J.delete_presets(table(spark, d, "presets"), supplier.select(F.col("s_suppkey").alias("id")))[0]
    return J.add_presets(kept, new, NOW).select("id", "name", "instructions")


# --- request tables --------------------------------------------------------

@query(
    "fill_requests",
    f"""WITH {ITEMS}, numbered AS (SELECT doc_id, question_index, (row_number() OVER (PARTITION BY doc_id ORDER BY question_index) + 39) // 40 AS chunk_no FROM items),
    parts AS (SELECT DISTINCT question, min(id) OVER (PARTITION BY question) AS kb_id FROM ({{kb_parts}}) k)
    SELECT doc_id, chunk_no, CAST(count(*) AS INTEGER) AS n_questions, CAST(sum(question_index) AS BIGINT) AS index_sum, CAST(sum(p.kb_id) AS BIGINT) AS kb_sum
    FROM numbered JOIN items i USING (doc_id, question_index) LEFT JOIN parts p ON p.question = i.question_text GROUP BY ALL""",
)
def fill_requests(spark, d):
    rows = items(spark, d)
    parts = table(spark, d, "kb_parts")
    low = parts.groupBy("question").agg(F.min(F.struct("id", "category", "answer")).alias("p"))
    found = rows.join(low.withColumnRenamed("question", "question_text"), "question_text").select(
        "doc_id", "question_index", F.lit(1).alias("rank"), F.col("p.id").alias("kb_id"), F.col("p.category").alias("category"),
        F.col("question_text").alias("kb_question"), F.col("p.answer").alias("kb_answer"), F.lit(1.0).alias("similarity"),
    )
    requests = I.fill_requests(rows, found, routed=rows.filter("answer_text IS NOT NULL"), instructions="Be short.")
    body = F.from_json("payload", "struct<questions:array<struct<id:string,kb_candidates:array<struct<id:long>>>>>")
    indexes = F.aggregate(body["questions"], F.lit(0).cast("long"), lambda s, q: s + F.substring_index(q["id"], "_", -1).cast("long"))
    ids = F.aggregate(body["questions"], F.lit(0).cast("long"), lambda s, q: s + F.coalesce(F.get(q["kb_candidates"], F.lit(0))["id"], F.lit(0)))
    return requests.select("doc_id", "chunk_no", "n_questions", indexes.alias("index_sum"), ids.alias("kb_sum"))


def _responses(spark, d) -> DataFrame:
    """One response per order: a decision per line, some of them unusable."""
    line = table(spark, d, "results")
    ident = F.when(F.col("question_index") == 3, "q_999").when(F.col("question_index") == 4, "item_4").otherwise(F.concat(F.lit("q_"), F.col("question_index").cast("string")))
    action = F.when(F.col("source") == "template", "ANSWER ").when(F.col("source") == "kb_match", "answer").otherwise("think")
    answer = F.when(F.col("source") == "template", F.concat(F.lit(" "), "edited_answer_text")).when(F.col("reviewed"), " ").otherwise("Given")
    decision = F.to_json(F.struct(
        ident.alias("id"), action.alias("action"), answer.alias("answer"), (F.col("confidence_score") * 2).alias("confidence"), F.col("source").alias("reason"),
        F.when(F.col("reviewed"), F.array(F.lit("check"))).alias("issues"),
    ))
    chunks = line.groupBy("job_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("question_index", decision.alias("j")))), lambda x: x["j"]), ",").alias("body"))
    status = table(spark, d, "order_jobs").select(F.col("id").alias("job_id"), "status")
    content = F.when(F.col("status") == "pending", F.lit("no answer")).otherwise(F.concat(F.lit('```json\n{"decisions":['), "body", F.lit("]}\n```")))
    return chunks.join(status, "job_id").select(F.col("job_id").alias("doc_id"), F.lit(1).cast("long").alias("chunk_no"), content.alias("content"))


DECIDED = """decided AS (SELECT r.job_id AS doc_id, r.question_index, CASE WHEN source = 'template' OR (source = 'kb_match' AND NOT reviewed) THEN 'answer' ELSE 'flag' END AS action,
    CASE WHEN source = 'template' THEN edited_answer_text WHEN source = 'kb_match' AND NOT reviewed THEN 'Given' END AS answer, CASE WHEN confidence_score IS NOT NULL THEN least(1.0, confidence_score * 2) END AS confidence, source AS reason, reviewed
    FROM ({results}) r JOIN ({order_jobs}) j ON j.id = r.job_id WHERE j.status <> 'pending' AND question_index NOT IN (3, 4))"""


def _decided(spark, d):
    line_items = table(spark, d, "results").select(F.col("job_id").alias("doc_id"), "question_index", "question_text", "answer_text")
    return I.normalize_decisions(_responses(spark, d), line_items), line_items


@query("normalize_decisions", f"WITH {DECIDED} SELECT doc_id, CAST(question_index AS BIGINT) AS question_index, action, answer, confidence, reason, CASE WHEN reviewed THEN 1 ELSE 0 END AS n_issues FROM decided")
def normalize_decisions(spark, d):
    decisions = _decided(spark, d)[0][0]
    return decisions.select("doc_id", F.col("question_index").cast("long").alias("question_index"), "action", "answer", "confidence", "reason", F.size("issues").alias("n_issues"))


@query("failed_chunks", "SELECT j.id AS doc_id, CASE WHEN status = 'pending' THEN 1 ELSE 0 END AS failed_chunks FROM ({order_jobs}) j WHERE id IN (SELECT job_id FROM ({results}) r)")
def failed_chunks(spark, d):
    return _decided(spark, d)[0][1].withColumn("failed_chunks", F.col("failed_chunks").cast("int"))


@query(
    "verification_set",
    f"""WITH {DECIDED}, means AS (SELECT doc_id, avg(confidence) AS m, count(confidence) AS n FROM decided WHERE action = 'answer' GROUP BY doc_id)
    SELECT doc_id, CAST(question_index AS BIGINT) AS question_index, coalesce(confidence, 0) AS confidence FROM decided WHERE action = 'answer' AND doc_id NOT IN (SELECT doc_id FROM means WHERE m >= 0.78 AND n > 3)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(confidence, 0), question_index) <= 40""",
)
def verification_set(spark, d):
    chosen = I.verification_set(_decided(spark, d)[0][0])[0]
    return chosen.select("doc_id", F.col("question_index").cast("long").alias("question_index"), "confidence")


def _checked(spark, d):
    (decisions, failed), before = _decided(spark, d)
    filled = I.apply_decisions(before, decisions)
    notes = decisions.filter("action = 'answer'").select(
        "doc_id", F.col("question_index").cast("long").alias("seq"), F.concat(F.lit("q_"), F.col("question_index").cast("string")).alias("id"),
        F.when(F.col("reason") == "template", "REVISE").when(F.col("question_index") < 2, "flag").otherwise("keep").alias("action"),
        F.when(F.col("question_index") != 1, "Checked").alias("revised_answer"), F.when(F.col("question_index") > 0, "0.5").alias("revised_confidence"), F.lit("why").alias("reason"),
    )
    return I.apply_corrections(filled, decisions, notes), before, failed


CHECKED = f"""{DECIDED}, noted AS (SELECT *, CASE WHEN action <> 'answer' THEN 'none' WHEN reason = 'template' AND question_index <> 1 THEN 'revise' WHEN reason <> 'template' AND question_index < 2 THEN 'flag' ELSE 'none' END AS what FROM decided)"""


@query(
    "apply_corrections",
    f"""WITH {CHECKED} SELECT doc_id, CAST(question_index AS BIGINT) AS question_index, CASE what WHEN 'flag' THEN 'flag' ELSE action END AS action, CASE what WHEN 'revise' THEN 'Checked' WHEN 'flag' THEN NULL ELSE answer END AS answer,
      CASE WHEN what = 'revise' AND question_index > 0 THEN 0.5 ELSE confidence END AS confidence,
      CASE what WHEN 'revise' THEN concat(reason, ' [Revised by verification: why]') WHEN 'flag' THEN concat(reason, ' [Flagged by verification: why]') ELSE reason END AS reason FROM noted""",
)
def apply_corrections(spark, d):
    decisions = _checked(spark, d)[0][1]
    return decisions.select("doc_id", F.col("question_index").cast("long").alias("question_index"), "action", "answer", "confidence", "reason")


@query(
    "outcome_stats",
    f"""WITH {CHECKED}, moved AS (SELECT r.job_id AS doc_id, lower(r.question_text) AS w, r.answer_text AS b, CASE WHEN n.doc_id IS NULL THEN r.answer_text WHEN what = 'revise' THEN 'Checked' WHEN what = 'flag' THEN NULL ELSE n.answer END AS a
      FROM ({{results}}) r LEFT JOIN noted n ON n.doc_id = r.job_id AND n.question_index = r.question_index)
    SELECT doc_id, count(DISTINCT w) AS questions_considered, count(*) FILTER (b IS NULL AND a IS NOT NULL) AS answers_generated, count(*) FILTER (a IS NULL) AS unresolved_questions,
      count(*) FILTER (b IS NOT NULL AND a IS NULL) AS flags_recommended, count(*) FILTER (b <> a) AS overrides, CASE WHEN any_value(status) = 'pending' THEN 'completed_with_warnings' ELSE 'completed' END AS status
    FROM moved JOIN ({{order_jobs}}) j ON j.id = doc_id GROUP BY doc_id""",
)
def outcome_stats(spark, d):
    (after, _), before, failed = _checked(spark, d)
    return I.outcome_stats(before, after, failed).drop("kb_routed", "failed_chunks")


@query(
    "token_usage",
    """SELECT conv_id AS doc_id, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN greatest(1, length(text) // 4) ELSE 0 END) AS BIGINT) AS output_tokens, count(*) AS llm_calls FROM conversations GROUP BY conv_id""",
)
def token_usage(spark, d):
    rows = raw(spark, d, "conversations")
    one = rows.select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("question_index"), F.lit("?").alias("question_text"), F.lit("x").alias("answer_text")).distinct()
    calls = rows.select(F.col("conv_id").alias("doc_id"), F.col("text").alias("request"), F.when(F.col("role") == "assistant", F.col("text")).alias("response"))
    return I.outcome_stats(one, one, calls=calls).select("doc_id", "input_tokens", "output_tokens", "llm_calls")
