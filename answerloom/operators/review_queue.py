"""Review of filled questionnaires: queue, edits, approval, finalisation, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from answerloom import constants as K
from answerloom.functions import text as X
from answerloom.functions.vectors import hashed_embedding
from answerloom.operators.audit import audit_rows, timestamp
from answerloom.operators.knowledge import exact_upsert
from answerloom.operators.ranking import page as _page
from answerloom.session import durable


def review_queue(results: DataFrame, kb: DataFrame, job_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with their source entry, totals per job); deleted entries show too."""
    rows = results if job_id is None else results.filter(F.col("job_id") == job_id)
    source = kb.select(
        F.col("id").alias("kb_pair_id"), F.struct("id", "category", "question", "answer").alias("source_kb")
    )
    totals = rows.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("reviewed").alias("reviewed"), F.count_if(~F.col("reviewed")).alias("unreviewed")
    )
    return rows.join(source, "kb_pair_id", "left").orderBy("job_id", "question_index"), totals


def review_filter(results: DataFrame, view: str = "all") -> DataFrame:
    if view == "unreviewed":
        return results.filter(~F.col("reviewed"))
    if view == "low_confidence":
        return results.filter(F.col("confidence_score") < 0.7)
    return results


def apply_edits(results: DataFrame, jobs: DataFrame, edits: DataFrame, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, jobs, audit): apply (id, edited_answer_text); touched jobs are in review."""
    known = edits.join(results.select("id", "job_id", "answer_text", F.col("edited_answer_text").alias("_old")), "id")
    new = edits.select("id", F.col("edited_answer_text").alias("_new"), F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    after = results.join(new, "id", "left").withColumns(
        {
            "edited_answer_text": F.when(hit, F.col("_new")).otherwise(F.col("edited_answer_text")),
            "reviewed": hit | F.col("reviewed"),
        }
    ).select(*results.columns)
    touched = known.select(F.col("job_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    jobs_after = jobs.join(touched, "id", "left").withColumn(
        "review_status", F.when(F.col("_hit"), "in_review").otherwise(F.col("review_status"))
    ).select(*jobs.columns)
    audit = audit_rows(
        known, now, "answer_edit", "question_result", F.col("id"), F.col("job_id"),
        before=X.final_answer(F.col("_old"), F.col("answer_text")), after=F.col("edited_answer_text"),
    )
    return after, jobs_after, audit


def approve(results: DataFrame, now, ids: DataFrame | None = None, job_id: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, summary, audit): mark rows as reviewed, by id or all open ones of a job."""
    if ids is not None:
        wanted = results.join(ids.select("id").distinct(), "id", "left_semi").select("id", "job_id")
    else:
        wanted = results.filter((F.col("job_id") == job_id) & ~F.col("reviewed")).select("id", "job_id")
    after = results.join(wanted.select("id", F.lit(True).alias("_hit")), "id", "left").withColumn(
        "reviewed", F.col("_hit").isNotNull() | F.col("reviewed")
    ).select(*results.columns)
    summary = wanted.agg(F.count(F.lit(1)).alias("approved"))
    audit = audit_rows(wanted, now, "answer_approve", "question_result", F.col("id"), F.col("job_id"))
    return after, summary, audit


def corrections_from_results(results: DataFrame, now, job_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(corrections, summary per job): edits that differ from the given answer.

    ``total_edited`` also counts edits equal to the original.
    """
    rows = results if job_id is None else results.filter(F.col("job_id") == job_id)
    edited = rows.filter(F.coalesce("edited_answer_text", F.lit("")) != "")
    changed = F.col("edited_answer_text") != F.coalesce("answer_text", F.lit(""))
    corrections = edited.filter(changed).select(
        F.col("job_id"), F.col("id").alias("question_result_id"), "question_text", F.col("answer_text").alias("original_answer"),
        F.col("edited_answer_text").alias("corrected_answer"), F.col("source").alias("original_source"),
        F.col("confidence_score").alias("original_confidence"), F.lit("manual").alias("correction_type"),
        F.lit(False).alias("auto_added_to_kb"), F.lit(None).cast("long").alias("kb_pair_id"), timestamp(now).alias("created_at"),
    )
    summary = edited.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_edited"), F.count_if(changed).alias("corrections_captured")
    )
    return corrections, summary


def feedback_to_kb(
    kb: DataFrame, corrections: DataFrame, now, min_confidence: float = K.FEEDBACK_MIN_CONFIDENCE, enabled: bool = True, embed=hashed_embedding
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kb, corrections, audit): feed corrections back by wording.

    An entry with the wording gets the answer and keeps its category; other
    wordings are added as auto-learned.
    """
    if not enabled:
        return kb, corrections, audit_rows(corrections.limit(0), now, "correction_auto_kb", "answer_correction")
    strong = durable(corrections.filter(F.coalesce("original_confidence", F.lit(0.0)) >= min_confidence))
    records = strong.select(
        F.col("question_result_id").alias("row_no"), F.col("question_text").alias("question"),
        F.col("corrected_answer").alias("answer"), F.lit(None).cast("string").alias("category"),
    )
    after, ids = exact_upsert(
        kb, records, now, new_category=F.lit(K.AUTO_LEARNED), stored_key=F.lower("question"), pick=F.min, embed=embed
    )
    linked = corrections.drop("kb_pair_id", "auto_added_to_kb").join(
        ids.select(F.col("row_no").alias("question_result_id"), F.col("kb_id").alias("kb_pair_id")), "question_result_id", "left"
    ).withColumn("auto_added_to_kb", F.col("kb_pair_id").isNotNull()).select(*corrections.columns)
    audit = audit_rows(
        strong, now, "correction_auto_kb", "answer_correction", job_id=F.col("job_id"),
        details=F.to_json(F.struct(F.substring("question_text", 1, 100).alias("question"))),
    )
    return after, linked, audit


def finalize(results: DataFrame, jobs: DataFrame, job_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(answer sheet, jobs): final answers in order; the job becomes finalized."""
    rows = results if job_id is None else results.filter(F.col("job_id") == job_id)
    sheet = rows.select(
        "job_id", "question_index", "question_text", X.final_answer(F.col("edited_answer_text"), F.col("answer_text")).alias("answer_text")
    )
    done = rows.select(F.col("job_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    after = jobs.join(done, "id", "left").withColumn(
        "review_status", F.when(F.col("_hit"), "finalized").otherwise(F.col("review_status"))
    ).select(*jobs.columns)
    return sheet, after


def list_corrections(
    corrections: DataFrame, job_id: int | None = None, auto_added: bool | None = None, page: int = 1, size: int = 20
) -> tuple[DataFrame, DataFrame]:
    rows = corrections
    if job_id is not None:
        rows = rows.filter(F.col("job_id") == job_id)
    if auto_added is not None:
        rows = rows.filter(F.col("auto_added_to_kb") == auto_added)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return _page(rows, [F.col("created_at").desc(), F.col("id").desc()], page, size), total


def correction_stats(corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, count by original source)."""
    totals = corrections.agg(
        F.count(F.lit(1)).alias("total_corrections"), F.count_if("auto_added_to_kb").alias("auto_added_to_kb")
    )
    by_source = corrections.groupBy(F.coalesce("original_source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return totals, by_source
