"""Questionnaire templates made from reviewed jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from answerloom.functions import text as X
from answerloom.operators.audit import audit_rows, timestamp
from answerloom.operators.ranking import page as _page


def template_rows(results: DataFrame) -> DataFrame:
    """(job_id, question_index, question_text, answer_text) of rows with a final answer."""
    answer = X.final_answer(F.col("edited_answer_text"), F.col("answer_text"))
    return results.select("job_id", "question_index", "question_text", answer.alias("answer_text")).filter(
        F.coalesce("answer_text", F.lit("")) != ""
    )


def make_template(
    results: DataFrame, jobs: DataFrame, job_id: int, template_id: int, name: str, now, description: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(template, template_answers) from one job; ValueError without results."""
    rows = results.filter(F.col("job_id") == job_id)
    if not rows.limit(1).count():
        raise ValueError("No question results found for this job")
    answers = template_rows(rows).select(
        F.lit(template_id).cast("long").alias("template_id"), "question_text", "answer_text", "question_index",
        F.lit(None).cast("string").alias("category"), timestamp(now).alias("created_at"),
    )
    template = jobs.filter(F.col("id") == job_id).select(
        F.lit(template_id).cast("long").alias("id"), F.lit(name.strip()).alias("name"), F.lit(description).cast("string").alias("description"),
        F.col("id").alias("source_job_id"), F.col("original_filename").alias("source_filename"),
        answers.agg(F.count(F.lit(1))).scalar().alias("question_count"), F.lit(0).alias("times_used"),
        F.lit(None).cast("timestamp_ntz").alias("last_used_at"), timestamp(now).alias("created_at"), timestamp(now).alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
    )
    return template, answers


def list_templates(templates: DataFrame, page: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    rows = templates.filter(F.col("deleted_at").isNull())
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return _page(rows, [F.col("updated_at").desc(), F.col("id").desc()], page, size), total


def template_detail(templates: DataFrame, answers: DataFrame, template_id: int) -> DataFrame:
    """Answers of one live template by question index."""
    owner = templates.filter((F.col("id") == template_id) & F.col("deleted_at").isNull()).select(F.col("id").alias("template_id"))
    return answers.join(owner, "template_id", "left_semi").orderBy("question_index")


def update_templates(templates: DataFrame, changes: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(templates, audit): rename (trimmed) and re-describe by id where not null."""
    new = changes.select("id", X.strip(F.col("name")).alias("_name"), F.col("description").alias("_description"), F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull() & F.col("deleted_at").isNull()
    joined = templates.join(new, "id", "left")
    after = joined.withColumns(
        {
            "name": F.when(hit, F.coalesce("_name", "name")).otherwise(F.col("name")),
            "description": F.when(hit, F.coalesce("_description", "description")).otherwise(F.col("description")),
            "updated_at": F.when(hit, timestamp(now)).otherwise(F.col("updated_at")),
        }
    ).select(*templates.columns)
    audit = audit_rows(
        joined.filter(hit), now, "template_update", "questionnaire_template", F.col("id"),
        before=F.col("name"), after=F.coalesce("_name", "name"),
    )
    return after, audit


def update_template_answers(answers: DataFrame, changes: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(answers, audit): set the trimmed answer text by id."""
    new = changes.select("id", X.strip(F.col("answer_text")).alias("_new"))
    joined = answers.join(new, "id", "left")
    after = joined.withColumn("answer_text", F.coalesce("_new", "answer_text")).select(*answers.columns)
    audit = audit_rows(
        joined.filter(F.col("_new").isNotNull()), now, "template_answer_update", "template_answer", F.col("id"),
        before=F.col("answer_text"), after=F.col("_new"),
    )
    return after, audit


def delete_templates(templates: DataFrame, answers: DataFrame, ids: DataFrame, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(templates, answers, audit): remove templates and their answers physically."""
    gone = ids.select("id").distinct()
    removed = templates.join(gone, "id", "left_semi")
    audit = audit_rows(removed, now, "template_delete", "questionnaire_template", F.col("id"), before=F.col("name"))
    return (
        templates.join(gone, "id", "left_anti"),
        answers.join(gone.withColumnRenamed("id", "template_id"), "template_id", "left_anti").select(*answers.columns),
        audit,
    )
