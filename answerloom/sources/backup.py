"""Backup to CSV and restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

# Tables, in restore order, and typed columns.
TABLES = [
    "qa_pairs", "processing_jobs", "agent_presets", "questionnaire_templates", "format_fingerprints",
    "audit_logs", "flagged_questions", "question_results", "answer_corrections", "template_answers",
]
DATETIME_COLUMNS = [
    "created_at", "updated_at", "deleted_at", "uploaded_at", "completed_at", "resolved_at", "last_used_at", "timestamp",
]
BOOLEAN_COLUMNS = ["resolved", "reviewed", "is_builtin", "fallback_recommended", "auto_added_to_kb"]
TRUE_WORDS = ["1", "true", "t", "yes"]
DATETIME_FORMATS = ["yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss"]
SKIPPED_COLUMNS = ["embedding"]
SUMMARY = "table string, rows long, status string"


def _flat(df: DataFrame) -> list[Column]:
    columns = []
    for field in df.schema.fields:
        if field.name in SKIPPED_COLUMNS:
            continue
        column = F.col(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            column = F.to_json(column)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        columns.append(column.cast("string").alias(field.name))
    return columns


def flat_table(table: DataFrame) -> DataFrame:
    """A table as it is backed up: all text, without vectors."""
    return table.select(*_flat(table))


def backup_tables(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write each known table as CSV and report (table, rows, status); rows are counted by the write itself."""
    any_table = next(iter(tables.values()))
    spark = any_table.sparkSession
    rows = []
    for name in TABLES:
        if name not in tables:
            rows.append((name, 0, "skipped"))
            continue
        target = f"{folder.rstrip('/')}/{name}"
        counted = Observation(f"backup of {name}")
        flat_table(tables[name]).observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").csv(
            target, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
        rows.append((name, counted.get["rows"], "ok"))
    return spark.createDataFrame(rows, SUMMARY)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(
        path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def typed_column(name: str) -> Column:
    """Text column of a backup in its type; empty is null, unreadable times are null."""
    value = F.nullif(F.col(name), F.lit(""))
    if name in DATETIME_COLUMNS:
        return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in DATETIME_FORMATS]).cast("timestamp_ntz")
    if name in BOOLEAN_COLUMNS:
        return F.lower(value).isin(TRUE_WORDS)
    return value


def restore_table(text_table: DataFrame) -> DataFrame:
    return text_table.select(*[typed_column(c).alias(c) for c in text_table.columns])


def restore_tables(spark: SparkSession, folder: str, dry_run: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, summary) of a backup folder; a dry run only counts."""
    tables: dict[str, DataFrame] = {}
    rows = []
    for name in TABLES:
        try:
            text = _read(spark, f"{folder.rstrip('/')}/{name}")
        except Exception as problem:  # a folder that is not there
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            rows.append((name, 0, "skipped"))
            continue
        count = text.count()
        if not count:
            rows.append((name, 0, "empty"))
        elif dry_run:
            rows.append((name, count, "dry-run"))
        else:
            tables[name] = restore_table(text)
            rows.append((name, count, "ok"))
    return tables, spark.createDataFrame(rows, SUMMARY)
