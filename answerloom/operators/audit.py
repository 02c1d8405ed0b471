"""Audit rows: one per action, appended by the caller to the audit table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerloom import constants as K
from answerloom.operators.ranking import page as _page


def timestamp(now: str | Column) -> Column:
    return F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now


def audit_rows(
    rows: DataFrame, now, action_type: str | Column, entity_type: str, entity_id: Column | None = None, job_id: Column | None = None,
    actor: str = K.DEFAULT_ACTOR, details: Column | None = None, before: Column | None = None, after: Column | None = None,
) -> DataFrame:
    """One audit row per input row; ``details`` is JSON text."""
    action = F.lit(action_type) if isinstance(action_type, str) else action_type
    nothing = F.lit(None)
    pick = lambda column, kind: (nothing if column is None else column).cast(kind)
    return rows.select(
        timestamp(now).alias("timestamp"), action.alias("action_type"), F.lit(entity_type).alias("entity_type"),
        pick(entity_id, "long").alias("entity_id"), pick(job_id, "long").alias("job_id"), F.lit(actor).alias("actor"),
        pick(details, "string").alias("details"), pick(before, "string").alias("before_value"), pick(after, "string").alias("after_value"),
    )


def list_audit(
    audit: DataFrame, job_id: int | None = None, action_type: str | None = None, entity_type: str | None = None,
    since: str | None = None, until: str | None = None, page: int = 1, size: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """(one page newest first, total) of the audit table; the range is inclusive."""
    rows = audit
    for name, value in (("job_id", job_id), ("action_type", action_type), ("entity_type", entity_type)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    if since is not None:
        rows = rows.filter(F.col("timestamp") >= timestamp(since))
    if until is not None:
        rows = rows.filter(F.col("timestamp") <= timestamp(until))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return _page(rows, [F.col("timestamp").desc(), F.col("id").desc()], page, size), total
