"""Flagged questions: grouping, sync, resolution, dismissal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerloom import constants as K
from answerloom.functions import text as X
from answerloom.functions.vectors import hashed_embedding
from answerloom.operators.audit import audit_rows, timestamp
from answerloom.operators.knowledge import exact_upsert
from answerloom.operators.matching import live
from answerloom.operators.ranking import with_positions
from answerloom.operators.skew import lookup
from answerloom.session import durable, stored


def keyed(flags: DataFrame) -> DataFrame:
    return flags.withColumn("question_key", X.question_key(F.col("extracted_question")))


def _selected(flags: DataFrame, resolved: bool | None, job_id: int | None) -> DataFrame:
    rows = flags
    if resolved is not None:
        rows = rows.filter(F.col("resolved") == resolved)
    if job_id is not None:
        rows = rows.filter(F.col("job_id") == job_id)
    return rows


def grouped_flags(
    flags: DataFrame, jobs: DataFrame, resolved: bool | None = None, job_id: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(groups, sources): flags of known jobs grouped by question key.

    A group shows its newest flag (latest created_at, then highest id) and is
    resolved when all its flags are.  ``sources`` lists the jobs and file names
    of a group, one row per job with its newest flag, so a question asked in
    very many jobs needs no long array; order by newest_at, newest_id descending.
    """
    rows = keyed(_selected(flags, resolved, job_id)).join(
        jobs.select(F.col("id").alias("job_id"), "original_filename"), "job_id"
    )
    newest = F.struct("created_at", "id")
    shown = F.struct(
        "id", X.clean_question(F.col("extracted_question")).alias("extracted_question"), "context", "similarity_score",
        "best_match_question", "resolved_answer", "resolved_at", "created_at",
    )
    sources = rows.groupBy("question_key", "job_id", "original_filename").agg(
        F.count(F.lit(1)).alias("occurrences"), F.max("created_at").alias("newest_at"), F.max_by("id", newest).alias("newest_id"),
        F.max_by(shown, newest).alias("shown"), F.max(newest).alias("newest"), F.bool_and("resolved").alias("resolved"),
    )
    groups = sources.groupBy("question_key").agg(
        F.max_by("shown", "newest").alias("shown"), F.bool_and("resolved").alias("resolved"),
        F.sum("occurrences").alias("occurrence_count"), F.count(F.lit(1)).alias("job_count"),
    ).select(
        "shown.id", "shown.extracted_question", F.col("question_key").alias("normalized_question"), "shown.context",
        "shown.similarity_score", "shown.best_match_question", "resolved", "shown.resolved_answer", "shown.resolved_at",
        "shown.created_at", "occurrence_count", "job_count",
    )
    return groups, sources.select(
        F.col("question_key").alias("normalized_question"), "job_id", F.col("original_filename").alias("filename"), "newest_at", "newest_id"
    )


def newest_first(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.col("created_at").desc(), F.col("id").desc())


def flag_view(groups: DataFrame, sources: DataFrame, view: str = "all", search: str = "") -> DataFrame:
    """Dismissed, resolved or open groups, with a search over texts and file names."""
    dismissed = F.coalesce(F.col("resolved_answer") == K.DISMISSED, F.lit(False))
    rows = groups
    if view == "dismissed":
        rows = rows.filter(F.col("resolved") & dismissed)
    elif view == "resolved":
        rows = rows.filter(F.col("resolved") & ~dismissed)
    elif view == "unresolved":
        rows = rows.filter(~F.col("resolved"))
    needle = search.strip()
    if needle:
        named = sources.filter(X.search_match(needle, F.col("filename"))).select("normalized_question").distinct().withColumn("_named", F.lit(True))
        hit = X.search_match(needle, F.col("extracted_question"), F.col("best_match_question"), F.col("resolved_answer"))
        rows = rows.join(named, "normalized_question", "left").filter(hit | F.col("_named").isNotNull()).drop("_named")
    return rows


def export_flags(flags: DataFrame, jobs: DataFrame, resolved: bool | None = False, job_id: int | None = None) -> DataFrame:
    """Import-ready template (category, question, answer) of grouped flags, newest first."""
    groups, _ = grouped_flags(flags, jobs, resolved, job_id)
    usable = F.col("resolved") & (F.coalesce("resolved_answer", F.lit("")) != K.DISMISSED)
    return newest_first(groups).select(
        F.lit("").alias("category"), F.col("extracted_question").alias("question"),
        F.when(usable, F.coalesce("resolved_answer", F.lit(""))).otherwise("").alias("answer"),
    )


def sync_flags(flags: DataFrame, kb: DataFrame, now, job_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(flags, summary): resolve open flags whose key a live entry now answers.

    Of several entries with one key the latest updated wins (missing times
    last), then the highest id.
    """
    latest = F.struct(F.col("updated_at").isNotNull().alias("known"), "updated_at", "id")
    answers = live(kb).groupBy(X.question_key(F.col("question")).alias("question_key")).agg(
        F.max_by("answer", latest).alias("_answer"), F.lit(True).alias("_known")
    )
    scope = ~F.col("resolved") if job_id is None else (~F.col("resolved") & (F.col("job_id") == job_id))
    rows = lookup(keyed(flags), answers, ["question_key"]).withColumn("_open", scope).withColumn(
        "_synced", F.col("_open") & F.col("_known").isNotNull()
    )
    after = rows.select(
        *[c for c in flags.columns if c not in ("resolved", "resolved_answer", "resolved_at")],
        (F.col("resolved") | F.col("_synced")).alias("resolved"),
        F.when(F.col("_synced"), F.col("_answer")).otherwise(F.col("resolved_answer")).alias("resolved_answer"),
        F.when(F.col("_synced"), timestamp(now)).otherwise(F.col("resolved_at")).alias("resolved_at"),
    ).select(*flags.columns)
    summary = rows.agg(
        F.count_if("_open").alias("scanned_occurrences"), F.count_if("_synced").alias("synced_occurrences"),
        F.count_distinct(F.when(F.col("_synced"), F.col("question_key"))).alias("synced_groups"),
        F.count_if(F.col("_open") & ~F.col("_synced")).alias("remaining_unresolved"),
    )
    return after, summary


def dedupe_flags(flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flags, summary): keep the earliest flag of each key and job."""
    first = F.struct("created_at", "id")
    kept_ids = keyed(flags).groupBy("question_key", "job_id").agg(F.min_by("id", first).alias("id"))
    kept = flags.join(kept_ids.select("id"), "id", "left_semi")
    summary = kept_ids.agg(F.count(F.lit(1)).alias("total_after")).select(
        flags.agg(F.count(F.lit(1))).scalar().alias("total_before"), "total_after"
    ).select("total_before", (F.col("total_before") - F.col("total_after")).alias("duplicates_removed"), "total_after")
    return kept, summary


def purge_dismissed(flags: DataFrame, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flags, summary, audit): drop dismissed flags for good."""
    dismissed = F.coalesce(F.col("resolved_answer") == K.DISMISSED, F.lit(False))
    summary = flags.agg(F.count_if(dismissed).alias("purged"))
    audit = audit_rows(
        summary.filter("purged > 0"), now, "flagged_bulk_dismiss", "flagged_question",
        details=F.to_json(F.struct(F.lit("purge_dismissed").alias("action"), F.col("purged").alias("purged_count"))),
    )
    return flags.filter(~dismissed), summary, audit


def resolve_flags(
    flags: DataFrame, kb: DataFrame, resolutions: DataFrame, now, sme_map: dict[str, str] | None = None, embed=hashed_embedding
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(flags, kb, audit, errors) for (flag_id, answer, add_to_kb, category).

    All open flags with the key of the named flag, in every job, get the
    answer; of several resolutions of one key only the first (lowest flag_id)
    finds open flags.  With ``add_to_kb`` each distinct wording of the group is
    written to the knowledge base by wording only, which also takes over the
    wording, and the category's expert is assigned.
    """
    marked = stored(keyed(flags))  # read by every join below, and their searches for hot keys
    wanted = resolutions.join(marked.select(F.col("id").alias("flag_id"), "question_key", "job_id"), "flag_id", "left")
    open_ = marked.filter(~F.col("resolved"))
    group_sizes = open_.groupBy("question_key").agg(F.count(F.lit(1)).alias("occurrence_count"))
    turns = wanted.groupBy("question_key").agg(F.min("flag_id").alias("_first"))
    checked = durable(
        wanted.join(group_sizes, "question_key", "left").join(turns, "question_key", "left").withColumn(
            "error",
            F.when(F.col("question_key").isNull(), "Flagged question not found")
            .when(F.col("occurrence_count").isNull() | (F.col("flag_id") != F.col("_first")), "Already resolved")
            .when(F.col("add_to_kb") & X.clean_optional(F.col("category")).isNull(), "Category is required"),
        )
    )
    good = checked.filter(F.col("error").isNull())
    expert = F.when(F.col("add_to_kb"), X.route_sme(F.col("category"), sme_map or {}))
    new = good.select("question_key", F.col("answer").alias("_answer"), expert.alias("_expert"), F.lit(True).alias("_hit"))
    joined = lookup(marked, new, ["question_key"]).withColumn("_now", F.col("_hit").isNotNull() & ~F.col("resolved"))
    take = lambda value, column: F.when(F.col("_now"), value).otherwise(F.col(column))
    after = joined.withColumns(
        {
            "resolved": F.col("resolved") | F.col("_now"),
            "resolved_answer": take(F.col("_answer"), "resolved_answer"),
            "resolved_at": take(timestamp(now), "resolved_at"),
            "assigned_to": take(F.coalesce("_expert", "assigned_to"), "assigned_to"),
        }
    ).select(*flags.columns)
    wordings = (
        lookup(open_, good.filter("add_to_kb").select("question_key", "flag_id", "answer", "category"), ["question_key"], "inner")
        .groupBy("question_key", "extracted_question")
        .agg(F.min("id").alias("row_no"), F.first("answer").alias("answer"), F.first("category").alias("category"))
        .select("row_no", F.col("extracted_question").alias("question"), "answer", X.strip(F.col("category")).alias("category"))
    )
    kb_after, _ = exact_upsert(kb, wordings, now, overwrite_question=True, overwrite_category=True, embed=embed)
    audit = audit_rows(
        good, now, "flagged_resolve", "flagged_question", F.col("flag_id"), F.col("job_id"),
        details=F.to_json(F.struct("add_to_kb", "occurrence_count")), after=F.col("answer"),
    )
    return after, kb_after, audit, checked.filter(F.col("error").isNotNull()).select("flag_id", "error")


def dismiss_flags(flags: DataFrame, ids: DataFrame, now) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(flags, summary, not_found, audit): dismiss every open flag that shares a
    key with one of the ids."""
    marked = keyed(flags)
    wanted = ids.select("id").distinct()
    found = wanted.join(marked.select("id", "question_key"), "id")
    not_found = wanted.join(marked.select("id"), "id", "left_anti")
    keys = found.select("question_key").distinct()
    sizes = marked.join(keys, "question_key", "left_semi").groupBy("question_key").agg(
        F.count_if(~F.col("resolved")).alias("open")
    )
    summary = sizes.agg(
        F.count_if(F.col("open") > 0).alias("dismissed_groups"), F.coalesce(F.sum("open"), F.lit(0)).alias("dismissed_occurrences"),
        F.count_if(F.col("open") == 0).alias("already_resolved_groups"),
    ).select(
        wanted.agg(F.count(F.lit(1))).scalar().alias("requested_ids"), "*",
        not_found.agg(F.count(F.lit(1))).scalar().alias("not_found_ids"),
    )
    joined = marked.join(keys.withColumn("_hit", F.lit(True)), "question_key", "left").withColumn(
        "_now", F.col("_hit").isNotNull() & ~F.col("resolved")
    )
    take = lambda value, column: F.when(F.col("_now"), value).otherwise(F.col(column))
    after = joined.withColumns(
        {
            "resolved": F.col("resolved") | F.col("_now"),
            "resolved_answer": take(F.lit(K.DISMISSED), "resolved_answer"),
            "resolved_at": take(timestamp(now), "resolved_at"),
        }
    ).select(*flags.columns)
    audit = audit_rows(
        summary.filter("dismissed_occurrences > 0"), now, "flagged_bulk_dismiss", "flagged_question",
        details=F.to_json(F.struct("dismissed_groups", "dismissed_occurrences")),
    )
    return after, summary, not_found, audit


def flag_detail(flags: DataFrame, jobs: DataFrame, flag_id: int | None = None) -> DataFrame:
    """Flags one by one, with cleaned text, key and file name."""
    rows = flags if flag_id is None else flags.filter(F.col("id") == flag_id)
    return keyed(rows).join(jobs.select(F.col("id").alias("job_id"), "original_filename"), "job_id", "left").select(
        "id", X.clean_question(F.col("extracted_question")).alias("extracted_question"),
        F.col("question_key").alias("normalized_question"), "context", "similarity_score", "best_match_question", "resolved",
        "resolved_answer", "resolved_at", "created_at", F.lit(1).alias("occurrence_count"), "job_id",
        F.col("original_filename").alias("filename"),
    )
