"""Jobs, batches, traces and agent presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerloom import constants as K
from answerloom.functions import text as X
from answerloom.operators.audit import timestamp
from answerloom.operators.ranking import first_per_group, page as _page, with_positions


def list_jobs(jobs: DataFrame, page: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    total = jobs.agg(F.count(F.lit(1)).alias("total"))
    return _page(jobs, [F.col("uploaded_at").desc(), F.col("id").desc()], page, size), total


def batch_jobs(jobs: DataFrame, batch_id) -> DataFrame:
    return jobs.filter(F.col("batch_id") == batch_id).orderBy("id")


def needs_review() -> Column:
    """A done job with flags, a weak parse, or no questions at all."""
    return (F.col("status") == "done") & (
        (F.coalesce("flagged_questions_count", F.lit(0)) > 0) | F.coalesce("fallback_recommended", F.lit(False))
        | F.coalesce(F.col("total_questions") == 0, F.lit(False))
    )


def batch_summary(jobs: DataFrame) -> DataFrame:
    """Progress of every batch."""
    status = lambda name: F.count_if(F.col("status") == name)
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    counts = jobs.filter(F.col("batch_id").isNotNull()).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"), status("done").alias("done_count"), status("error").alias("error_count"),
        status("processing").alias("processing_count"), status("pending").alias("pending_count"),
        total("matched_questions").alias("matched_total"), total("flagged_questions_count").alias("flagged_total"),
        total("total_questions").alias("found_total"), F.bool_or((F.col("status") == "error") | needs_review()).alias("needs_attention"),
    )
    completed = F.col("done_count") + F.col("error_count")
    # halves round up
    return counts.withColumn("completed_count", completed).withColumn(
        "progress_percent", F.floor((200 * completed + F.col("total")) / (2 * F.col("total"))).cast("int")
    )


def append_trace(trace: DataFrame, events: DataFrame) -> DataFrame:
    """Trace table (job_id, seq, timestamp, step, status, message, data) with new
    events (job_id, seq, ...) after the ones of their job."""
    last = trace.groupBy("job_id").agg(F.max("seq").alias("_last"))
    added = events.join(last, "job_id", "left").withColumn("seq", F.col("seq") + F.coalesce("_last", F.lit(0))).select(*trace.columns)
    return trace.unionByName(added)


def trace_timeline(trace: DataFrame, jobs: DataFrame, events: int = K.BATCH_TRACE_EVENTS) -> DataFrame:
    """The last events of every batch in time order (position 1 is the newest)."""
    placed = trace.join(jobs.select(F.col("id").alias("job_id"), "batch_id", "original_filename"), "job_id")
    order = [F.coalesce(F.col("timestamp").cast("string"), F.lit("")).desc(), F.col("job_id").desc(), F.col("seq").desc()]
    return first_per_group(placed, ["batch_id"], order, events, "from_end")


def job_trace(trace: DataFrame, events: int = K.JOB_TRACE_EVENTS) -> DataFrame:
    """The last events of every job."""
    return first_per_group(trace, ["job_id"], [F.col("seq").desc()], events, "from_end")


def batch_manifest(jobs: DataFrame) -> DataFrame:
    """Download names of the finished outputs of every batch.

    Outputs are numbered by job id; a name already taken in the batch gets the
    output's number.
    """
    done = jobs.filter((F.col("status") == "done") & (F.coalesce("output_filename", F.lit("")) != ""))
    numbered = with_positions(done, ["batch_id"], "id", "index")
    suffix = X.file_suffix(F.col("output_filename"))
    name = F.concat(F.lit("filled_"), X.file_stem(F.col("original_filename")), suffix)
    named = numbered.withColumn("_name", name)
    owners = named.groupBy("batch_id", "_name").agg(F.min("index").alias("_owner"))
    taken = F.concat(X.file_stem(F.col("_name")), F.lit("_"), F.col("index").cast("string"), suffix)
    return named.join(owners, ["batch_id", "_name"]).select(
        "batch_id", "id", "index", "output_filename",
        F.when(F.col("index") == F.col("_owner"), F.col("_name")).otherwise(taken).alias("download_name"),
    )


def list_presets(presets: DataFrame) -> DataFrame:
    return presets.orderBy(F.col("is_builtin").desc(), "created_at", "id")


def add_presets(presets: DataFrame, new: DataFrame, now) -> DataFrame:
    """Presets with (id, name, instructions) added, texts trimmed."""
    return presets.unionByName(
        new.select(
            "id", X.strip(F.col("name")).alias("name"), X.strip(F.col("instructions")).alias("instructions"),
            F.lit(False).alias("is_builtin"), timestamp(now).alias("created_at"),
        )
    )


def delete_presets(presets: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(presets, errors): built-in presets stay."""
    wanted = ids.select("id").distinct()
    state = wanted.join(presets.select("id", "is_builtin"), "id", "left").withColumn(
        "error", F.when(F.col("is_builtin").isNull(), "Preset not found").when(F.col("is_builtin"), "Cannot delete built-in presets")
    )
    gone = state.filter(F.col("error").isNull()).select("id")
    return presets.join(gone, "id", "left_anti"), state.filter(F.col("error").isNotNull()).select("id", "error")
