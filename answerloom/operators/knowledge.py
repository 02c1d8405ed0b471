"""Knowledge-base maintenance: search, upsert, import, edit, delete, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerloom import constants as K
from answerloom.functions import text as X
from answerloom.functions.vectors import hashed_embedding
from answerloom.operators.audit import audit_rows, timestamp
from answerloom.operators.matching import at_least, live, top_by_wording
from answerloom.operators.ranking import first_per_group, page as _page, with_positions
from answerloom.session import durable
from answerloom.sources.records import numbered

KB_COLUMNS = ["id", "category", "question", "answer", "embedding", "created_at", "updated_at", "deleted_at"]


def list_kb(kb: DataFrame, search: str = "", category: str = "", page: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(one page newest first, total) of live entries."""
    rows = live(kb)
    if search:
        rows = rows.filter(X.search_match(search, F.col("question"), F.col("answer")))
    if category:
        rows = rows.filter(F.col("category") == category)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return _page(rows.drop("embedding"), [F.col("created_at").desc(), F.col("id").desc()], page, size), total


def categories(kb: DataFrame) -> DataFrame:
    named = live(kb).filter((F.col("category").isNotNull()) & (F.col("category") != ""))
    return named.select("category").distinct().orderBy("category")


def export_kb(kb: DataFrame, category: str = "") -> DataFrame:
    """Live entries as (category, question, answer), by category, newest first."""
    rows = live(kb)
    if category:
        rows = rows.filter(F.col("category") == category)
    return rows.orderBy("category", F.col("created_at").desc(), F.col("id").desc()).select(
        F.coalesce("category", F.lit("")).alias("category"), "question", "answer"
    )


def write_export(kb: DataFrame, path: str, fmt: str = "csv", category: str = "") -> None:
    writer = export_kb(kb, category).write.mode("overwrite")
    if fmt == "json":
        writer.json(path)
    else:
        writer.option("header", True).option("escape", '"').csv(path)


def validate_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, errors) of (row_no, category, question, answer) records."""
    clean = {c: F.coalesce(X.strip(F.col(c)), F.lit("")) for c in ("category", "question", "answer")}
    cleaned = records.withColumns(clean)
    complete = (F.col("category") != "") & (F.col("question") != "") & (F.col("answer") != "")
    row = "file_row" if "file_row" in records.columns else "row_no"
    message = F.concat(F.lit("Row "), F.col(row).cast("string"), F.lit(": missing category, question, or answer"))
    source = ["source_file"] if "source_file" in records.columns else []
    return cleaned.filter(complete), cleaned.filter(~complete).select(*source, "row_no", message.alias("error"))


def _new_ids(kb: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """Ids after the highest one, by ``order``."""
    top = kb.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = with_positions(rows, [], order, "_position")
    return numbered.withColumn("id", top + F.col("_position")).drop("_position")


def _exact_targets(kb: DataFrame, stored_key: Column, pick) -> DataFrame:
    return live(kb).filter(F.col("question").isNotNull()).groupBy(stored_key.alias("_key")).agg(pick("id").alias("target_id"))


def _longest_wins(question: Column, stored: Column) -> Column:
    longer = F.char_length(X.strip(question)) > F.char_length(X.strip(F.coalesce(stored, F.lit(""))))
    return F.when(longer, question).otherwise(stored)


def _apply_updates(kb: DataFrame, updates: DataFrame, now, embed) -> DataFrame:
    """Fold ordered updates (target_id, tier, row_no, question, answer, category)
    into the entries they hit: last values win, the longest wording stays.

    The vector is that of the last wording, which is embedded once it is known.
    """
    order = F.struct("tier", "row_no")
    longest = F.struct(
        F.char_length(X.strip(F.col("question"))).alias("n"), (-F.col("tier")).alias("t"), (-F.col("row_no")).alias("r")
    )
    folded = updates.groupBy("target_id").agg(
        F.max_by(F.struct("answer", "category", "question"), order).alias("last"),
        F.max_by("question", longest).alias("longest"),
    ).withColumn("_embedding", embed("last.question").cast("array<float>"))
    hit = F.col("target_id").isNotNull()
    last = lambda name: F.when(hit, F.col(f"last.{name}")).otherwise(F.col(name)).alias(name)
    return kb.join(folded, kb["id"] == folded["target_id"], "left").select(
        "id", last("category"),
        F.when(hit, _longest_wins(F.col("longest"), F.col("question"))).otherwise(F.col("question")).alias("question"),
        last("answer"), F.when(hit, F.col("_embedding")).otherwise(F.col("embedding")).alias("embedding"), "created_at",
        F.when(hit, timestamp(now)).otherwise(F.col("updated_at")).alias("updated_at"), "deleted_at",
    )


def _inserted(kb: DataFrame, fresh: DataFrame, now, embed, worded: str = "question") -> DataFrame:
    return _new_ids(kb, fresh, "row_no").select(
        "id", "category", "question", "answer", embed(worded).cast("array<float>").alias("embedding"),
        timestamp(now).alias("created_at"), timestamp(now).alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
    )


def one_order(records: DataFrame) -> DataFrame:
    """Records whose ``row_no`` is unique also when they come from several files."""
    return numbered(records) if "source_file" in records.columns and "file_row" not in records.columns else records


def _classified(kb: DataFrame, records: DataFrame, stored_key: Column, pick, threshold: float, embed) -> DataFrame:
    """Records with target_id and tier: 0 exact, 1 semantic, null for new ones.

    Only wordings without an exact entry are embedded, each once.
    """
    keyed = records.withColumn("_key", X.exact_key(F.col("question"))).join(
        _exact_targets(kb, stored_key, pick), "_key", "left"
    ).select("row_no", "category", "question", "answer", "target_id")
    keyed = durable(keyed)
    rest = keyed.filter(F.col("target_id").isNull()).select(F.col("question").alias("question_text"))
    near = top_by_wording(rest, kb, 1, threshold, embed, digests=True).select("wording", F.col("kb_id").alias("near_id"))
    return keyed.withColumn("wording", X.digest(F.col("question"))).join(near, "wording", "left").select(
        "row_no", "category", "question", "answer",
        F.coalesce("target_id", "near_id").alias("target_id"),
        F.when(F.col("target_id").isNotNull(), 0).when(F.col("near_id").isNotNull(), 1).alias("tier"),
    )


def upsert_kb(
    kb: DataFrame, records: DataFrame, now, threshold: float = K.DEDUP_THRESHOLD, embed=hashed_embedding
) -> tuple[DataFrame, DataFrame]:
    """(kb, audit): add entries one request each, or update the entry with the
    same wording, else the most similar one at the threshold.

    Requests see the given snapshot, and new wordings of earlier requests; the
    stored wording is compared lower-cased but not stripped.  The longer
    wording is kept.
    """
    rows = durable(_classified(kb, one_order(records), F.lower("question"), F.min, threshold, embed))
    updates = rows.filter(F.col("target_id").isNotNull())
    longest = F.struct(F.char_length(X.strip(F.col("question"))), (-F.col("row_no")).alias("first"))
    fresh = (
        rows.filter(F.col("target_id").isNull())
        .groupBy(X.exact_key(F.col("question")).alias("_wording"))
        .agg(
            F.min("row_no").alias("row_no"), F.max_by("question", longest).alias("question"),
            F.max_by(F.struct("answer", "category", F.col("question").alias("_worded")), "row_no").alias("last"),
        )
        .select("row_no", "question", "last.*")
    )
    added = _inserted(kb, durable(fresh), now, embed, "_worded")
    after = _apply_updates(kb, updates, now, embed).unionByName(added)
    before = kb.select(F.col("id").alias("target_id"), F.col("answer").alias("_before"))
    updated = audit_rows(
        updates.join(before, "target_id"), now, "kb_update", "qa_pair", F.col("target_id"),
        details=F.to_json(F.struct(F.col("question").alias("merged_question"), F.lit(True).alias("semantic_dedup"))),
        before=F.col("_before"), after=F.col("answer"),
    )
    created = audit_rows(
        added, now, "kb_create", "qa_pair", F.col("id"),
        details=F.to_json(F.struct("question", "category")), after=F.col("answer"),
    )
    return after, updated.unionByName(created)


def import_kb(
    kb: DataFrame, records: DataFrame, now, threshold: float = K.DEDUP_THRESHOLD, embed=hashed_embedding
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(kb, summary, errors, audit) of a bulk import of (row_no, category, question, answer).

    The first row of each wording counts.  Exact hits update the last entry
    with that wording; the rest update the most similar entry of the knowledge
    base as it was before the import, or are added.  New rows are not compared
    with each other.
    """
    records = durable(one_order(records))
    valid, errors = validate_records(records)
    valid, errors = durable(valid), durable(errors)
    keyed = valid.withColumn("_wording", X.exact_key(F.col("question")))
    columns = ["row_no", "category", "question", "answer"]
    first = keyed.groupBy("_wording").agg(F.min_by(F.struct(*columns), "row_no").alias("first")).select("first.*")
    rows = durable(_classified(kb, first, X.exact_key(F.col("question")), F.max, threshold, embed))
    updates = rows.filter(F.col("target_id").isNotNull())
    fresh = rows.filter(F.col("target_id").isNull())
    after = _apply_updates(kb, updates, now, embed).unionByName(_inserted(kb, fresh, now, embed))
    counts = rows.agg(
        F.count_if(F.col("tier").isNull()).alias("imported"),
        F.count_if(F.col("tier").isNotNull()).alias("updated"),
        F.count_if(F.col("tier") == 1).alias("semantic_merges"),
    )
    total = lambda df: df.agg(F.count(F.lit(1))).scalar()
    summary = counts.select(
        "imported", "updated", "semantic_merges", total(errors).alias("skipped"), total(records).alias("total_rows")
    )
    audit = audit_rows(
        summary.filter("imported + updated > 0"), now, "kb_import", "qa_pair",
        details=F.to_json(F.struct("imported", "updated", "semantic_merges", "skipped")),
    )
    return after, summary, errors, audit


def exact_upsert(
    kb: DataFrame, records: DataFrame, now, new_category: Column | None = None, overwrite_question: bool = False,
    overwrite_category: bool = False, stored_key: Column | None = None, pick=F.max, embed=hashed_embedding,
) -> tuple[DataFrame, DataFrame]:
    """(kb, (row_no, kb_id)): upsert by wording only, without the semantic tier.

    Rows of one wording apply in order; a new wording is added once.
    """
    stored_key = X.exact_key(F.col("question")) if stored_key is None else stored_key
    keyed = records.withColumn("_key", X.exact_key(F.col("question"))).join(
        _exact_targets(kb, stored_key, pick), "_key", "left"
    )
    fields = F.struct("question", "answer", "category")
    # a wording applies once, with its last values; only the first new row sets wording and category
    folded = keyed.groupBy("_key").agg(
        F.max("target_id").alias("target_id"), F.max_by(fields, "row_no").alias("last"),
        F.min_by(fields, "row_no").alias("first"), F.min("row_no").alias("row_no"),
    )
    rows = durable(
        folded.select(
            "_key", "target_id", "row_no", F.col("last.answer").alias("answer"),
            (F.col("last.question") if overwrite_question else F.col("first.question")).alias("question"),
            (F.col("last.category") if overwrite_category else F.col("first.category")).alias("category"),
        ).withColumn("embedding", embed("question"))
    )
    fresh = rows.filter(F.col("target_id").isNull())
    if new_category is not None:
        fresh = fresh.withColumn("category", new_category)
    numbered = durable(_new_ids(kb, fresh, "row_no"))
    added = numbered.select(
        "id", "category", "question", "answer", F.col("embedding").cast("array<float>").alias("embedding"),
        timestamp(now).alias("created_at"), timestamp(now).alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
    )
    hits = rows.filter(F.col("target_id").isNotNull()).select(
        "target_id", F.struct("question", "answer", "category", "embedding").alias("new")
    )
    hit = F.col("target_id").isNotNull()
    take = lambda name, on=True: (F.when(hit, F.col(f"new.{name}")).otherwise(F.col(name)) if on else F.col(name)).alias(name)
    updated = kb.join(hits, kb["id"] == hits["target_id"], "left").select(
        "id", take("category", overwrite_category), take("question", overwrite_question), take("answer"), take("embedding"),
        "created_at", F.when(hit, timestamp(now)).otherwise(F.col("updated_at")).alias("updated_at"), "deleted_at",
    )
    ids = rows.filter(F.col("target_id").isNotNull()).select("_key", F.col("target_id").alias("kb_id")).unionByName(
        numbered.select("_key", F.col("id").alias("kb_id"))
    )
    return updated.unionByName(added), keyed.select("_key", "row_no").join(ids, "_key").select("row_no", "kb_id")


def update_kb(kb: DataFrame, changes: DataFrame, now, embed=hashed_embedding) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kb, audit, errors): apply (id, category, question, answer) where not null.

    A changed question is embedded again; the resulting category must not be blank.
    """
    found = changes.select("id", F.col("category").alias("c"), F.col("question").alias("q"), F.col("answer").alias("a")).join(
        live(kb).select("id", "category", "answer"), "id", "left"
    ).join(live(kb).select(F.col("id"), F.lit(True).alias("_live")), "id", "left")
    category = X.clean_optional(F.coalesce("c", "category"))
    problem = F.when(F.col("_live").isNull(), "Entry not found").when(category.isNull(), "Category is required")
    checked = durable(found.withColumn("error", problem).withColumn("category", category))
    good = checked.filter(F.col("error").isNull())
    new = good.select(
        "id", F.col("category").alias("_category"), F.col("a").alias("_answer"), F.col("q").alias("_question"),
        F.when(F.col("q").isNotNull(), embed("q")).alias("_embedding"), F.lit(True).alias("_hit"),
    )
    after = kb.join(new, "id", "left").select(
        "id", F.coalesce("_category", "category").alias("category"), F.coalesce("_question", "question").alias("question"),
        F.coalesce("_answer", "answer").alias("answer"), F.coalesce("_embedding", "embedding").alias("embedding"), "created_at",
        F.when(F.col("_hit"), timestamp(now)).otherwise(F.col("updated_at")).alias("updated_at"), "deleted_at",
    )
    audit = audit_rows(good, now, "kb_update", "qa_pair", F.col("id"), before=F.col("answer"), after=F.coalesce("a", "answer"))
    return after, audit, checked.filter(F.col("error").isNotNull()).select("id", "error")


def delete_kb(kb: DataFrame, ids: DataFrame, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kb, audit, errors): soft-delete by id."""
    wanted = ids.select("id").distinct()
    state = wanted.join(kb.select("id", "question", "category", "answer", "deleted_at", F.lit(True).alias("_known")), "id", "left")
    problem = F.when(F.col("_known").isNull(), "Entry not found").when(F.col("deleted_at").isNotNull(), "Entry already deleted")
    checked = state.withColumn("error", problem)
    good = checked.filter(F.col("error").isNull())
    after = kb.join(good.select("id", F.lit(True).alias("_hit")), "id", "left").withColumn(
        "deleted_at", F.when(F.col("_hit"), timestamp(now)).otherwise(F.col("deleted_at"))
    ).drop("_hit")
    audit = audit_rows(
        good, now, "kb_delete", "qa_pair", F.col("id"), details=F.to_json(F.struct("question", "category")), before=F.col("answer")
    )
    return after, audit, checked.filter(F.col("error").isNotNull()).select("id", "error")


def merge_clusters(kb: DataFrame, merges: DataFrame, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kb, summary, audit) for merges (merge_no, keep_id, delete_ids).

    Merges apply in order and all or nothing: the entry to keep must be live,
    the ones to delete live and different, or ValueError is raised.
    """
    doomed = merges.select("merge_no", "keep_id", F.posexplode("delete_ids").alias("_at", "delete_id"))
    states = live(kb).select(F.col("id"), F.lit(True).alias("_live"))
    keeps = merges.join(states.withColumnRenamed("id", "keep_id"), "keep_id", "left")
    deletes = doomed.join(states.withColumnRenamed("id", "delete_id"), "delete_id", "left")
    times = doomed.groupBy("delete_id").agg(F.min("merge_no").alias("_gone"), F.count(F.lit(1)).alias("_times"))
    bad = (
        keeps.filter(F.col("_live").isNull()).select(F.concat(F.lit("Entry to keep (id="), F.col("keep_id").cast("string"), F.lit(") not found or already deleted")).alias("error"))
        .unionByName(
            merges.join(times, merges["keep_id"] == times["delete_id"]).filter("_gone < merge_no").select(
                F.concat(F.lit("Entry to keep (id="), F.col("keep_id").cast("string"), F.lit(") not found or already deleted")).alias("error")
            )
        )
        .unionByName(doomed.filter("delete_id = keep_id").select(F.concat(F.lit("Cannot delete the entry being kept (id="), F.col("delete_id").cast("string"), F.lit(")")).alias("error")))
        .unionByName(deletes.filter(F.col("_live").isNull()).select(F.concat(F.lit("Entry to delete (id="), F.col("delete_id").cast("string"), F.lit(") not found or already deleted")).alias("error")))
        .unionByName(times.filter("_times > 1").select(F.concat(F.lit("Entry to delete (id="), F.col("delete_id").cast("string"), F.lit(") not found or already deleted")).alias("error")))
    )
    problem = bad.head()
    if problem is not None:
        raise ValueError(problem["error"])
    gone = times.select(F.col("delete_id").alias("id"), F.lit(True).alias("_hit"))
    after = kb.join(gone, "id", "left").withColumn(
        "deleted_at", F.when(F.col("_hit"), timestamp(now)).otherwise(F.col("deleted_at"))
    ).drop("_hit")
    summary = merges.agg(
        F.count(F.lit(1)).alias("merged_clusters"), F.coalesce(F.sum(F.size("delete_ids")), F.lit(0)).alias("total_deleted")
    )
    audit = audit_rows(
        merges, now, "kb_merge", "qa_pair", F.col("keep_id"),
        details=F.to_json(F.struct(F.col("keep_id").alias("kept_id"), F.col("delete_ids").alias("deleted_ids"), F.size("delete_ids").alias("deleted_count"))),
    )
    return after, summary, audit
