"""Layout fingerprints: recognise a questionnaire layout seen before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerloom import constants as K
from answerloom.functions import text as X
from answerloom.operators.audit import timestamp
from answerloom.operators.ranking import page as _page


def _words(cells: Column) -> Column:
    return F.filter(
        F.flatten(F.transform(cells, lambda c: F.split(X.collapse(F.lower(c)), " "))), lambda w: w != ""
    )


def fingerprint(cells: DataFrame, file_type: str = "csv") -> DataFrame:
    """(doc_id, file_type, column_count, header_words, fingerprint_hash).

    Delimited files: width and words of the first row, which
    ``sources.grids.header_cells`` reads from files.  Table documents
    (``docx``): widest first row and the words of all first rows.  Other types
    have no structure, so they share one hash per type.
    """
    if file_type not in ("csv", "docx"):
        heads = cells.select("doc_id").distinct().select(
            "doc_id", F.lit(0).alias("column_count"), F.array().cast("array<string>").alias("header_words")
        )
    else:
        table = ["table_idx"] if file_type == "docx" else []
        first = cells.groupBy("doc_id", *table).agg(F.min_by("cells", "row_idx").alias("first"))
        width, words = F.size("first"), _words(F.col("first"))
        if file_type == "csv":
            heads = first.select("doc_id", width.alias("column_count"), F.array_sort(F.array_distinct(words)).alias("header_words"))
        else:
            spread = first.select("doc_id", width.alias("width"), F.explode_outer(F.array_distinct(words)).alias("word"))
            # words of all tables: distinct before they are gathered
            distinct = spread.groupBy("doc_id", "word").agg(F.max("width").alias("width"))
            heads = distinct.groupBy("doc_id").agg(
                F.max("width").alias("column_count"), F.sort_array(F.collect_list("word")).alias("header_words")
            )
    return heads.select(
        "doc_id", F.lit(file_type).alias("file_type"), "column_count", "header_words",
        X.layout_hash(F.lit(file_type), F.col("column_count"), F.col("header_words")).alias("fingerprint_hash"),
    )


def lookup_profile(docs: DataFrame, fingerprints: DataFrame, hints: str | None = None) -> DataFrame:
    """Effective profile of (doc_id, fingerprint_hash, parser_profile_name).

    A known layout decides only when the default profile was asked for; its
    hints replace the given ones if it has any.
    """
    known = fingerprints.select(
        "fingerprint_hash", F.col("id").alias("fingerprint_id"), F.col("parser_profile").alias("_profile"), F.col("hint_overrides").alias("_hints")
    )
    asked = F.coalesce("parser_profile_name", F.lit(K.DEFAULT_PROFILE))
    use = F.col("fingerprint_id").isNotNull() & (asked == K.DEFAULT_PROFILE)
    base = F.lit(hints).cast("string")
    return docs.join(known, "fingerprint_hash", "left").select(
        *docs.columns,
        F.when(use, F.col("_profile")).otherwise(asked).alias("effective_profile"),
        F.when(use, F.coalesce(X.clean_optional(F.col("_hints")), base)).otherwise(base).alias("effective_hints"),
        F.when(use, F.col("fingerprint_id")).alias("fingerprint_id"),
    )


def learn_layouts(fingerprints: DataFrame, runs: DataFrame, now) -> DataFrame:
    """Fingerprint table after successful runs (seq, fingerprint_hash, column_count,
    header_words, parser_profile, hint_overrides, original_filename).

    A known hash counts up and takes the profile, and hints if given, of its
    last run; a new one is named by its first run.
    """
    folded = runs.groupBy("fingerprint_hash").agg(
        F.count(F.lit(1)).alias("_runs"), F.max_by("parser_profile", "seq").alias("_profile"),
        F.max_by("hint_overrides", F.when(X.clean_optional(F.col("hint_overrides")).isNotNull(), F.col("seq"))).alias("_hints"),
        F.min_by(F.struct("column_count", "header_words", "original_filename"), "seq").alias("_first"),
    )
    joined = fingerprints.join(folded, "fingerprint_hash", "full_outer")
    ran = F.col("_runs").isNotNull()
    signature = F.array_join(F.slice("_first.header_words", 1, K.HEADER_SIGNATURE_WORDS), " | ")
    return joined.select(
        "id", "fingerprint_hash", "name", F.coalesce("source_filename", "_first.original_filename").alias("source_filename"),
        F.coalesce("column_count", "_first.column_count").alias("column_count"),
        F.when(F.col("id").isNull(), X.clean_optional(signature)).otherwise(F.col("header_signature")).alias("header_signature"),
        F.when(ran, F.col("_profile")).otherwise(F.col("parser_profile")).alias("parser_profile"),
        F.coalesce("_hints", "hint_overrides").alias("hint_overrides"),
        (F.coalesce("success_count", F.lit(0)) + F.coalesce("_runs", F.lit(0))).alias("success_count"),
        F.when(ran, timestamp(now)).otherwise(F.col("last_used_at")).alias("last_used_at"),
        F.coalesce("created_at", timestamp(now)).alias("created_at"),
    )


def list_fingerprints(fingerprints: DataFrame, page: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    total = fingerprints.agg(F.count(F.lit(1)).alias("total"))
    return _page(fingerprints, [F.col("last_used_at").desc_nulls_last(), F.col("fingerprint_hash")], page, size), total


def update_fingerprints(fingerprints: DataFrame, changes: DataFrame) -> DataFrame:
    """Set name, parser_profile and hint_overrides by id where given."""
    new = changes.select("id", F.col("name").alias("_n"), F.col("parser_profile").alias("_p"), F.col("hint_overrides").alias("_h"))
    return fingerprints.join(new, "id", "left").withColumns(
        {"name": F.coalesce("_n", "name"), "parser_profile": F.coalesce("_p", "parser_profile"), "hint_overrides": F.coalesce("_h", "hint_overrides")}
    ).select(*fingerprints.columns)


def delete_fingerprints(fingerprints: DataFrame, ids: DataFrame) -> DataFrame:
    return fingerprints.join(ids.select("id").distinct(), "id", "left_anti").select(*fingerprints.columns)
