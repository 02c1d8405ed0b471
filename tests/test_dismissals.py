"""Dismissals name lines of documents, whatever numbers the flags have."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.plans.catalogue import QUERIES


def _dismissal_tables(spark, folder) -> str:
    texts = [(0, "Zero here?"), (1, "Other one\nSecond line"), (3, "Third\nSecond line"), (6, "Only one")]
    documents = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars int")
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.range(4).select(F.col("id").alias("s_suppkey")).write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def test_dismissals_name_lines_of_documents(spark, tmp_path):
    done = QUERIES["dismiss_flags"](spark, _dismissal_tables(spark, tmp_path))
    # supplier 1 dismisses line 1 of document 3, and with it the same line of document 1
    assert sorted(r.id for r in done.filter("resolved_answer = '[Dismissed]'").collect()) == [0, (1 << 32) + 1, (3 << 32) + 1]


def test_summary_of_dismissals_counts_lines_of_documents(spark, tmp_path):
    total = QUERIES["dismiss_summary"](spark, _dismissal_tables(spark, tmp_path)).head()
    assert (total.requested_ids, total.dismissed_groups, total.dismissed_occurrences, total.not_found_ids) == (4, 2, 3, 2)
