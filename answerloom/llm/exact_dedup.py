"""Exact duplicates by digest, with frequent digests split off (operator 6).

Misra-Gries counters (Spark's ``approx_top_k`` sketch) name the digests that may
be frequent.  Their exact counts and winners are computed once and broadcast, so
rows of a frequent text are settled where they are read.  All other digests are
grouped by an ordinary shuffle; by the sketch's bound none of them is large.

Texts are equal when identical without the characters space and U+0009-U+000D.
The row with the most code points stays, then the smallest id (a null id comes
last), then any one of wholly equal rows.  Null texts count as empty.  Extra
columns do not matter; names starting with ``_dup_`` are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerloom.llm.common import stored

BLANKS = " \t\n\x0b\x0c\r"
#: Digests that get their own counters; also the bound of what is broadcast.
HEAVY = 1_000
TRACKED = 10_000


def digest(text: Column) -> Column:
    """Lowercase SHA-256 of the text without blanks, in UTF-8."""
    bare = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        bare = F.replace(bare, F.lit(blank), F.lit(""))
    return F.sha2(bare, 256)


def _winner() -> list[Column]:
    order = F.struct(
        (-F.col("_dup_chars")).alias("chars"), F.col("_dup_id").isNull().alias("lacks"), F.col("_dup_id").alias("id"), F.col("_dup_row").alias("row")
    )
    return [F.count(F.lit(1)).alias("_dup_size"), F.min(order).alias("_dup_best")]


def _digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return stored(
        docs.select(
            F.col(doc_id).alias("_dup_id"),
            F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("_dup_chars"),
            digest(F.col(text)).alias("_dup_digest"),
        ).withColumn("_dup_row", F.monotonically_increasing_id())
    )


def frequent_winners(rows: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """At most ``heavy`` digests with exact sizes and winners."""
    names = rows.agg(F.expr(f"approx_top_k(_dup_digest, {heavy}, {tracked})").alias("top")).select(F.explode("top.item").alias("_dup_digest"))
    counted = rows.join(F.broadcast(names), "_dup_digest", "left_semi").groupBy("_dup_digest").agg(*_winner())
    return stored(counted.filter("_dup_size > 1"))


def decide(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _digests(docs, doc_id, text)
    winners = F.broadcast(frequent_winners(rows, heavy, tracked))
    settled = rows.join(winners, "_dup_digest")
    rest = rows.join(winners, "_dup_digest", "left_anti")
    grouped = rest.join(rest.groupBy("_dup_digest").agg(*_winner()), "_dup_digest")
    return settled.unionByName(grouped).select(
        F.col("_dup_id").alias("doc_id"),
        F.col("_dup_best.id").alias("keep_id"),
        F.col("_dup_size").alias("group_size"),
        (F.col("_dup_row") == F.col("_dup_best.row")).alias("kept"),
        F.col("_dup_digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Losing rows of frequent texts leave where they are read.  Among wholly equal
    id and text one row stays.
    """
    rows = _digests(docs, doc_id, text)
    winners = frequent_winners(rows, heavy, tracked)
    light = rows.join(F.broadcast(winners), "_dup_digest", "left_anti").groupBy("_dup_digest").agg(*_winner())
    kept = winners.unionByName(light).select(F.col("_dup_digest"), F.col("_dup_best.id").alias("_dup_id"))
    marked = docs.withColumns({"_dup_digest": digest(F.col(text)), "_dup_id": F.col(doc_id)})
    heavy_rows = winners.select("_dup_digest", F.col("_dup_best.id").alias("_dup_keep"), F.lit(True).alias("_dup_heavy"))
    passed = marked.join(F.broadcast(heavy_rows), "_dup_digest", "left").filter("_dup_heavy IS NULL OR _dup_id <=> _dup_keep")
    same = passed["_dup_digest"].eqNullSafe(kept["_dup_digest"]) & passed["_dup_id"].eqNullSafe(kept["_dup_id"])
    one = passed.join(kept, same, "left_semi").dropDuplicates(["_dup_digest", "_dup_id"])
    return one.select(*docs.columns)
