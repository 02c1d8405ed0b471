"""Lookups on keys of which a few may hold most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from answerloom.session import freeing

#: Keys that get their own counters, and the share of the rows that makes a key hot.
TRACKED = 10_000
SHARE = 0.01


def hot_keys(rows: DataFrame, keys: list[str], share: float = SHARE) -> list[int]:
    """Hashes of the keys that hold at least ``share`` of the rows; at most 1 / share of them.

    A sketch counts too high, never too low, so no hot key is missed.
    """
    most = int(1 / share)
    known = rows.select(_digest(keys).alias("digest")).filter("digest IS NOT NULL")
    with freeing(rows.sparkSession):
        top, total = known.agg(F.expr(f"approx_top_k(digest, {most}, {TRACKED})"), F.count(F.lit(1))).head()
    return sorted(r["item"] for r in top if total and r["count"] >= share * total)


def _digest(keys: list[str]) -> Column:
    """Hash of the keys as texts, so that an int and a bigint agree; null if one is null."""
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    return F.when(known, F.xxhash64(*[F.col(k).cast("string") for k in keys]))


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left", counted: DataFrame | None = None, hot: list[int] | None = None) -> DataFrame:
    """``rows`` joined with a ``table`` that has one row per key; keys are whole numbers or texts.

    Rows of hot keys meet a broadcast of their few lookup rows where they are;
    all others meet by an ordinary shuffle.  ``counted`` has the same keys as
    ``rows`` and is cheaper to read; ``hot`` are hot keys that are known already.
    """
    hot = hot_keys(rows if counted is None else counted, keys) if hot is None else hot
    if not hot:
        return rows.join(table, keys, how)
    is_hot = F.coalesce(_digest(keys).isin(hot), F.lit(False))
    few = F.broadcast(table.filter(is_hot))
    return rows.filter(is_hot).join(few, keys, how).unionByName(rows.filter(~is_hot).join(table.filter(~is_hot), keys, how))
