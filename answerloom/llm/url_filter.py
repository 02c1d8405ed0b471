"""URL filters with dated list entries (operator 3).

The entries of a list are dated ``add`` and ``remove`` marks on a key.  In date
order they become validity intervals.  A capture is tested against the entries
that were active when it was fetched: an as-of join on its host, the host's
parent domains and its host with first path segment.  Intervals are cut at
fixed time cells, so that the join is an equality on key and cell with few
intervals each, and the rows of a busy key can be split freely.

The most specific key decides (host and path, then the longest domain), then
``allow`` over ``block``, then the list's name.  An entry counts from its day up
to, not including, the day of the next mark of its list and key; of marks on one
day the last by ``seq`` counts.  Captures without a host, a url or a fetch day
match nothing.  Repeated captures give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from answerloom.llm.common import stored

CELL_DAYS = 32
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: Column) -> Column:
    """Lower-case host without port, user and final dot; null if there is none."""
    name = F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit("."))
    return F.when(name != "", name)


def keys(url: Column) -> Column:
    """Keys that may decide about a url: its host, parent domains, and host with first path segment."""
    labels = F.split(host(url), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    path = F.when(segment != "", F.array(F.concat_ws("/", host(url), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host(url).isNotNull(), F.array_distinct(F.concat(parents, path)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, verdict, key, valid_from, valid_until) from marks (list_name, verdict, key, action, effective, seq)."""
    history = Window.partitionBy("list_name", "verdict", "key").orderBy("effective", "seq")
    return (
        entries.filter("effective IS NOT NULL AND key IS NOT NULL")
        .withColumn("valid_until", F.lead("effective").over(history))
        .filter("action = 'add' AND (valid_until IS NULL OR valid_until > effective)")
        .select("list_name", "verdict", "key", F.col("effective").alias("valid_from"), "valid_until")
    )


def evaluate(captures: DataFrame, entries: DataFrame, cell_days: int = CELL_DAYS) -> DataFrame:
    """Captures (id, url, fetched) with verdict, list_name, matched_key, valid_from, valid_until."""
    cell = lambda day: F.floor(F.unix_date(day) / cell_days)
    # a few rows of time bounds; open intervals end with the last capture
    span = captures.agg(F.min("fetched").alias("first"), F.max("fetched").alias("last"))
    valid = stored(
        intervals(entries).join(F.broadcast(span), F.col("valid_from") <= F.col("last"))
        .filter("valid_until IS NULL OR valid_until > first")
        .withColumn(
            "cell",
            F.explode(F.sequence(cell(F.greatest("valid_from", "first")), cell(F.least(F.coalesce(F.date_sub("valid_until", 1), F.col("last")), F.col("last"))))),
        )
        .drop("first", "last")
    )
    asked = captures.filter("fetched IS NOT NULL").select("id", "url", "fetched", cell(F.col("fetched")).alias("cell"), F.explode(keys(F.col("url"))).alias("key"))
    found = asked.join(valid, ["key", "cell"]).filter("valid_from <= fetched AND (valid_until IS NULL OR fetched < valid_until)")
    rank = F.struct(F.col("key").contains("/").alias("path"), F.length("key").alias("size"), (F.col("verdict") == "allow").alias("allow"))
    best = found.groupBy("id", "url", "fetched").agg(
        F.min_by(
            F.struct("verdict", "list_name", F.col("key").alias("matched_key"), "valid_from", "valid_until"),
            F.struct((~rank["path"]).alias("a"), (-rank["size"]).alias("b"), (~rank["allow"]).alias("c"), F.col("list_name").alias("d")),
        ).alias("_hit")
    ).select(F.col("id").alias("_id"), F.col("url").alias("_url"), F.col("fetched").alias("_fetched"), "_hit.*")
    same = captures["id"].eqNullSafe(best["_id"]) & captures["url"].eqNullSafe(best["_url"]) & captures["fetched"].eqNullSafe(best["_fetched"])
    return (
        captures.join(best, same, "left")
        .withColumn("verdict", F.coalesce("verdict", F.lit("none")))
        .drop("_id", "_url", "_fetched")
    )
