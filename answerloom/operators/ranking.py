"""Positions and top rows per group that hold up when one group is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from answerloom.session import durable

BUCKET_WIDTH = 65_536


def running_total(rows: DataFrame, order: str, amount: Column, name: str = "before") -> DataFrame:
    """Add the sum of the amounts of all rows with a smaller ``order``, which must be unique.

    Rows are dealt by ranges of ``order`` and summed within a range; only the
    sums of the ranges, one number for each partition, reach the driver.
    """
    placed = durable(rows.withColumn("_amount", amount).repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    sums = sorted(map(tuple, placed.groupBy("_range").agg(F.sum("_amount")).collect()))
    starts, start = [], 0
    for number, own in sums:
        starts.append((number, start))
        start += own
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "_range int, _start long"))
    return (
        placed.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
        .join(offsets, "_range")
        .withColumn(name, (F.col("_start") + F.col("_inside")).cast("long"))
        .drop("_range", "_amount", "_inside", "_start")
    )


def with_positions(
    df: DataFrame, groups: list[str], order: str, name: str = "position", width: int = BUCKET_WIDTH
) -> DataFrame:
    """Add the 1-based position of each row in its group by a whole-number column.

    ``order`` must be unique within a group.  A group is cut into value ranges
    of ``width``; ranges are numbered separately and shifted by the row count
    of the ranges before them, so no task sorts more than one range.  Without
    groups the ranges are those of a range partitioning.
    """
    if not groups:
        return running_total(df, order, F.lit(1), "_before").withColumn(name, F.col("_before") + 1).drop("_before")
    keyed = df.withColumn("_bucket", F.floor(F.col(order) / width).cast("long"))
    counts = keyed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = (
        Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *groups, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(order)
    return (
        keyed.withColumn("_row", F.row_number().over(inside))
        .join(offsets, [*groups, "_bucket"])
        .withColumn(name, (F.col("_row") + F.col("_offset")).cast("long"))
        .drop("_bucket", "_row", "_offset")
    )


def first_per_group(df: DataFrame, groups: list, order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per group; the row limit is applied before the shuffle."""
    spec = Window.partitionBy(*groups).orderBy(*order)
    ranked = df.withColumn(rank or "_rank", F.row_number().over(spec))
    kept = ranked.filter(F.col(rank or "_rank") <= n)
    return kept if rank else kept.drop("_rank")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered list."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
