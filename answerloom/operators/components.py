"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from answerloom.operators.skew import lookup
from answerloom.session import durable, release


#: Edges of one task; one task needs no shuffle.
EDGES = 100_000


def _large_star(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Hang every larger neighbour on the smallest node around its centre."""
    seen = edges.select(F.col("lo").alias("node"), F.col("lo").alias("seen")).unionByName(
        edges.select(F.col("hi").alias("node"), F.col("lo").alias("seen"))
    )
    smallest = _dealt(seen, tasks).groupBy("node").agg(F.min("seen").alias("root"))
    moved = lookup(edges, smallest.withColumnRenamed("node", "lo"), ["lo"], "inner", hot=_hot(tasks))
    return _dealt(moved.select(F.col("root").alias("lo"), "hi"), tasks).distinct()


def _small_star(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Hang every smaller neighbour, and the centre, on the smallest of them."""
    smallest = edges.groupBy("hi").agg(F.min("lo").alias("root"))
    moved = lookup(edges, smallest, ["hi"], "inner", hot=_hot(tasks)).select(F.col("root").alias("lo"), F.col("lo").alias("hi"))
    centres = smallest.select(F.col("root").alias("lo"), "hi")
    return _dealt(moved.unionByName(centres).filter("lo <> hi"), tasks).distinct()


def _dealt(rows: DataFrame, tasks: int | None) -> DataFrame:
    return rows if tasks is None else rows.coalesce(tasks)


def _hot(tasks: int | None) -> list[int] | None:
    """Hot keys are searched for only where rows are dealt to several tasks."""
    return [] if tasks == 1 else None


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi"))).head()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node with an edge; the root is the lowest id.

    Each round is two joins and aggregations on node ids and goes to reliable
    storage; only a count, a checksum and the centres of hot stars (at most 100)
    reach the driver.  The edges of a hot star meet a broadcast of its new root.
    The number of edges sets the number of tasks, so that many rounds on few edges
    do not leave a file for every shuffle partition.
    """
    current = durable(
        edges.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    )
    stamp = _stamp(current)
    while stamp[0]:
        tasks = -(-stamp[0] // EDGES)
        hung = durable(_large_star(current.coalesce(tasks), tasks))
        after = durable(_small_star(hung.coalesce(tasks), tasks))
        release(hung, current)
        current = after
        previous, stamp = stamp, _stamp(current)
        if stamp == previous:
            break
    current = current.coalesce(max(1, -(-stamp[0] // EDGES)))
    members = current.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
    return members.unionByName(current.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())
