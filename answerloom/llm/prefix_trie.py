"""Trie of conversation prefixes by a skeleton of splitter paths (operator 13).

A conversation is the path of its turns; a turn is known by a 128-bit digest of
role and text.  Paths are ordered, and conversation ids break ties, so any group
of equal paths can be cut.  Splitters from a bounded sample deal the paths into
ranges.  A node (a distinct prefix) whose members lie on both sides of a splitter
is a prefix of that splitter's path: these nodes form the skeleton, which is
broadcast.  Each range holds all members of every other node and finishes it
alone; of the skeleton's nodes it gives partial aggregates, which are reduced by
node and then summed along the skeleton, from the deepest nodes up.

Only digests, sizes and ids are dealt out, never texts.  The skeleton holds at
most SHARDS paths; a splitter is cut behind the turn at which it leaves the
sampled path before it, unless both paths are equal.  Ids that end at a skeleton
node travel as sorted lists, one for each range.

Turns are ordered by ``turn`` (null first), equal ones by the digest; repeated
rows are turns of their own.  Null role and text count as empty.  Rows without
conversation id are left out.  An empty table has no nodes.  Conversations
without turns end at the root.  Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from answerloom.llm.common import stored

#: Turns of a range, most ranges, and sampled paths for each range.
SHARD_TURNS = 2_000
SHARDS = 20_000
OVERSAMPLE = 5

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PART = f"{NODE}, skeleton long, parent_skeleton long, shard int, ends binary"


def turn_digest(role: Column, text: Column) -> Column:
    """Digest of a turn, lowercase hex; the length keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))


def paths(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, path): per conversation the array of (digest, size) of its turns; size is the text's UTF-8 bytes."""
    given = turns.select(
        F.col(conv_id).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        turn_digest(F.col(role), F.col(text)).alias("digest"),
        F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("size"),
    ).filter("conv IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("has"), "turn", "digest", "size")))
    return given.groupBy("conv").agg(ordered.alias("turns")).select("conv", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("path"))


def _splitters(given: DataFrame, shard_turns: int, shards: int) -> list[tuple[tuple[str, ...], int]]:
    """Sorted splitters (path, conversation); range k holds what is at or above splitter k and below the next."""
    n, turns = given.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("path")), F.lit(0))).head()
    wanted = min(shards, -(-(n + turns) // shard_turns), n)
    if wanted < 2:
        return []
    sample = given.orderBy(F.xxhash64("conv"), "conv").limit(OVERSAMPLE * wanted).select("conv", F.transform("path", lambda t: t["digest"]).alias("path"))
    known = sorted((tuple(r["path"]), r["conv"]) for r in sample.collect())
    found = []
    for k in range(1, wanted):
        place = k * len(known) // wanted
        (before, _), (path, conv) = known[place - 1], known[place]
        if before != path:
            same = next((i for i, (a, b) in enumerate(zip(before, path)) if a != b), min(len(before), len(path)))
            path, conv = path[: same + 1], -(2**63)
        if not found or found[-1] < (path, conv):
            found.append((path, conv))
    return found


class _Skeleton:
    """Prefixes of the splitters' paths, numbered so that a parent comes before its children."""

    def __init__(self, splitters: list[tuple[tuple[str, ...], int]]):
        self.splitters = splitters
        self.parents, self.depths = [-1], [0]
        self.children: list[dict[str, int]] = [{}]
        for path, _ in splitters:
            node = 0
            for digest in path:
                if digest not in self.children[node]:
                    self.children[node][digest] = len(self.parents)
                    self.parents.append(node)
                    self.depths.append(self.depths[node] + 1)
                    self.children.append({})
                node = self.children[node][digest]


def _shard(splitters: list[tuple[tuple[str, ...], int]]):
    """Range of each row of (path of digests, conversation)."""
    from bisect import bisect_right

    @F.pandas_udf("int")
    def place(path: pd.Series, conv: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(splitters, (tuple(p), c)) for p, c in zip(path, conv)], dtype="int32")

    return place


def _ends(ids: np.ndarray) -> str:
    from hashlib import sha256

    return sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def _finish(shared) -> callable:
    """Nodes of one range: whole rows, and partial rows of skeleton nodes."""

    def run(key: tuple[pa.Scalar, ...], given: pa.Table) -> pa.Table:
        skeleton: _Skeleton = shared.value
        conv = given.column("conv").to_numpy()
        size = np.array([len(p) for p in given.column("digests").to_pylist()], np.int64)
        rows = given.column("digests").to_pylist()
        order = sorted(range(len(rows)), key=lambda i: (rows[i], conv[i]))
        rows, conv, size = [rows[i] for i in order], conv[order], size[order]
        weight = given.column("sizes").combine_chunks().take(pa.array(order)).flatten().to_numpy(zero_copy_only=False)
        n = len(rows)
        shared_turns = np.zeros(n, np.int64)
        for i in range(1, n):
            a, b = rows[i - 1], rows[i]
            k, most = 0, min(len(a), len(b))
            while k < most and a[k] == b[k]:
                k += 1
            shared_turns[i] = k
        # one node for each turn that is not shared with the path before; node 0 is the root
        new = size - shared_turns
        first_turn = np.cumsum(size) - size
        node_row = np.repeat(np.arange(n), new)
        depth = np.concatenate([[0], np.arange(new.sum()) - np.repeat(np.cumsum(new) - new - shared_turns, new) + 1])
        weights = np.concatenate([[0], weight[np.repeat(first_turn, new) + depth[1:] - 1]]) if len(weight) else np.zeros(1, np.int64)
        total = len(depth)
        parent = np.zeros(total, np.int64)
        on_path = np.zeros(int(size.max(initial=0)) + 1, np.int64)
        number = np.zeros(total, np.int64)
        least = np.full(total, np.iinfo(np.int64).max)
        bone = np.full(total, -1, np.int64)
        bone[0] = 0
        at, last = 1, np.zeros(n, np.int64)
        for i in range(n):
            for d in range(shared_turns[i] + 1, size[i] + 1):
                parent[at] = on_path[d - 1]
                if bone[parent[at]] >= 0:
                    bone[at] = skeleton.children[bone[parent[at]]].get(rows[i][d - 1], -1)
                on_path[d] = at
                at += 1
            last[i] = on_path[size[i]]
        # aggregates from the deepest nodes up; nodes are numbered in depth-first order
        np.add.at(number, last, 1)
        np.minimum.at(least, last, conv)
        ended = number.copy()
        children = np.bincount(parent[1:][bone[1:] < 0], minlength=total)
        leaves, saved = np.zeros(total, np.int64), np.zeros(total, np.int64)
        by_depth = np.argsort(depth, kind="stable")
        for own in np.split(by_depth, np.cumsum(np.bincount(depth))[:-1])[:0:-1]:
            plain = own[bone[own] < 0]
            leaves[plain] += children[plain] == 0
            saved[plain] += (number[plain] - 1) * weights[plain]
            np.add.at(number, parent[own], number[own])
            np.minimum.at(least, parent[own], least[own])
            np.add.at(leaves, parent[plain], leaves[plain])
            np.add.at(saved, parent[plain], saved[plain])
        by_end = np.argsort(last, kind="stable")
        ends_from = np.cumsum(ended) - ended
        texts, lists = [], []
        nothing = _ends(conv[:0])
        for v in range(total):
            ids = np.sort(conv[by_end[ends_from[v] : ends_from[v] + ended[v]]]) if ended[v] else conv[:0]
            texts.append(None if bone[v] >= 0 else _ends(ids) if len(ids) else nothing)
            lists.append(",".join(map(str, ids.tolist())).encode() if bone[v] >= 0 else None)
        above = np.where(bone[parent] >= 0, bone[parent], -1)
        return pa.table(
            {
                "conv_id": least,
                "depth": depth,
                "parent_conv_id": pa.array(least[parent], mask=above >= 0),
                "n_convs": number,
                "n_children": children,
                "n_leaves": leaves,
                "saved_tokens": saved,
                "ends_sha256": pa.array(texts, pa.string()),
                "skeleton": pa.array(bone, mask=bone < 0),
                "parent_skeleton": pa.array(above, mask=(above < 0) | (depth == 0)),
                "shard": pa.array(np.full(total, key[0].as_py()), pa.int32()),
                "ends": pa.array(lists, pa.binary()),
                "weight": pa.array(weights, pa.int64()),
            }
        )

    return run


def _reduced(skeleton: _Skeleton, parts: DataFrame) -> pd.DataFrame:
    """Skeleton nodes with aggregates of their whole subtrees, without their ends."""
    sums = parts.groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("weight").alias("weight"),
    )
    done = sums.toPandas().sort_values("skeleton", ignore_index=True)
    column = {name: done[name].to_numpy(np.int64).copy() for name in done.columns}
    for v in range(len(done) - 1, -1, -1):
        column["n_children"][v] += len(skeleton.children[v])
        column["n_leaves"][v] += column["n_children"][v] == 0
        column["saved_tokens"][v] += (column["n_convs"][v] - 1) * column["weight"][v]
        if v:
            for name in ("n_leaves", "saved_tokens"):
                column[name][skeleton.parents[v]] += column[name][v]
    column["depth"] = np.array(skeleton.depths[: len(done)], np.int64)
    out = pd.DataFrame(column).drop(columns="weight")
    above = np.array(skeleton.parents[: len(done)], np.int64)
    out["parent_conv_id"] = pd.array(column["conv_id"][np.maximum(above, 0)], dtype="Int64") if len(done) else pd.array([], dtype="Int64")
    out.loc[above < 0, "parent_conv_id"] = pd.NA
    return out


def nodes(given: DataFrame, shard_turns: int = SHARD_TURNS, shards: int = SHARDS) -> DataFrame:
    """One row per distinct prefix of the paths of ``given`` (conv, path); see ``paths``."""
    spark = given.sparkSession
    given = stored(given)
    splitters = _splitters(given, shard_turns, shards)
    skeleton = _Skeleton(splitters)
    shared = spark.sparkContext.broadcast(skeleton)
    flat = given.select("conv", F.transform("path", lambda t: t["digest"]).alias("digests"), F.transform("path", lambda t: t["size"]).alias("sizes"))
    dealt = flat.withColumn("shard", _shard(splitters)("digests", "conv"))
    parts = stored(dealt.groupBy("shard").applyInArrow(_finish(shared), f"{PART}, weight long"))
    bones = parts.filter("skeleton IS NOT NULL")
    reduced = spark.createDataFrame(
        _reduced(skeleton, bones).astype({"parent_conv_id": "object"}).where(lambda f: f.notna(), None),
        "skeleton long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, depth long, parent_conv_id long",
    )
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard", F.col("ends").cast("string").alias("ids")))), lambda e: e["ids"]), ",")
    ends = bones.filter("length(ends) > 0").groupBy("skeleton").agg(F.sha2(listed, 256).alias("found"))
    names = [c.split()[0] for c in NODE.split(", ")]
    whole = reduced.join(ends, "skeleton", "left").withColumn("ends_sha256", F.coalesce("found", F.sha2(F.lit(""), 256))).select(*names)
    lowest = reduced.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("lowest"))
    local = (
        parts.filter("skeleton IS NULL")
        .join(F.broadcast(lowest), "parent_skeleton", "left")
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "lowest"))
        .select(*names)
    )
    return local.unionByName(whole)
