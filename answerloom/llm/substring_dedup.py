"""Repeated passages by relative Lempel-Ziv parsing (operator 12).

The corpus is its own reference.  It is cut into cells at anchors: the least of
the hashed ANCHOR-word stretches of a window of WINDOW words is the window's
anchor, and a cell is the text under all windows of one anchor place.  Equal
windows have equal anchors at the same place inside, so a passage is cut alike
wherever it stands.  Cells are dealt by their anchor to reference blocks; the
index of a block names the first place of each cell.

A document is then factored against all blocks from left to right: a factor
starts at the first cell with an earlier copy and goes on while the next cell's
copy follows in the same source, so factors are as long as the reference allows,
and each has WINDOW words or more.  Where a factor ends, the next cell has no
earlier copy as a whole, yet some of its windows may have one: if its anchor also
stands elsewhere, its windows are looked up one by one.  A window and its first
copy lie both in such cells, or in a factor, so no repeated window is missed.

Words are compared by 64-bit hashes.  Rows of a task that repeat an earlier row
of the same task are settled there; so a passage that stands in every document
sends one row for each chunk of a task, not one for each document.

"Earlier" means smaller document id (null last), then smaller start.  Rows that
share an id are told apart by a hash of their text; wholly repeated rows count as
one document and each gets the same result.  Null, empty and short texts have no
windows and stay as they are.  Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from answerloom.llm.words import BASE, Words, mixed, prefix_sums, stretch, word_chunks

WINDOW = 20
ANCHOR = 6
#: Window starts whose anchors are found at once.
SECTION = 1 << 20
#: Anchors are told apart by 48 bits: taking two for one only looks up more windows.
ROUTE_SHIFT = np.uint64(16)


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on."""
    out = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size if len(out) else 0):
        out = out * BASE + words[k : len(out) + k]
    return mixed(out)


def _anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` hashes in a row, the leftmost of equal ones."""
    places = []
    bits = np.uint64(SECTION.bit_length() + 1)
    for first in range(0, len(grams) - width + 1, SECTION):
        own = grams[first : first + SECTION + width - 1]
        ranked = (own >> bits << bits) | np.arange(len(own), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            ranked = np.minimum(ranked[:-span], ranked[span:])
            span *= 2
        ranked = np.minimum(ranked[: len(own) - width + 1], ranked[width - span :])
        places.append((ranked & np.uint64((1 << int(bits)) - 1)).astype(np.int64) + first)
    return np.concatenate(places) if places else np.zeros(0, np.int64)


def cells(words: Words) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor hash, cell hash) of all cells; starts count from the first word of all texts."""
    grams = _grams(words.hashes, ANCHOR)
    anchor = _anchors(grams, WINDOW - ANCHOR + 1)
    text = words.texts
    start = np.flatnonzero(text[: len(anchor)] == text[WINDOW - 1 :]) if len(anchor) else np.zeros(0, np.int64)
    anchor = anchor[start]
    first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(text[start], prepend=-1) != 0))
    number = np.diff(np.append(first, len(start)))
    begin, anchor = start[first], anchor[first]
    whole = stretch(prefix_sums(words.hashes), begin, begin + number + WINDOW - 1)
    cell = mixed(whole ^ mixed((anchor - begin).astype(np.uint64) + np.uint64(1)))
    return text[begin], begin, number, grams[anchor], cell


def _first_copies(values: np.ndarray, rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Index of the first row, by (rank, start), with the same value as each row."""
    order = np.lexsort((start, rank, values))
    fresh = np.diff(values[order], prepend=values[order][:1] + np.uint64(1)) != 0
    out = np.empty(len(values), np.int64)
    out[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(order) else order
    return out


def _ranks(rows: pa.Table) -> np.ndarray:
    """Rank of each row's document by (lost, id, tie); rows of one document share it."""
    keys = rows.select(["id", "tie"]).append_column("lost", pc.less(rows.column("tie"), 0))
    order = pc.sort_indices(keys, sort_keys=[(n, "ascending") for n in ("lost", "id", "tie")])
    ids, ties = keys.column("id").take(order).to_pylist(), keys.column("tie").take(order).to_pylist()
    new = [0] + [int((a, b) != (c, d)) for a, b, c, d in zip(ids, ties, ids[1:], ties[1:])]
    out = np.empty(len(order), np.int64)
    out[order.to_numpy()] = np.cumsum(new[: len(order)])
    return out


def _settled(rows: pa.Table, text: np.ndarray, start: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that repeat an earlier one of the same chunk, and the first copies of all rows."""
    rank = _ranks(rows)[text] if len(text) else text
    copy = _first_copies(value, rank, start)
    return (rank[copy] != rank) | (start[copy] != start), copy


def _cell_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, words in word_chunks(batches):
        text, begin, number, anchor, cell = cells(words)
        if not len(text):
            continue
        start = begin - words.firsts[text]
        later, copy = _settled(rows, text, start, cell)
        own, source = rows.select(["id", "tie", "apart"]).take(pa.array(text)), rows.select(["id", "tie"]).take(pa.array(text[copy]))
        named = later & (source.column("tie").to_numpy() >= 0)
        yield from pa.table(
            {
                "id": own.column("id"),
                "tie": own.column("tie"),
                "start": pa.array(start, pa.int32()),
                "windows": pa.array(number, pa.int32()),
                "route": pa.array(np.where(later, own.column("apart").to_numpy(), (anchor >> ROUTE_SHIFT).view(np.int64))),
                "cell": pa.array(cell.view(np.int64), mask=later),
                "source": _where(source.column("id"), named),
                "source_start": pa.array(start[copy], pa.int32(), mask=~later),
            }
        ).to_batches()


def _where(values: pa.ChunkedArray, chosen: np.ndarray) -> pa.Array:
    """The chosen values, null elsewhere."""
    return values.combine_chunks().take(pa.array(np.arange(len(chosen)), mask=~chosen))


def _marks(column: pa.ChunkedArray, names: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
    """Row numbers and fields of a column of lists of structs."""
    lists = column.combine_chunks()
    lists = lists.fill_null([]) if lists.null_count else lists
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return row, [pc.struct_field(flat, name) for name in names]


def _window_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the cells without an earlier copy whose anchor stands elsewhere, too."""
    for rows, words in word_chunks(batches):
        row, (start, number, copied) = _marks(rows.column("cells"), ["start", "windows", "copied"])
        open_ = ~copied.to_numpy(zero_copy_only=False).astype(bool)
        row, start, number = row[open_], start.to_numpy()[open_].astype(np.int64), number.to_numpy()[open_].astype(np.int64)
        text = np.repeat(row, number)
        at = np.repeat(start, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        if not len(at):
            continue
        value = _grams(words.hashes, WINDOW)[words.firsts[text] + at]
        later, _ = _settled(rows, text, at, value)
        own = rows.select(["id", "tie", "apart"]).take(pa.array(text))
        yield from pa.table(
            {
                "id": own.column("id"),
                "tie": own.column("tie"),
                "start": pa.array(at, pa.int32()),
                "route": pa.array(np.where(later, own.column("apart").to_numpy(), value.view(np.int64))),
                "later": pa.array(later),
            }
        ).to_batches()


def _parse_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors, removed words and the rest of each text."""
    for rows, words in word_chunks(batches):
        firsts = words.firsts
        row, (start, number, copied, source, source_start) = _marks(rows.column("cells"), ["start", "windows", "copied", "source", "source_start"])
        own = np.flatnonzero(copied.to_numpy(zero_copy_only=False).astype(bool))
        row, begin, number = row[own], start.to_numpy()[own].astype(np.int64), number.to_numpy()[own].astype(np.int64)
        origin = source_start.take(pa.array(own)).to_numpy().astype(np.int64)
        source = source.take(pa.array(own))
        order = np.lexsort((begin, row))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(row[order]) != 0) | (np.diff(begin[order]) != 0)
        order = order[fresh]
        row, begin, number, origin, source = row[order], begin[order], number[order], origin[order], source.take(pa.array(order))
        _, code = np.unique(np.array(source.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)), return_inverse=True)
        goes_on = np.zeros(len(row), bool)
        goes_on[1:] = (np.diff(row) == 0) & (np.diff(code) == 0) & (begin[1:] == begin[:-1] + number[:-1]) & (np.diff(origin) == np.diff(begin))
        head = np.flatnonzero(~goes_on)
        size = (np.add.reduceat(number, head) if len(head) else number) + WINDOW - 1
        looked_row, (looked_start,) = _marks(rows.column("looked"), ["start"])
        depth = np.zeros(len(words.hashes) + 1, np.int64)
        for at, length in ((firsts[row[head]] + begin[head], size), (firsts[looked_row] + looked_start.to_numpy(), WINDOW)):
            at = at.astype(np.int64)
            np.add.at(depth, at, 1)
            np.add.at(depth, at + length, -1)
        kept = np.cumsum(depth[:-1]) == 0
        removed = np.zeros(len(firsts) + 1, np.int64)
        removed[1:] = np.cumsum(np.bincount(words.texts[~kept], minlength=len(firsts)))
        factors = pa.StructArray.from_arrays(
            [pa.array(begin[head]), pa.array(size), source.take(pa.array(head)), pa.array(origin[head])], ["start", "length", "source", "source_start"]
        )
        yield from pa.table(
            {
                "id": rows.column("id"),
                "tie": rows.column("tie"),
                "n_words": pa.array(words.counts, pa.int64()),
                "n_removed": pa.array(np.diff(removed)),
                "kept": words.joined(kept),
                "factors": pa.ListArray.from_arrays(pa.array(np.searchsorted(row[head], np.arange(len(firsts) + 1)), pa.int32()), factors),
            }
        ).to_batches()


def _order() -> list[Column]:
    return [(F.col("tie") < 0).asc(), *map(F.col, ("id", "tie", "start"))]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, tie, text): ``tie`` is negative for a null id, and holds a hash of the text if any id repeats."""
    kind = docs.select(F.col(doc_id).alias("id")).schema["id"].dataType.simpleString()
    whole = F.coalesce(F.col(text), F.lit(""))
    # only whether an id repeats reaches the driver
    repeats = bool(docs.groupBy(F.col(doc_id)).count().filter("count > 1").limit(1).count())
    own = F.hash(whole).cast("long") + 2**31 if repeats else F.lit(0).cast("long")
    given = docs.select(F.col(doc_id).alias("given"), whole.alias("text"))
    return given.select(
        F.coalesce("given", F.lit("0").cast(kind)).alias("id"), F.when(F.col("given").isNull(), -1 - own).otherwise(own).alias("tie"), "text"
    )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, factors) of each row.

    ``kept`` is the text without the words under repeated windows, joined by one
    space; ``factors`` lists (start, length, source, source_start) of the long
    factors, where ``source`` is an earlier document that holds the same words.
    """
    given = _keyed(docs, doc_id, text)
    kind = given.schema["id"].dataType.simpleString()
    # settled rows of a document go to a place of their own; not a column of ``given``, so that its texts are dealt out once
    apart = F.xxhash64("id", "tie").alias("apart")
    found = given.select("id", "tie", apart, "text").mapInArrow(_cell_task, f"id {kind}, tie long, start int, windows int, route long, cell long, source {kind}, source_start int")
    by_cell = Window.partitionBy("route", "cell").orderBy(*_order())
    indexed = (
        found.repartition("route")
        .withColumns({"place": F.rank().over(by_cell), "first": F.first(F.struct("id", "tie", "start")).over(by_cell)})
        .filter("place > 0")  # keeps the windows in this order, so that one sort serves both
        .withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("route")))
        .withColumn("later", F.col("cell").isNull())
        .filter("copies > 1 OR later")
    )
    copied = F.col("later") | (F.col("place") > 1)
    far = F.when(F.col("first.tie") >= 0, F.col("first.id"))
    mark = F.struct(
        "start", "windows", copied.alias("copied"), F.when(F.col("later"), F.col("source")).when(F.col("place") > 1, far).alias("source"),
        F.when(F.col("later"), F.col("source_start")).when(F.col("place") > 1, F.col("first.start")).alias("source_start"),
    )
    # a hash join takes the marks of a partition into memory and does not sort the texts
    marks = indexed.groupBy("id", "tie").agg(F.collect_list(mark).alias("cells")).hint("shuffle_hash")
    marked = given.join(marks, ["id", "tie"], "left")
    looked = (
        marked.filter(F.exists("cells", lambda c: ~c["copied"]))
        .select("id", "tie", apart, "text", "cells")
        .mapInArrow(_window_task, f"id {kind}, tie long, start int, route long, later boolean")
        .withColumn("place", F.rank().over(Window.partitionBy("route").orderBy(*_order())))
        .filter("later OR place > 1")
        .select("id", "tie", "start")
        .repartition("id", "tie")  # rows are smaller than lists of one start each
        .groupBy("id", "tie")
        .agg(F.collect_set(F.struct("start")).alias("looked"))
        .hint("shuffle_hash")
    )
    parsed = marked.join(looked, ["id", "tie"], "left").select("id", "tie", "text", "cells", "looked")
    factors = f"array<struct<start:long,length:long,source:{kind},source_start:long>>"
    done = parsed.mapInArrow(_parse_task, f"id {kind}, tie long, n_words long, n_removed long, kept string, factors {factors}")
    return done.select(F.when(F.col("tie") >= 0, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept", "factors")
