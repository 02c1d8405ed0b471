"""Packing by cutting stock with column generation (operator 10).

Every document is tokenized and closed by one end id.  Blocks of a full sequence
are cut off; what remains is counted in a histogram of lengths rounded up to
``STEP`` tokens.  The driver sees the histogram only: a linear program over
patterns (how many pieces of each length share a sequence) is solved by column
generation, a knapsack by dynamic programming prices new columns.  Patterns are
rounded down, the few lengths left over are packed first-fit decreasing into
further patterns.  Pieces are ranked within their length and a rank names its
pattern, sequence and slot by arithmetic, so assignment is one join with the
short table of patterns.

Null and empty texts consist of the end id alone.  Repeated rows are documents
of their own.  Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyspark
import regex
from pyspark.sql import DataFrame, Window, functions as F, types as T

from answerloom.llm.common import WordTable, held, stored, text_chunks

LENGTH = 4096
END = 2
#: Lengths are counted in steps of so many tokens.
STEP = 16
#: The linear program ends within this share of its optimum.
GAP = 1e-3
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

# Fixed values of the vocabulary's file: its pattern of word parts, and the letters that stand for bytes.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}

#: Parts of words whose ids a Python worker keeps, besides its memo of words.
PARTS_KEPT = 150_000

#: Letters that Python and the tokenizer surely treat alike end before this.
BEYOND = re.compile(r"[^\x00-\u024f]")


class Encoder:
    """Token ids of whole texts, equal to the tokenizer's own, with a memo of words.

    The tokenizer splits at white space and then into parts, so a text's ids are
    its parts' ids one after the other; its model gives each new part's ids.  Words
    with letters beyond Latin go through the whole tokenizer.  Texts for which that or Python's lower case may differ
    (special strings, control characters, letters with a context-dependent lower
    case) are given to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.memo = WordTable(self._describe, np.uint32)
        self.parts: dict[str, list[int]] = {}

    def _describe(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > PARTS_KEPT:
            self.parts.clear()
        known, split, out, lengths = self.parts, PARTS.findall, [], []
        for word in words:
            before = len(out)
            if not word.isascii():
                if BEYOND.search(word):
                    out += self.whole.encode(word, add_special_tokens=False).ids
                    lengths.append(len(out) - before)
                    continue
                word = unicodedata.normalize("NFC", word)
            for part in split(word.lower()):
                ids = known.get(part)
                if ids is None:
                    raw = part if part.isascii() and part.isprintable() else part.encode("utf-8", "replace").decode("latin-1").translate(BYTE_LETTERS)
                    ids = known[part] = [t.id for t in self.whole.model.tokenize(raw)]
                out += ids
            lengths.append(len(out) - before)
        return np.array(lengths, np.int64), np.array(out, np.uint32)

    def _plain(self, text: str) -> bool:
        return "<|" not in text and (text.isascii() or "İ" not in text and "Σ" not in text) and not any(c in text for c in "\x1c\x1d\x1e\x1f")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids."""
        words, counts, apart = [], [], {}
        for n, text in enumerate(texts):
            if self._plain(text):
                own = text.split() if BEYOND.search(text) else text.lower().split()
                words += own
                counts.append(len(own))
            else:
                apart[n] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
                counts.append(0)
        per_word, ids = self.memo.gather(self.memo.rows(words))
        ends = np.concatenate([[0], np.cumsum(per_word)])
        stops = ends[np.cumsum(counts)] if counts else np.zeros(0, np.int64)
        sizes = np.diff(stops, prepend=0)
        if apart:
            parts = np.split(ids, stops[:-1])
            for n, own in apart.items():
                parts[n], sizes[n] = own, len(own)
            ids = np.concatenate(parts)
        return sizes, ids


def encoder(path: str) -> Encoder:
    """One encoder per Python worker, kept across its tasks."""
    return held(path, lambda: Encoder(path))


PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("bin", T.LongType()),
    T.StructField("part", T.LongType()), T.StructField("place", T.LongType()),
])


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of at most ``LENGTH`` ids with their length bin and their place among this task's pieces of the bin."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        part = pyspark.TaskContext.get().partitionId()
        seen = np.zeros(LENGTH // STEP + 1, np.int64)
        for rows, texts in text_chunks(batches):
            sizes, ids = own.encode(texts)
            # the end id of each document goes behind its last id
            ids = np.insert(ids, np.cumsum(sizes), END).astype("<u4")
            sizes = sizes + 1
            count = -(-sizes // LENGTH)
            row = np.repeat(np.arange(len(sizes)), count)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * LENGTH
            length = np.minimum(sizes[row] - start, LENGTH)
            first = (np.cumsum(sizes) - sizes)[row] + start
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist())]
            bins = -(-length // STEP)
            order = np.argsort(bins, kind="stable")
            ranked = bins[order]
            runs = np.concatenate([[0], np.flatnonzero(np.diff(ranked)) + 1, [len(ranked)]]) if len(ranked) else np.zeros(1, np.int64)
            place = np.empty(len(bins), np.int64)
            place[order] = np.arange(len(bins)) - np.repeat(runs[:-1], np.diff(runs)) + seen[ranked]
            seen += np.bincount(bins, minlength=len(seen))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").combine_chunks().take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                    pa.array(sizes[row]), pa.array(bins), pa.array(np.full(len(row), part)), pa.array(place),
                ],
                names=PIECE.names,
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECE)


def solve(size: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and their fractional uses that cover the demand with few sequences.

    Revised simplex on the columns found so far; a knapsack over the dual prices
    gives the entering column, none of price above one means optimal.
    """
    n = len(size)
    basis = np.diag(np.maximum(1, np.minimum(capacity // size, demand))).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    use = inverse @ demand
    for step in range(rounds):
        price = inverse.sum(axis=0)
        value, column = best_column(price, size, capacity)
        if value <= 1 + GAP:  # the best cover has at least sum(use) / value sequences
            break
        move = inverse @ column
        ratio = np.where(move > 1e-9, use / np.where(move > 1e-9, move, 1), np.inf)
        leave = int(np.argmin(ratio))
        basis[:, leave] = column
        use = np.maximum(use - ratio[leave] * move, 0)
        use[leave] = ratio[leave]
        pivot = inverse[leave] / move[leave]
        inverse -= np.outer(move, pivot)
        inverse[leave] = pivot
        if step % 200 == 199:  # rounding errors
            inverse = np.linalg.inv(basis)
            use = np.maximum(inverse @ demand, 0)
    return basis.T.astype(np.int64), use


def best_column(price: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: greatest price and its pattern.

    A pattern may hold more of a length than there are; rounding down copes.
    """
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    good = np.flatnonzero(price > 1e-12)
    order = good[np.argsort(size[good], kind="stable")]
    sizes, prices = size[order], price[order]
    for room in range(1, capacity + 1):
        fit = np.searchsorted(sizes, room, side="right")
        value[room] = value[room - 1]
        if fit:
            offers = value[room - sizes[:fit]] + prices[:fit]
            k = int(offers.argmax())
            if offers[k] > value[room] + 1e-12:
                value[room], choice[room] = offers[k], order[k]
    column = np.zeros(len(size))
    room = capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
            continue
        column[choice[room]] += 1
        room -= int(size[choice[room]])
    return float(value[capacity]), column


def first_fit(size: np.ndarray, count: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """First fit decreasing on counts of lengths: greedy patterns, each used as often as the counts allow."""
    left = count.copy()
    order = np.argsort(-size, kind="stable")
    out = []
    while left.any():
        pattern = np.zeros(len(size), np.int64)
        room = capacity
        for k in order.tolist():
            pattern[k] = min(left[k], room // size[k])
            room -= pattern[k] * size[k]
        uses = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= uses * pattern
        out.append((uses, pattern))
    return out


def plan_patterns(histogram: dict[int, int], capacity: int = LENGTH // STEP) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(uses, bins, pieces of each bin) of every pattern; together they hold the histogram exactly."""
    if not histogram:
        return []
    size = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in size.tolist()])
    patterns, use = solve(size, demand.astype(float), capacity)
    left = demand.copy()
    out = []
    for k in np.argsort(-use, kind="stable").tolist():
        held = patterns[k]
        if not held.any():
            continue
        whole = int(min(np.floor(use[k] + 1e-6), (left[held > 0] // held[held > 0]).min()))
        if whole > 0:
            left -= whole * held
            out.append((whole, held))
    out += first_fit(size, left, capacity)
    # a program that stalls must not cost more than packing greedily from the start
    greedy = first_fit(size, demand, capacity)
    if sum(n for n, _ in greedy) < sum(n for n, _ in out):
        out = greedy
    return [(n, size[held > 0], held[held > 0]) for n, held in out]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, doc_id, text, vocabulary))
    tasks = cut.groupBy("bin", "part").agg(F.count(F.lit(1)).alias("n"))
    # at most LENGTH / STEP rows
    histogram = {r["bin"]: r["n"] for r in tasks.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    rows, sequence, filled = [], 0, {}
    for uses, bins, each in plan_patterns(histogram):
        for b, n in zip(bins.tolist(), each.tolist()):
            first = filled.get(b, 0)
            rows.append((b, first, first + uses * n, n, sequence))
            filled[b] = first + uses * n
        sequence += uses
    slots = spark.createDataFrame(pd.DataFrame(rows, columns=["bin", "low", "high", "each", "base"]), "bin long, low long, high long, each long, base long")
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = tasks.select("bin", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = cut.join(shift, ["bin", "part"]).withColumn("rank", F.col("place") + F.col("shift"))
    # the table of patterns is bounded by the number of bins, not by the documents
    placed = ranked.join(F.broadcast(slots.withColumnRenamed("bin", "_bin")), (F.col("bin") == F.col("_bin")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    inside = Window.partitionBy("sequence_id").orderBy("bin", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("each")))
        .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    )
