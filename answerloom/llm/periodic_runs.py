"""Periodic runs of words by recursive frequency splitting (operator 11).

A run is a stretch of consecutive words with smallest period q and at least
``max(LEAST, TIMES * q)`` words that no neighbouring word extends keeping the
period.  Each of its words stands in it at least TIMES times.  So a word that
occurs less often than that within the current segment cannot join a run there:
it splits the segment, counts are taken anew in the parts, and so on until
nothing splits.  What is left is scanned at every lag q: three blocks of q words
that start at a multiple of q must be equal, and a block stretch that already
has a shorter period is passed over; then the stretch is extended to both sides.
A segment of n words costs n log n.

Null and empty texts, and texts of fewer than LEAST words, have no runs and keep
all their words.  Each row is its own document, so repeated rows and null ids
give rows of their own.  Only the id and the text are read; other columns may
have any name.  Ties of the longest run go to the smallest start, then period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from answerloom.llm.words import mixed, powers, prefix_sums, word_chunks

LEAST = 6
TIMES = 4
#: Pairs of places that are compared at once.
PAIRS = 2_000_000

SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def split(words: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the segments that recursive frequency splitting leaves."""
    _, word = np.unique(words, return_inverse=True)
    n_words = int(word.max()) + 1 if len(word) else 1
    starts, lengths = firsts, counts
    while True:
        long = lengths >= LEAST
        starts, lengths = starts[long], lengths[long]
        segment = np.repeat(np.arange(len(lengths)), lengths)
        place = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        _, which, often = np.unique(segment * n_words + word[place], return_inverse=True, return_counts=True)
        kept = often[which] >= TIMES
        if kept.all():
            return starts, lengths
        place, segment = place[kept], segment[kept]
        new = np.flatnonzero((np.diff(place, prepend=-2) != 1) | (np.diff(segment, prepend=-1) != 0))
        starts, lengths = place[new], np.diff(np.append(new, len(place)))


def _least_factors(size: int) -> np.ndarray:
    least = np.arange(size + 1)
    for p in range(2, int(size**0.5) + 1):
        if least[p] == p:
            own = least[p * p :: p]
            own[own == np.arange(p * p, size + 1, p)] = p
    return least


def _equal(sums: np.ndarray, at: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` words from ``at`` equal those ``lag`` later."""
    return (sums[at + size] - sums[at]) * powers(len(sums))[lag] == sums[at + lag + size] - sums[at + lag]


def _reach(sums: np.ndarray, at: np.ndarray, lag: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
    """How many words, ``most`` at the most, agree with those ``lag`` later, from ``at`` on or before it."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = _equal(sums, at if forward else at - middle, lag, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def scan_lag(words: np.ndarray, lag: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of stretches of one lag, smaller periods included."""
    same = np.concatenate([[False], words[:-lag] == words[lag:], [False]])
    edge = np.flatnonzero(np.diff(same.astype(np.int8)))
    found = zip(edge[::2].tolist(), (edge[1::2] + lag - edge[::2]).tolist())
    return [(s, n, lag) for s, n in found if n >= max(LEAST, TIMES * lag)]


def _lags(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(segment, lag, place) of the block starts of every lag of every segment, in bounded pieces."""
    most = lengths // TIMES
    segment = np.repeat(np.arange(len(lengths)), most)
    lag = np.arange(len(segment)) - np.repeat(np.cumsum(most) - most, most) + 1
    number = lengths[segment] // lag - 2
    total = np.cumsum(number)
    first = 0
    while first < len(segment):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PAIRS, "right")))
        own = number[first:last]
        block = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        seg, q = np.repeat(segment[first:last], own), np.repeat(lag[first:last], own)
        yield seg, q, starts[seg] + block * q
        first = last


def scan(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of the segments, by start, then period."""
    if not len(lengths):
        return np.zeros((0, 3), np.int64)
    sums = prefix_sums(mixed(words ^ np.uint64(0x9E3779B97F4A7C15)))
    least = _least_factors(int(lengths.max()) // TIMES)
    found = []
    for seg, q, at in _lags(starts, lengths):
        like = np.flatnonzero((words[at] == words[at + q]) & (words[at] == words[at + 2 * q]))
        like = like[_equal(sums, at[like], q[like], 2 * q[like])]
        rest = q[like]
        while (rest > 1).any():  # a shorter period divides q, so q over some prime factor is a period
            factor = least[rest]
            short = q[like] // factor
            shorter = (rest > 1) & _equal(sums, at[like], short, 3 * q[like] - short)
            rest = rest // factor
            like, rest = like[~shorter], rest[~shorter]
        seg, q, at = seg[like], q[like], at[like]
        head = np.flatnonzero((np.diff(seg, prepend=-1) != 0) | (np.diff(q, prepend=0) != 0) | (np.diff(at, prepend=-1) != q))
        if not len(head):
            continue
        tail = np.append(head[1:], len(q)) - 1
        seg, q, begin, end = seg[head], q[head], at[head], at[tail] + 3 * q[head]
        begin = begin - _reach(sums, begin, q, np.minimum(q, begin - starts[seg]), False)
        end = end + _reach(sums, end - q, q, np.minimum(q, starts[seg] + lengths[seg] - end), True)
        long = end - begin >= np.maximum(LEAST, TIMES * q)
        for s, b, e, p in zip(seg[long].tolist(), begin[long].tolist(), end[long].tolist(), q[long].tolist()):
            if np.array_equal(words[b : e - p], words[b + p : e]):
                found.append((b, e - b, p))
            else:  # equal hashes of different words: compare the words themselves
                own = words[starts[s] : starts[s] + lengths[s]]
                found += [(starts[s] + x, n, p) for x, n, p in scan_lag(own, p) if not _shorter(own[x : x + n], p)]
    return np.array(sorted(set(found)), np.int64).reshape(-1, 3)


def _shorter(words: np.ndarray, period: int) -> bool:
    return any(period % p == 0 and np.array_equal(words[:-p], words[p:]) for p in range(1, period))


def runs_of(words: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of several texts laid one after the other."""
    runs = scan(words, *split(words, firsts, counts))
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, words in word_chunks(batches):
        firsts = words.firsts
        runs = runs_of(words.hashes, firsts, words.counts)
        depth = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        text = np.searchsorted(firsts + words.counts, runs[:, 0], "right")
        structs = pa.StructArray.from_arrays([pa.array(runs[:, 0] - firsts[text]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(firsts) + 1)), pa.int32()), structs)
        yield from pa.table(
            {
                "_run_id": rows.column("_run_id"),
                "n_words": pa.array(words.counts, pa.int64()),
                "runs": lists,
                "collapsed": words.joined(np.cumsum(depth[:-1]) == 0),
            }
        ).to_batches()


def collapse(docs: DataFrame, doc_id: str | Column = "doc_id", text: str | Column = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row.

    ``runs`` lists (start, length, period) by start, then period; ``collapsed``
    is the text without the words of each run after its first period, joined by
    one space.
    """
    given = docs.select((F.col(doc_id) if isinstance(doc_id, str) else doc_id).alias("_run_id"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    kind = given.schema["_run_id"].dataType.simpleString()
    return given.mapInArrow(_task, f"_run_id {kind}, {SCHEMA}").withColumnRenamed("_run_id", "doc_id")


def longest(runs: Column) -> Column:
    """The longest run of a list; the first of equally long ones."""
    order = lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"), r.alias("run"))
    return F.array_min(F.transform(runs, order))["run"]


def listed(runs: Column) -> Column:
    """Every run as a line ``start,length,period``."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
