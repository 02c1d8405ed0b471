"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from answerloom.session import stored  # noqa: F401  the operators import it from here

#: Characters of text that a task turns into arrays at once.
CHUNK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % modulus


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", chars: int = CHUNK_CHARS) -> Iterator[tuple[pa.Table, list[str]]]:
    """Pieces of the input of at most about ``chars`` characters, null texts as empty.

    One text longer than the bound is a piece of its own.
    """
    for batch in batches:
        texts = ["" if t is None else t for t in batch.column(column).to_pylist()]
        whole = pa.Table.from_batches([batch])
        start = size = 0
        for i, text in enumerate(texts):
            if size and size + len(text) > chars:
                yield whole.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(text)
        if start < len(texts):
            yield whole.slice(start), texts[start:]


#: Bytes of a memo of words in a Python worker, and of a word in it besides its letters.
MEMO_BYTES = 64 << 20
WORD_BYTES = 160

_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """The one thing that a Python worker keeps between tasks: made anew when another name was held."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


class WordTable:
    """Bounded memo from words to arrays of numbers.

    ``describe(words)`` returns the lengths and the values of the words' arrays,
    one after the other.  It is called once for each word that is not known.
    When the table has grown to its budget of bytes it starts again from nothing,
    so memory is bounded and results never depend on what was seen before.
    """

    def __init__(self, describe: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype, budget: int = MEMO_BYTES):
        self.describe, self.dtype, self.budget = describe, dtype, budget
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.zeros(1024, np.int64)
        self.lengths = np.zeros(1024, np.int64)
        self.values = np.zeros(4096, self.dtype)
        self.used = self.letters = 0

    @property
    def bytes(self) -> int:
        """About what the table holds: its arrays, and for each word its letters and places in the dictionary."""
        return self.values.nbytes + self.starts.nbytes + self.lengths.nbytes + self.letters + WORD_BYTES * len(self.known)

    def rows(self, words: list[str]) -> np.ndarray:
        """Row number of each word; valid until the next call."""
        if self.bytes > self.budget:
            self._clear()
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if missing.size:
            lacking = [words[i] for i in missing.tolist()]
            self._add(list(dict.fromkeys(lacking)))
            found[missing] = np.fromiter(map(self.known.__getitem__, lacking), np.int64, len(lacking))
        return found

    def _add(self, words: list[str]) -> None:
        lengths, values = self.describe(words)
        first = len(self.known)
        last = first + len(words)
        self.known.update(zip(words, range(first, last)))
        self.letters += sum(map(len, words))
        self.starts, self.lengths = _room(self.starts, last), _room(self.lengths, last)
        self.values = _room(self.values, self.used + len(values))
        self.lengths[first:last] = lengths
        self.starts[first:last] = self.used + np.cumsum(lengths) - lengths
        self.values[self.used : self.used + len(values)] = values
        self.used += len(values)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and joined values of the given rows."""
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[rows] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return lengths, self.values[at]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


def sums_by_part(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts of ``values``; ``counts`` are their lengths, which may be 0."""
    ends = np.cumsum(counts)
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[ends] - total[ends - counts]
