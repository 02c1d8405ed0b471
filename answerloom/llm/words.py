"""Words of whole texts as numpy arrays.

A word is a run of bytes other than space and U+0009-U+000D; those bytes never
occur inside a longer UTF-8 character, so cutting bytes and cutting code points
agree.  A word is known by a 64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task turns into arrays at once; one longer text is a piece of its own.
CHUNK_BYTES = 4_000_000

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0xD1342543DE82EF95)
_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: BASE times this is 1, modulo 2**64.
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = {BASE: np.ones(1, np.uint64), UNBASE: np.ones(1, np.uint64)}


def powers(size: int, base: np.uint64 = BASE) -> np.ndarray:
    """The base to the powers 0 .. size - 1, modulo 2**64."""
    while len(_powers[base]) < size:
        _powers[base] = np.concatenate([_powers[base], _powers[base] * (_powers[base][-1:] * base)])
    return _powers[base][:size]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over the whole number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums whose differences are hashes of stretches; see ``stretch``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end) that do not depend on where they stand or in which array."""
    return (sums[end] - sums[start]) * powers(len(sums), UNBASE)[start]


@dataclass
class Words:
    """Words of several texts, one text after the other."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray

    @property
    def firsts(self) -> np.ndarray:
        """Number of the first word of each text."""
        return np.cumsum(self.counts) - self.counts

    @property
    def texts(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def joined(self, kept: np.ndarray) -> pa.Array:
        """The kept words of each text, joined by one space."""
        words = np.flatnonzero(kept)
        text = self.texts[words]
        number = np.bincount(text, minlength=len(self.counts))
        blank = np.ones(len(words), np.int64)
        blank[(np.cumsum(number) - 1)[number > 0]] = 0
        length = self.ends[words] - self.starts[words]
        end = np.cumsum(length + blank)
        place = np.repeat(self.starts[words] - (end - length - blank), length + blank) + np.arange(end[-1] if len(end) else 0)
        out = self.data[np.minimum(place, max(len(self.data) - 1, 0))]
        out[end[blank == 1] - 1] = 32
        sizes = np.zeros(len(self.counts) + 1, np.int64)
        np.add.at(sizes, text + 1, length + blank)
        offsets = np.cumsum(sizes)
        return pa.LargeStringArray.from_buffers(len(self.counts), pa.py_buffer(offsets), pa.py_buffer(out.tobytes())).cast(pa.string())


def words_of(texts: pa.Array) -> Words:
    """Words of an Arrow array of strings, null as empty."""
    whole = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = whole.buffers()
    places = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    size = int(places[-1] - places[0])
    raw = np.frombuffer(data, np.uint8, size, int(places[0])) if size else np.zeros(0, np.uint8)
    places = places - places[0]
    solid = ~_BLANK[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cut = np.unique(places[(places > 0) & (places < size)])
    begins[cut] = solid[cut]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    stops[cut - 1] = solid[cut - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    counts = np.diff(np.searchsorted(starts, places))
    sums = prefix_sums(_VALUES[raw])
    return Words(raw, starts, ends, counts, mixed(stretch(sums, starts, ends)))


def word_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.Table, Words]]:
    """Pieces of the input of about ``size`` bytes of text with their words."""
    for batch in batches:
        whole = pa.Table.from_batches([batch])
        lengths = np.array([0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
        piece = (np.cumsum(lengths) - lengths) // size
        firsts = np.flatnonzero(np.diff(piece, prepend=-1))
        for first, last in zip(firsts, [*firsts[1:], len(lengths)]):
            rows = whole.slice(first, last - first)
            yield rows, words_of(rows.column(column).combine_chunks())
