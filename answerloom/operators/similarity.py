"""Exact similarity joins over unit vectors.

Vectors are gathered around pivots (a bounded sample of the data) into cells.  Of
each cell the driver knows its pivot, its radius as an angle, the range of its
norms and the range of every coordinate.  Two bounds on the dot product with any
row of a cell follow: one from the triangle inequality on angles, one from the
coordinates (an inverted index of the cells: buckets that no row of a cell has add
nothing).  A row visits a cell only where the smaller bound reaches what the row
still needs, so nothing is approximated.

The best matches are found in two rounds: each row first meets the cell of its
nearest pivot, and its k-th best similarity there is what any other cell must
reach.

Rows and cells meet in tiles: the cells are dealt to zones of bounded size, their
visitors to splits, and a tile is one zone and one split.  A row is sent once for
each zone that holds a cell it visits, with marks for those cells, and a cell once
for each split, both as packed vectors.  A task unpacks some visitors and a part
of a cell at a time and multiplies what meets; there is one plan at every size.
The product is taken in single precision with a bound on its error; what may reach
the floor by it is taken again in double precision.

A hot group of near copies does not blow up the cluster search: vectors that
reach the threshold against their own pivot are linked to it directly, and are
not compared with each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerloom.constants import SIMILARITY_DIGITS
from answerloom.operators.packed import digests, pack, unpack
from answerloom.operators.ranking import first_per_group
from answerloom.session import durable, release

MAX_PIVOTS = 256
ROWS_PER_PIVOT = 512
#: Bytes of vectors of one side of a tile.
BLOCK_BYTES = 16 << 20
#: Rows of one side of a tile, however short their vectors are, and products of it that are held at once.
MAX_PART_ROWS = 16_384
TILE_PRODUCTS = 1 << 22
CHUNK_ROWS = 1024
#: Lengths multiplied in single precision; share of a tile's products from which all are taken exactly; exact ones taken at once.
MOST_SINGLE, DENSE, EXACT_PAIRS = 1e30, 0.02, 4096
MIN_BLOCK_ROWS = 256
#: Bytes of packed vectors of one side of a tile, tiles for each core, pairs sent on at once.
ZONE_BYTES, TILES_A_CORE, PAIRS_SENT = 24 << 20, 4, 1 << 16
ANGLE_SLACK = 2e-3  # 32-bit vectors are unit length only up to rounding
BOUND_SLACK = 1e-5

CELL = "cell int, rows long, radius double, norm_low double, norm_high double, low array<float>, high array<float>"


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


# --- the index ----------------------------------------------------------------


@dataclass
class Bounds:
    """What the driver knows of the cells: at most two cells a pivot."""

    pivots: np.ndarray
    cells: pd.DataFrame

    def __post_init__(self):
        lengths = np.linalg.norm(self.pivots, axis=1)
        self.unit = self.pivots / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.number = self.cells["cell"].to_numpy()
        self.radius, self.norm_low, self.norm_high = (self.cells[c].to_numpy("f8") for c in ("radius", "norm_low", "norm_high"))
        self.low = np.array(self.cells["low"].tolist(), "f8").reshape(len(self.cells), -1)
        self.high = np.array(self.cells["high"].tolist(), "f8").reshape(len(self.cells), -1)

    def home(self, vecs: np.ndarray) -> np.ndarray:
        """Number of the nearest pivot of each vector."""
        return (vecs @ self.unit.T).argmax(axis=1)

    def upper(self, vecs: np.ndarray) -> np.ndarray:
        """Bound on the dot product of each vector with any row of each cell."""
        norms = np.linalg.norm(vecs, axis=1)
        angles = np.arccos(np.clip(vecs @ self.unit.T / np.where(norms > 0, norms, 1.0)[:, None], -1.0, 1.0))
        gap = angles[:, self.number // 2] - self.radius - ANGLE_SLACK
        cosine = np.cos(np.clip(gap, 0.0, math.pi))
        by_angle = norms[:, None] * cosine * np.where(cosine >= 0, self.norm_high, self.norm_low)
        by_bucket = np.maximum(vecs, 0.0) @ self.high.T + np.minimum(vecs, 0.0) @ self.low.T
        return np.minimum(by_angle, by_bucket) + BOUND_SLACK


@dataclass
class Index:
    """Vectors by cell: ``rows`` are (id, vec, cell).  Cell 2p holds rows of pivot p, 2p + 1 its core."""

    bounds: Bounds
    rows: DataFrame
    count: int
    pivot_ids: list[int]

    @property
    def dims(self) -> int:
        return self.bounds.pivots.shape[1]


def _pivots(vectors: DataFrame, rows: int) -> tuple[list[int], np.ndarray]:
    """A bounded, repeatable sample of the vectors."""
    wanted = max(1, min(MAX_PIVOTS, rows // ROWS_PER_PIVOT))
    picked = vectors.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    return [r["id"] for r in picked], np.array([r["vec"] for r in picked], dtype="f8")


def _assign(vectors: DataFrame, pivots: np.ndarray, threshold: float | None) -> DataFrame:
    """(id, vec, cell, similarity to the pivot): rows that reach the threshold there form the core."""
    lengths = np.linalg.norm(pivots, axis=1)
    unit = pivots / np.where(lengths > 0, lengths, 1.0)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs = _matrix(batch.column(1), batch.num_rows).astype("f8")
            products = vecs @ unit.T
            near = products.argmax(axis=1)
            raw = products[np.arange(len(near)), near] * lengths[near]
            core = np.zeros(len(near), bool) if threshold is None else np.round(raw, SIMILARITY_DIGITS) >= threshold
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array((2 * near + core).astype("i4")), pa.array(raw)], names=["id", "vec", "cell", "to_pivot"]
            )

    return vectors.mapInArrow(run, "id long, vec array<float>, cell int, to_pivot double")


def _cells(assigned: DataFrame, pivots: np.ndarray) -> pd.DataFrame:
    """One row for each cell that holds rows."""
    lengths = np.linalg.norm(pivots, axis=1)
    unit = pivots / np.where(lengths > 0, lengths, 1.0)[:, None]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs, cell = _matrix(batch.column(0), batch.num_rows), batch.column(1).to_numpy()
            for c in np.unique(cell).tolist():
                own = vecs[cell == c]
                norms = np.linalg.norm(own.astype("f8"), axis=1)
                cosine = np.clip(own.astype("f8") @ unit[c // 2] / np.where(norms > 0, norms, 1.0), -1.0, 1.0)
                new = [len(own), float(np.arccos(cosine).max()), float(norms.min()), float(norms.max()), own.min(axis=0), own.max(axis=0)]
                found[c] = _merged(found[c], new) if c in found else new
        if found:
            yield _cell_batch(found)

    return merged_cells(assigned.select("vec", "cell").mapInArrow(part, CELL))


def merged_cells(parts: DataFrame) -> pd.DataFrame:
    """One row for each cell of partial bounds, by number."""

    def whole(key: tuple[pa.Scalar, ...], given: pa.Table) -> pa.Table:
        merged = None
        for row in given.to_pylist():
            new = [row["rows"], row["radius"], row["norm_low"], row["norm_high"], np.array(row["low"], "f4"), np.array(row["high"], "f4")]
            merged = new if merged is None else _merged(merged, new)
        return pa.Table.from_batches([_cell_batch({key[0].as_py(): merged})])

    return parts.groupBy("cell").applyInArrow(whole, CELL).toPandas().sort_values("cell", ignore_index=True)


def _merged(a: list, b: list) -> list:
    return [a[0] + b[0], max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), np.minimum(a[4], b[4]), np.maximum(a[5], b[5])]


def _cell_batch(found: dict[int, list]) -> pa.RecordBatch:
    columns = list(zip(*found.values()))
    arrays = [pa.array(list(found), pa.int32()), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[1:4])]
    arrays += [pa.array([v.tolist() for v in c], pa.list_(pa.float32())) for c in columns[4:6]]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in CELL.split(", ")])


def build_index(vectors: DataFrame, threshold: float | None = None) -> Index | None:
    """Index of (id, vec) rows, which are read several times; none of an empty table."""
    rows = vectors.count()
    if not rows:
        return None
    pivot_ids, pivots = _pivots(vectors, rows)
    assigned = _assign(vectors, pivots, threshold)
    return Index(Bounds(pivots, _cells(assigned, pivots)), assigned, rows, pivot_ids)


# --- visits and tiles -----------------------------------------------------------

VISIT = "id long, vec array<float>, floor double, own boolean, cell int"


def _visits(rows: DataFrame, choose: Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray], floor: float | None = None) -> DataFrame:
    """Rows once for each cell they visit.

    ``choose`` gets the columns of a batch and its vectors and returns, for each
    row, which cells it visits, as (matrix of rows by cells, cell numbers, own cells).
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the bounds of a row are many times its size, so a batch is cut into slices
        for batch in (whole.slice(at, CHUNK_ROWS) for whole in batches for at in range(0, whole.num_rows, CHUNK_ROWS)):
            vecs = _matrix(batch.column(1), batch.num_rows).astype("f8")
            columns = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names) if n != "vec"}
            wanted, cells, own = choose(columns, vecs)
            row, at = np.nonzero(wanted)
            least = np.full(len(vecs), floor) if floor is not None else columns["floor"]
            # a row with many visits would make a batch many times its size
            for start in range(0, len(row), CHUNK_ROWS):
                r, c = row[start : start + CHUNK_ROWS], cells[at[start : start + CHUNK_ROWS]]
                taken = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(least[r]), pa.array(own[r] == c), pa.array(c.astype("i4"))],
                    names=["id", "vec", "floor", "own", "cell"],
                )

    return rows.mapInArrow(run, VISIT)


def _part_rows(rows: int, dims: int, parallelism: int) -> int:
    by_size = max(1, BLOCK_BYTES // (4 * max(1, dims)))
    by_tasks = max(MIN_BLOCK_ROWS, math.ceil(rows / max(1, parallelism)))
    return min(by_size, by_tasks, MAX_PART_ROWS)


BLOCK = "tile int, visits boolean, ids binary, cells binary, floors binary, wanted binary, vecs binary, skip binary"


@dataclass
class Zones:
    """How cells are dealt to zones; a cell larger than a zone has parts in several."""

    first: np.ndarray  # by place of a cell in the bounds: its first part
    parts: np.ndarray
    zone: np.ndarray  # by part
    places: list[np.ndarray]  # by zone: places of its cells

    def of(self, place: np.ndarray, ids: np.ndarray) -> np.ndarray:
        mixed = (ids.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.zone[self.first[place] + (mixed % self.parts[place].astype("u8")).astype("i8")]


def _zones(rows: np.ndarray, wanted: int) -> Zones:
    """Cells with these numbers of rows in about as many zones of one size as wanted."""
    size = max(1, math.ceil(rows.sum() / max(1, wanted)))
    parts = np.maximum(1, np.ceil(rows / size)).astype("i8")
    first = np.cumsum(parts) - parts
    part_rows = np.repeat(rows / parts, parts)
    middle = np.cumsum(part_rows) - part_rows / 2
    zone = np.unique((middle / size).astype("i8"), return_inverse=True)[1]
    place = np.repeat(np.arange(len(rows)), parts)
    return Zones(first, parts, zone, [np.unique(place[zone == z]) for z in range(zone.max() + 1)])


def _meet(rows: DataFrame, choose, floor: float | None, index: Index, task, count: int, best: int | None = None) -> DataFrame:
    """What ``task`` finds among the visitors and rows of every cell: (a, b, similarity).

    ``rows`` are ``count`` visitors (id, vec, ...), ``choose`` says which cells they
    visit, as in ``_visits``.  Of a visitor only the ``best`` found in some cells
    are sent on.  A visitor may have ``skip``, an array of ids it is not paired with.
    """
    names = rows.columns
    cell_rows = index.bounds.cells["rows"].to_numpy()
    some = index.bounds.pivots.astype("f4")
    most = max(1, ZONE_BYTES * len(some) // len(pack(some)))
    tiles = max(1, TILES_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    sides = lambda n, least: max(1, -(-n // most), min(least, -(-n // MIN_BLOCK_ROWS)))
    zones = _zones(cell_rows, sides(index.count, math.ceil(math.sqrt(tiles))))
    splits = sides(count, -(-tiles // len(zones.places)))
    numbers, slice_rows = index.bounds.number, CHUNK_ROWS
    place_of = np.full(numbers.max() + 1, -1)
    place_of[numbers] = np.arange(len(numbers))

    def visitors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the bounds of a row are many times its size, so a batch is cut into slices
        for batch in (whole.slice(at, slice_rows) for whole in batches for at in range(0, whole.num_rows, slice_rows)):
            raw = _matrix(batch.column(1), batch.num_rows)
            columns = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names) if n not in ("vec", "skip")}
            wanted, _, own = choose(columns, raw.astype("f8"))
            least = np.full(len(raw), floor) if floor is not None else columns["floor"]
            ids = batch.column(0).to_numpy()
            skips = batch.column(names.index("skip")).to_pylist() if "skip" in names else None
            out = []
            for zone, places in enumerate(zones.places):
                r = np.flatnonzero(wanted[:, places].any(axis=1))
                if len(r):
                    skip = b""
                    if skips:
                        pairs = [(ids[i], other) for i in r.tolist() for other in skips[i] or ()]
                        skip = np.array(pairs, "<i8").tobytes()
                    marks = np.packbits(wanted[np.ix_(r, places)], axis=1)
                    split = int(ids[r[0]]) * 0x9E3779B97F4A7C15 % 2**64 // 2**33 % splits
                    out.append((zone * splits + split, True, ids[r].tobytes(), own[r].astype("i4").tobytes(), least[r].astype("f8").tobytes(), marks.tobytes(), pack(raw[r]), skip))
            if out:
                yield _block_batch(out)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            if batch.num_rows:
                raw, ids, cells = _matrix(batch.column(1), batch.num_rows), batch.column(0).to_numpy(), batch.column(2).to_numpy()
                place = place_of[cells]
                group = place * len(zones.places) + zones.of(place, ids)
                for g in np.unique(group).tolist():
                    r = np.flatnonzero(group == g)
                    cell = cells[r[:1]].astype("i4").tobytes()
                    out.append((g % len(zones.places), False, ids[r].tobytes(), cell, b"", b"", pack(raw[r]), b""))
            if out:
                yield _block_batch(out)

    left = rows.mapInArrow(visitors, BLOCK)
    right = index.rows.select("id", "vec", "cell").mapInArrow(held, BLOCK).withColumn("tile", F.explode(F.sequence(F.col("tile") * splits, F.col("tile") * splits + splits - 1)))
    part_rows, chunk_rows, products_held, sent = _part_rows(index.count, index.dims, 1), _part_rows(count, index.dims, 1), TILE_PRODUCTS, PAIRS_SENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, come, cells = 0, [], {}
        for batch in batches:
            for row in batch.to_pylist():
                tile = row["tile"]
                if row["visits"]:
                    come.append(row)
                else:
                    cells.setdefault(int(np.frombuffer(row["cells"], "<i4")[0]), []).append(row)
        places = zones.places[tile // splits]
        parts = [(int(np.flatnonzero(numbers[places] == c)[0]), c, part, {}) for c in sorted(cells) for part in _filled(cells[c], part_rows)]
        for chunk in _filled(come, chunk_rows) if parts else ():
            read = lambda name, kind: np.concatenate([np.frombuffer(row[name], kind) for row in chunk])  # noqa: E731, B023
            ids, own, least = read("ids", "<i8"), read("cells", "<i4"), read("floors", "<f8")
            marks = np.unpackbits(read("wanted", "u1").reshape(len(ids), -1), axis=1, count=len(places)).astype(bool)
            vecs, skip = np.concatenate([unpack(row["vecs"]) for row in chunk]), read("skip", "<i8").reshape(-1, 2)
            found, n = [], 0
            for mark, cell, part, state in parts:
                r = np.flatnonzero(marks[:, mark])
                if not len(r):
                    continue
                b_ids = np.concatenate([np.frombuffer(row["ids"], "<i8") for row in part])
                order = np.argsort(b_ids, kind="stable")
                b_ids, b_vecs = b_ids[order], np.concatenate([unpack(row["vecs"]) for row in part])[order]
                b_norm = _norms(b_vecs).max()
                step = max(1, min(slice_rows, products_held // len(b_ids)))
                for start in range(0, len(r), step):
                    at = r[start : start + step]
                    state["products"] = products = Products(vecs[at], b_vecs, b_norm)
                    for pairs in task(ids[at], least[at], own[at] == cell, b_ids, products.rough, state):
                        pairs = _without(pairs, skip) if len(skip) else pairs
                        if len(pairs[0]):
                            found.append(pairs)
                            n += len(pairs[0])
                    if best is None and n >= sent:
                        yield from _pair_batches(found, sent)
                        found, n = [], 0
                state.pop("products", None)
            if found:
                yield from _pair_batches([_firsts(found, best)] if best else found, sent)

    met = left.unionByName(right).repartitionById(len(zones.places) * splits, F.col("tile"))
    return met.mapInArrow(run, "a long, b long, similarity double")


def _block_batch(blocks: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*blocks), kinds)], names=[c.split()[0] for c in BLOCK.split(", ")])


def _filled(blocks: list[dict], rows: int) -> Iterator[list[dict]]:
    """Blocks together as long as they have at most so many rows."""
    part, n = [], 0
    for block in blocks:
        own = len(block["ids"]) // 8
        if part and n + own > rows:
            yield part
            part, n = [], 0
        part.append(block)
        n += own
    if part:
        yield part


def _pair_batches(found: list[tuple], rows: int) -> Iterator[pa.RecordBatch]:
    a, b, s = (np.concatenate(c) for c in zip(*found))
    for at in range(0, len(a), rows):
        take = slice(at, at + rows)
        yield pa.RecordBatch.from_arrays([pa.array(a[take], pa.int64()), pa.array(b[take], pa.int64()), pa.array(s[take], pa.float64())], names=["a", "b", "similarity"])


def _firsts(found: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each first id: compared after rounding, ties to the lowest id."""
    a, b, s = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((b, -np.round(s, SIMILARITY_DIGITS), a))
    first = np.searchsorted(a[order], a[order])
    kept = order[np.arange(len(order)) - first < k]
    return a[kept], b[kept], s[kept]


def _without(pairs: tuple, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs but those named in ``skip``."""
    mixed = lambda a, b: a.astype("u8") * np.uint64(0x9E3779B97F4A7C15) ^ b.astype("u8")
    a, b, s = pairs
    maybe = np.flatnonzero(np.isin(mixed(a, b), mixed(skip[:, 0], skip[:, 1])))
    if not len(maybe):
        return pairs
    known = set(map(tuple, skip.tolist()))
    keep = np.ones(len(a), bool)
    keep[maybe] = [(x, y) not in known for x, y in zip(a[maybe].tolist(), b[maybe].tolist())]
    return a[keep], b[keep], s[keep]


def _norms(vecs: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vecs, vecs, dtype="f8"))


class Products:
    """Products of some rows with a part of a cell.

    ``rough`` holds all of them in single precision, ``slack`` by how much a row's may
    differ from the exact ones before and after rounding; ``exact`` takes some in
    double precision.  Lengths whose products could overflow are taken so at once.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, b_norm: float):
        self.a, self.b = a, b
        norms = _norms(a)
        if norms.max() * b_norm < MOST_SINGLE:
            self.rough = a @ b.T
            self.slack = a.shape[1] * 2.0**-23 * norms * b_norm + 10.0**-SIMILARITY_DIGITS
        else:
            self.rough = np.nan_to_num(self._whole(), copy=False, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            self.slack = np.full(len(a), 10.0**-SIMILARITY_DIGITS)

    def _whole(self) -> np.ndarray:
        return self.a.astype("f8") @ self.b.astype("f8").T

    def above(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the rough products that reach their row's least."""
        bound = np.nextafter(least.astype(self.rough.dtype), self.rough.dtype.type(-np.inf))
        return np.divmod(np.flatnonzero(self.rough >= bound[:, None]), self.rough.shape[1])

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.rough.dtype == np.float64:
            return self.rough[i, j]
        if len(i) > DENSE * self.rough.size:
            return self._whole()[i, j]
        out = np.empty(len(i))
        for start in range(0, len(i), EXACT_PAIRS):
            at = slice(start, start + EXACT_PAIRS)
            out[at] = np.einsum("ij,ij->i", self.a[i[at]].astype("f8"), self.b[j[at]].astype("f8"))
        return out


def _pairs(same: bool):
    """All pairs at the floor; in the row's own cell only those with a smaller first id."""

    def task(a_ids, floor, own, b_ids, sims, state):
        products = state["products"]
        i, j = products.above(floor - products.slack)
        if same:
            once = ~own[i] | (a_ids[i] < b_ids[j])
            i, j = i[once], j[once]
        found = products.exact(i, j)
        hit = np.round(found, SIMILARITY_DIGITS) >= floor[i]
        a, b, found = a_ids[i[hit]], b_ids[j[hit]], found[hit]
        return [(np.minimum(a, b), np.maximum(a, b), found) if same else (a, b, found)]

    return task


def _forest(a_ids, floor, own, b_ids, sims, state):
    """Pairs that connect what the similar pairs of a tile connect."""
    label = state.setdefault("label", np.arange(len(b_ids)))
    products = state["products"]
    i, j = products.above(floor - products.slack)
    other = a_ids[i] != b_ids[j]
    i, j = i[other], j[other]
    # only products near the threshold need the exact ones
    sure = sims[i, j] >= (floor + products.slack)[i]
    near = np.flatnonzero(~sure)
    sure[near] = np.round(products.exact(i[near], j[near]), SIMILARITY_DIGITS) >= floor[i[near]]
    i, j = i[sure], j[sure]
    out = []
    rows, first = np.unique(i, return_index=True)
    for i, cols in zip(rows.tolist(), np.split(j, first[1:])):
        roots, first = np.unique(label[cols], return_index=True)
        linked = cols[first]
        out.append((np.minimum(a_ids[i], b_ids[linked]), np.maximum(a_ids[i], b_ids[linked]), products.exact(np.full(len(linked), i), linked)))
        if own[i]:  # the row stands on the other side, too, if it is in this part
            at = np.searchsorted(b_ids, a_ids[i])
            if at < len(b_ids) and b_ids[at] == a_ids[i]:
                roots = np.append(roots, label[at])
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots.min()
    return out


def _top(k: int):
    def task(a_ids, floor, own, b_ids, sims, state):
        products, rows, taken = state["products"], np.arange(len(sims)), []
        for _ in range(min(k, len(b_ids))):
            best = sims.argmax(axis=1)
            taken.append((best, sims[rows, best]))
            sims[rows, best] = -np.inf
        for best, value in taken[::-1]:
            sims[rows, best] = value
        # whatever may be among the k best after rounding
        i, j = products.above(np.maximum(taken[-1][1] - 2 * products.slack, floor - products.slack))
        found = products.exact(i, j)
        rank = np.round(found, SIMILARITY_DIGITS)
        order = np.lexsort((j, -rank, i))  # ids ascend with j, so ties go to the lowest
        place = np.arange(len(order)) - np.searchsorted(i[order], i[order])
        kept = order[(place < k) & (rank[order] >= floor[i[order]])]
        return [(a_ids[i[kept]], b_ids[j[kept]], found[kept])]

    return task


# --- joins ----------------------------------------------------------------------


def _vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    # stored before the filter, which would embed each text a second time
    every = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vec"))
    return durable(every).filter(F.col("vec").isNotNull())


def _empty(vectors: DataFrame) -> DataFrame:
    return vectors.sparkSession.createDataFrame([], "a long, b long, similarity double")


def _self_join(vectors: DataFrame, threshold: float, forest: bool) -> DataFrame:
    """Similar pairs of stored (id, vec) rows, or with ``forest`` enough of them to connect what they connect."""
    index = build_index(vectors, threshold if forest else None)
    if index is None:
        return _empty(vectors)
    bounds = index.bounds

    def choose(columns, vecs):
        own = columns["cell"]
        wanted = (bounds.upper(vecs) >= threshold) & (bounds.number[None, :] >= own[:, None])
        if forest:  # the core of a pivot hangs on the pivot
            wanted &= ~((bounds.number[None, :] == own[:, None]) & (own % 2 == 1)[:, None])
        return wanted, bounds.number, own

    found = _meet(index.rows.select("id", "vec", "cell"), choose, threshold, index, _forest if forest else _pairs(True), index.count)
    if not forest:
        return found
    # every core row is linked to its pivot, which is a row of the same table
    ids = vectors.sparkSession.createDataFrame([(2 * p + 1, i) for p, i in enumerate(index.pivot_ids)], "cell int, pivot long")
    stars = (
        index.rows.join(F.broadcast(ids), "cell")
        .filter("id <> pivot")
        .select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"), F.col("to_pivot").alias("similarity"))
    )
    return found.unionByName(stars)


def _digested(vectors: DataFrame) -> DataFrame:
    """(id, vec) with a digest that only equal vectors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = pa.array(digests(_matrix(batch.column(1), batch.num_rows)), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["id", "vec", "digest"])

    return vectors.select("id", "vec").mapInArrow(run, "id long, vec array<float>, digest binary")


def copies(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, vec) of the lowest id of each vector, and (id, rep, square) of the other ids, both stored.

    Of the rows only ids and digests are grouped; ``square`` is the vector's product with itself.
    """
    rows = _digested(vectors)
    own = F.aggregate(F.transform("vec", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    keyed = durable(rows.select("id", "digest", own.alias("square")))
    reps = keyed.groupBy("digest").agg(F.min("id").alias("rep"))
    others = durable(keyed.join(reps, "digest").filter("id > rep"))
    distinct = rows.join(others.select("id", "digest").distinct(), ["id", "digest"], "left_anti").select("id", "vec")
    return durable(distinct), others.drop("digest")


def _lowest_copies(vectors: DataFrame, k: int) -> DataFrame:
    """The ``k`` lowest ids of every vector: ties go to the lowest, so further copies are never among the best ``k``."""
    rows = _digested(vectors)
    lowest = first_per_group(rows.select("id", "digest").distinct(), ["digest"], [F.col("id")], k)
    return rows.join(lowest, ["id", "digest"], "left_semi").select("id", "vec")


def similar_pairs(table: DataFrame, threshold: float, id_col: str = "id", vector_col: str = "embedding", every_copy: bool = False) -> DataFrame:
    """Pairs (a < b, similarity) at or above the threshold.

    With ``every_copy`` these are all pairs of rows.  Without, pairs are formed
    between distinct vectors, each shown by its lowest id; a row with the same
    vector as an earlier one is linked to that id only, so a mass of exact copies
    adds one pair per row.
    """
    if every_copy:
        return _self_join(_vectors(table, id_col, vector_col), threshold, forest=False).filter("a < b")
    distinct, others = copies(_vectors(table, id_col, vector_col))
    linked = others.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.col("square").alias("similarity"))
    return _self_join(distinct, threshold, forest=False).unionByName(linked.filter(F.round("similarity", SIMILARITY_DIGITS) >= threshold))


def cluster_edges(table: DataFrame, threshold: float, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """Enough similar pairs to connect every duplicate cluster, never all pairs."""
    distinct, others = copies(_vectors(table, id_col, vector_col))
    linked = others.filter(F.round("square", SIMILARITY_DIGITS) >= threshold).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return _self_join(distinct, threshold, forest=True).select("a", "b").unionByName(linked)


def _reach(bounds: Bounds, threshold: float):
    def choose(columns, vecs):
        return bounds.upper(vecs) >= threshold, bounds.number, np.full(len(vecs), -1)

    return choose


def reaching(rows: DataFrame, bounds: Bounds, threshold: float) -> DataFrame:
    """(id, vec) rows once for each cell that may hold a row at the threshold."""
    return _visits(rows, _reach(bounds, threshold), threshold)


def pairs_near(rows: DataFrame, index: Index, threshold: float) -> DataFrame:
    """(a, b, similarity) of stored (id, vec[, skip]) rows and rows of an index at or above the threshold."""
    return _meet(rows, _reach(index.bounds, threshold), threshold, index, _pairs(False), rows.count())


def pairs_between(left: DataFrame, right: DataFrame, threshold: float, known: DataFrame | None = None) -> DataFrame:
    """(a from left, b from right, similarity) at or above the threshold.

    Both tables are (id, embedding).  Pairs (low, high) of ``known`` are left out
    where they are found, so that found pairs need no shuffle.
    """
    left, right = _vectors(left, "id", "embedding"), _vectors(right, "id", "embedding")
    index = build_index(right)
    return _empty(left) if index is None else pairs_near(skipping(left, known), index, threshold)


def skipping(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """Rows with the ids that each of them shares a pair (low, high) with."""
    if known is None:
        return rows
    pairs = known.filter("low <= high")
    both = pairs.select(F.col("low").alias("id"), F.col("high").alias("other")).unionByName(pairs.select(F.col("high").alias("id"), F.col("low").alias("other")))
    lists = both.groupBy(F.col("id").cast("long").alias("id")).agg(F.collect_set(F.col("other").cast("long")).alias("skip"))
    return durable(rows.join(lists, "id", "left").select("id", "vec", "skip"))


def _homes(bounds: Bounds, columns: dict[str, np.ndarray], vecs: np.ndarray) -> np.ndarray:
    """Which cells are those of each vector's nearest pivot, by its own cell where that is known."""
    home = columns["cell"] // 2 if "cell" in columns else bounds.home(vecs)
    return bounds.number[None, :] // 2 == home[:, None]


def _at_home(bounds: Bounds):
    def choose(columns, vecs):
        return _homes(bounds, columns, vecs), bounds.number, np.full(len(vecs), -1)

    return choose


def _further(bounds: Bounds):
    def choose(columns, vecs):
        wanted = ~_homes(bounds, columns, vecs) & (bounds.upper(vecs) >= columns["floor"][:, None])
        return wanted, bounds.number, np.full(len(vecs), -1)

    return choose


def home_visits(left: DataFrame, bounds: Bounds, floor: float) -> DataFrame:
    """(id, vec) rows at the cell of their nearest pivot."""
    return _visits(left, _at_home(bounds), floor)


def further_visits(left: DataFrame, bounds: Bounds) -> DataFrame:
    """(id, vec, floor) rows at the other cells that may hold a row at their floor."""
    return _visits(left, _further(bounds))


def top_matches(left: DataFrame, right: DataFrame, k: int, min_similarity: float = -1.0) -> DataFrame:
    """The ``k`` most similar right rows per left row: (a, b, similarity, rank).

    Order: similarity (compared at six decimals), then lowest right id.  Each
    row meets its home cell first; another cell is visited only if its bound
    reaches the k-th best similarity found there.  Of equal right vectors only
    the ``k`` lowest ids are compared.
    """
    left, right = _vectors(left, "id", "embedding"), durable(_lowest_copies(_vectors(right, "id", "embedding"), k))
    order = [F.round("similarity", SIMILARITY_DIGITS).desc(), F.col("b").asc()]
    index = build_index(right)
    if index is None:
        return first_per_group(_empty(left), ["a"], order, k, "rank")
    # the nearest pivot is found once, so both rounds agree on a row's home
    placed, count = durable(_assign(left, index.bounds.pivots, None).select("id", "vec", "cell")), left.count()
    near = durable(first_per_group(_meet(placed, _at_home(index.bounds), min_similarity, index, _top(k), count, k), ["a"], order, k))
    kth = near.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min(F.round("similarity", SIMILARITY_DIGITS)).alias("least"))
    floor = F.when(F.col("n") >= k, F.greatest("least", F.lit(float(min_similarity)))).otherwise(float(min_similarity))
    rest = durable(placed.join(kth, placed["id"] == kth["a"], "left").select("id", "vec", "cell", floor.alias("floor")))
    release(placed, left)
    far = _meet(rest, _further(index.bounds), None, index, _top(k), count, k)
    return first_per_group(near.unionByName(far.select(*near.columns)), ["a"], order, k, "rank")
