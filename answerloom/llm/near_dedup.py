"""Near duplicates by BagMinHash (operator 9).

A document is the multiset of its shingles of five words (lower-case runs of
letters and digits); a shorter one has one shingle of all its words.  Every unit
of a shingle's multiplicity owns a Poisson process in time.  Multiplicities are
discretised into intervals (0, 1], (1, 2], (2, 4], (4, 8] ...: one process with
the interval's rate runs for the whole interval and each of its points names a
unit, so points of units beyond the multiplicity are left out.  Each point falls
into one of the signature's registers, which keep their earliest point; points
come in order of time, and a process ends once it is later than all registers.
Two registers agree with probability equal to the weighted Jaccard similarity.

Documents with equal word sequences are folded into the lowest id.  Signatures
are banded.  In each bucket the member with the most copies (then the lowest id)
is compared with all others, so a bucket costs as many comparisons as it has
members.  Members outside a bucket's largest component then meet the same few members of
that component.  Those still outside are compared with the whole component and
with each other, in blocks by one product of their shared shingles where there
are many.  Every comparison is the exact multiset similarity of the texts.
Components of pairs at or above ``LEAST`` are the classes.

A document without words is similar to nothing.  Rows that repeat an id are
expected to repeat its text.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from answerloom.llm.common import WordTable, held, stored, sums_by_part, text_chunks
from answerloom.operators.components import connected_components
from answerloom.operators.ranking import first_per_group

SHINGLE = 5
LEAST = 0.8
BANDS, BAND_ROWS = 42, 6
REGISTERS = BANDS * BAND_ROWS
#: Members of one centre that are compared in one run of rows.
RUN = 256
#: Members of a component that others, which share a bucket with it, meet first.
CENTRES = 8
#: Groups with more pairs than this are compared in blocks.
BLOCK_PAIRS = 128

_WORD = re.compile(r"[^\W_]+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _describe(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    words = [_WORD.findall(t) for t in tokens]
    hashes = [xxhash.xxh64_intdigest(w) for row in words for w in row]
    return np.fromiter(map(len, words), np.int64, len(words)), np.array(hashes, np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text and the hashes of all words."""
    memo = held("near_dedup", lambda: WordTable(_describe, np.uint64))
    split = [t.lower().split() for t in texts]
    per_token, hashes = memo.gather(memo.rows([w for words in split for w in words]))
    counts = sums_by_part(per_token, np.array([len(w) for w in split], np.int64)).astype(np.int64)
    return counts, hashes


def bags(counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, multiplicity) of every distinct shingle, ordered by text."""
    first = np.cumsum(counts) - counts
    texts, values = [], []
    long = counts >= SHINGLE
    if long.any():
        rolled = hashes[: len(hashes) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            rolled = rolled * _GOLDEN + hashes[k : len(hashes) - SHINGLE + 1 + k]
        size = counts[long] - SHINGLE + 1
        at = np.repeat(first[long] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        texts.append(np.repeat(np.flatnonzero(long), size))
        values.append(_mix(rolled[at]))
    for t in np.flatnonzero((counts > 0) & ~long).tolist():
        own = hashes[first[t] : first[t] + counts[t]]
        texts.append(np.array([t]))
        values.append(np.array([xxhash.xxh64_intdigest(own.tobytes())], np.uint64))
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text, value = np.concatenate(texts), np.concatenate(values)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])])
    starts = np.flatnonzero(new)
    return text[starts], value[starts], np.diff(np.append(starts, len(text)))


def signatures(n: int, text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Earliest point of every register for each of ``n`` texts (infinite without shingles)."""
    out = np.full((n, registers), np.inf)
    level = np.zeros(len(text), np.int64)
    parts = [(text, shingle, weight, level)]
    high = 1
    k = 1
    while (more := weight > high).any():
        parts.append((text[more], shingle[more], weight[more], level[more] + k))
        high *= 2
        k += 1
    text, shingle, weight, level = (np.concatenate(p) for p in zip(*parts))
    units = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    below = np.where(level > 0, units, 0.0)
    seed = _mix(shingle + _STEP * level.astype(np.uint64))
    time = np.zeros(len(text))
    flat = out.reshape(-1)
    while len(text):
        seed = seed + _GOLDEN
        drawn = _mix(seed)
        time = time - np.log1p(-((drawn >> np.uint64(11)) * 2.0**-53)) / units
        early = time < out.max(axis=1)[text]
        text, weight, units, below, seed, time, drawn = (x[early] for x in (text, weight, units, below, seed, time, drawn))
        drawn = _mix(drawn ^ _STEP)
        register = (drawn % np.uint64(registers)).astype(np.int64)
        unit = below + 1 + np.floor((_mix(drawn + _GOLDEN) >> np.uint64(11)) * 2.0**-53 * units)
        held = unit <= weight
        np.minimum.at(flat, text[held] * registers + register[held], time[held])
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One hash for each band, different from band to band."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, BAND_ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signature), BANDS)).copy()
    for r in range(BAND_ROWS):
        out = _mix(out * _GOLDEN + bits[:, :, r])
    return out.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """(id, digest of the words, bands) of (id, text); null digest and bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            counts, hashes = word_hashes(texts)
            bands = band_hashes(signatures(len(texts), *bags(counts, hashes)))
            ends = np.cumsum(counts)
            raw = memoryview(hashes.tobytes())
            digests = [hashlib.blake2b(raw[8 * (e - c) : 8 * e], digest_size=16).digest() if c else None for e, c in zip(ends.tolist(), counts.tolist())]
            lists = pa.array([b if c else None for b, c in zip(bands, counts.tolist())], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("id").combine_chunks(), pa.array(digests, pa.binary()), lists], names=["id", "digest", "bands"])

    return docs.mapInArrow(run, "id long, digest binary, bands array<long>")


def similarities(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs (a, b): exact weighted Jaccard of the texts' bags.

    The members of a busy centre ``a`` are cut into runs of bounded size, each
    with its own copy of the centre's text.
    """
    busy = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > RUN)
    runs = F.coalesce(F.ceil(F.col("n") / RUN), F.lit(1))
    salted = stored(pairs.join(busy, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), runs).alias("run")))
    members = salted.join(texts.withColumnRenamed("id", "b"), "b").select("a", "run", "b", "text")
    centres = salted.select("a", "run").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "run", F.lit(None).cast("long").alias("b"), "text")
    rows = members.unionByName(centres).repartition("a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre: tuple | None = None  # of the run that goes on: its text's shingles, multiplicities
        for chunk, words in text_chunks(batches):
            a, b = chunk.column("a").to_numpy(), chunk.column("b")
            is_centre = np.asarray(b.is_null())
            owner = np.cumsum(is_centre)  # 0 belongs to the run of the chunk before
            text, shingle, weight = bags(*word_hashes(words))
            total = np.bincount(text, weight, len(words))
            keys = _mix(shingle + _GOLDEN * owner[text].astype(np.uint64))
            base = is_centre[text]
            base_keys, base_weight, base_total = keys[base], weight[base], np.zeros(owner[-1] + 1)
            base_total[owner[is_centre]] = total[is_centre]
            if centre is not None:
                base_keys, base_weight = np.concatenate([base_keys, _mix(centre[0])]), np.concatenate([base_weight, centre[1]])
                base_total[0] = centre[1].sum()
            order = np.argsort(base_keys)
            base_keys, base_weight = base_keys[order], base_weight[order]
            common = np.zeros(len(words))
            if len(base_keys) and (~base).any():
                at = np.minimum(np.searchsorted(base_keys, keys[~base]), len(base_keys) - 1)
                same = base_keys[at] == keys[~base]
                common = np.bincount(text[~base][same], np.minimum(weight[~base][same], base_weight[at[same]]), len(words))
            union = total + base_total[owner] - common
            member = np.flatnonzero(~is_centre)
            score = np.where(union > 0, common / np.maximum(union, 1), 0.0)[member]
            if is_centre.any():
                last = np.flatnonzero(is_centre)[-1]
                centre = shingle[text == last], weight[text == last]
            yield pa.RecordBatch.from_arrays([pa.array(a[member]), b.take(pa.array(member)).combine_chunks(), pa.array(score)], names=["a", "b", "similarity"])

    return rows.select("a", "b", "text").mapInArrow(compare, "a long, b long, similarity double")


def block_links(left: DataFrame, right: DataFrame, amount: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of similar pairs of a left and a right member (group, id) of one group.

    ``amount`` has the groups to compare with their numbers n and m of members.
    Both sides are cut into blocks of about RUN members.  Of a block's similar
    pairs those of a spanning forest are given.
    """
    blocks = lambda n: F.ceil(F.col(n) / RUN).cast("long")
    sized = stored(amount.select("group", blocks("n").alias("n"), blocks("m").alias("m")))

    def side(members: DataFrame, number: int, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.col(own))
        facing = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        placed = members.join(sized, "group").select("group", "id", block.alias("own"), facing.alias("facing"))
        i, j = ("own", "facing") if number == 0 else ("facing", "own")
        return placed.select("group", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(number).alias("side"), "id")

    def links(block: pa.Table) -> pa.Table:
        side, ids = block.column("side").to_numpy(), block.column("id").to_numpy()
        text, shingle, weight = bags(*word_hashes(block.column("text").to_pylist()))
        total = np.bincount(text, weight, len(ids))
        # one column for each unit of a shingle that both sides have
        unit = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
        text, column = np.repeat(text, weight), np.repeat(shingle, weight) + _GOLDEN * unit.astype(np.uint64)
        shared = np.intersect1d(column[side[text] == 0], column[side[text] == 1])
        at = np.searchsorted(shared, column)
        use = at < len(shared)
        use[use] = shared[at[use]] == column[use]
        text, at = text[use], at[use]
        where = [np.flatnonzero(side == s) for s in (0, 1)]
        row = np.where(side == 0, np.cumsum(side == 0), np.cumsum(side == 1)) - 1
        common = np.zeros((len(where[0]), len(where[1])), np.float32)
        for low in range(0, len(shared), 4096):
            now = (at >= low) & (at < low + 4096)
            parts = []
            for s in (0, 1):
                own = now & (side[text] == s)
                part = np.zeros((len(where[s]), 4096), np.float32)
                part[row[text[own]], at[own] - low] = 1
                parts.append(part)
            common += parts[0] @ parts[1].T
        score = common / np.maximum(total[where[0]][:, None] + total[where[1]][None] - common, 1)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for x, y in zip(*(k.tolist() for k in np.nonzero(score >= least - 1e-6))):
            a, b = int(ids[where[0][x]]), int(ids[where[1][y]])
            if root(a) != root(b):
                parent[root(a)] = root(b)
                out.append((a, b, float(score[x, y])))
        a, b, similarity = zip(*out) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(similarity, pa.float64())})

    rows = side(left, 0, "n", "m").unionByName(side(right, 1, "m", "n")).join(texts, "id")
    return rows.groupBy("group", "i", "j").applyInArrow(links, "a long, b long, similarity double")


def _sided(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets whose members are not all of one component, with their and the bucket's largest component."""
    labelled = stored(members.join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root")))
    sizes = labelled.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    return stored(labelled.join(stored(main.select("bucket", "main")), "bucket"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, class_id, kept): the lowest id of each document's class, and whether it is the document's own."""
    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = stored(sign(given.filter("id IS NOT NULL")))
    folded = stored(signed.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")))
    keyed = folded.select(F.col("head").alias("id"), "copies", F.explode("bands").alias("bucket"))
    rank = F.struct((-F.col("copies")).alias("few"), F.col("id"))
    full = stored(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).filter("n > 1"))
    members = stored(keyed.join(full.select("bucket", "n", F.col("first.id").alias("centre")), "bucket"))
    wanted = members.select("id").distinct()
    texts = stored(given.join(wanted, "id", "left_semi").dropDuplicates(["id"]))

    def fresh(pairs: DataFrame) -> DataFrame:
        """Pairs not compared before, each in one order."""
        one = pairs.filter("a <> b").groupBy(F.least("a", "b").alias("_l"), F.greatest("a", "b").alias("_g")).agg(F.min(F.struct("a", "b")).alias("_p")).select("_p.a", "_p.b")
        known = tried.select("a", "b").unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return one.join(known, ["a", "b"], "left_anti")

    tried = stored(similarities(members.select(F.col("centre").alias("a"), F.col("id").alias("b")).filter("a <> b").distinct(), texts))
    roots = _roots(tried, least)
    sided = _sided(members, roots)
    centres = first_per_group(sided.filter("root = main").select("main", "id").distinct(), ["main"], [F.xxhash64("id"), F.col("id")], CENTRES).select("main", F.col("id").alias("a"))
    met = sided.filter("root <> main").select("main", F.col("id").alias("b")).distinct().join(stored(centres), "main").select("a", "b")
    tried = stored(tried.unionByName(similarities(fresh(met), texts)))
    roots = _roots(tried, least)
    outside = stored(_sided(members, roots).filter("root <> main"))
    # against the whole of the main component, and the others of the bucket
    whole = stored(texts.select("id").join(roots, "id", "left").select(F.coalesce("root", "id").alias("group"), "id"))
    facing = stored(outside.select(F.col("main").alias("group"), "id").distinct())
    beside = outside.select(F.col("bucket").alias("group"), "id")
    few, many = [], []
    for left, right in ((whole, facing), (beside, beside)):
        amount = left.groupBy("group").agg(F.count(F.lit(1)).alias("n")).join(right.groupBy("group").agg(F.count(F.lit(1)).alias("m")), "group")
        amount = stored(amount.filter("n * m > 1"))
        small = amount.filter(F.col("n") * F.col("m") <= BLOCK_PAIRS).select("group")
        few.append(left.join(small, "group").select("group", F.col("id").alias("a")).join(right.select("group", F.col("id").alias("b")), "group").select("a", "b"))
        many.append(block_links(left, right, amount.filter(F.col("n") * F.col("m") > BLOCK_PAIRS), texts, least))
    tried = stored(tried.unionByName(similarities(fresh(few[0].unionByName(few[1])), texts)).unionByName(many[0]).unionByName(many[1]))
    roots = _roots(tried, least)
    heads = folded.select("digest", "head").join(roots, F.col("head") == F.col("id"), "left").select("digest", F.coalesce("root", "head").alias("class_id"))
    placed = signed.select("id", "digest").join(stored(heads), "digest", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"))
    lacking = given.filter("id IS NULL").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"))
    return placed.unionByName(lacking).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def _roots(tried: DataFrame, least: float) -> DataFrame:
    """(id, root) of the components of the pairs that are similar enough."""
    return stored(connected_components(tried.filter(F.col("similarity") >= least - 1e-12).select("a", "b")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document stands for its class."""
    gone = classes(docs, doc_id, text).filter("NOT kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")
