"""Benchmark decontamination by spaced seeds (operator 5).

Fixed masks pick some of the tokens of a short window and ignore the others, so
a hash of the picked tokens survives substitutions at ignored places.  Hashes of
documents are joined with hashes of benchmark items; each hit names a diagonal
(document place minus item place).  The aligned tokens along the diagonal are
then compared one by one: an overlap counts if some window of ``WINDOW`` aligned
tokens agrees in at least ``AGREE`` of them.

Items take part in blocks of at most ``BLOCK_TOKENS`` tokens each, so what is
broadcast has a fixed bound whatever the benchmark's size.  Tokens are lower-case
runs of letters, marks and digits.  Null texts have no tokens and match nothing.

The masks leave out no overlap that the comparison accepts: those of ``MASKS``
for items of ``LONG`` tokens and more, and for each shorter length ``short_masks``
that span the whole item.  An item too short for a substitution must stand in the
document word for word, and that hit needs no comparison.  Repeated rows of one id are one document or item with
several texts; a pair is reported once.  Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from answerloom.llm.common import stored

#: Picked places of each mask for items of at least LONG tokens.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
LONG = 10
WINDOW = 13
AGREE = 11
BLOCK_TOKENS = 200_000


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def needed(width: int) -> int:
    """Tokens that must agree in a window of ``width``."""
    return -(-width * AGREE // WINDOW)


def short_masks(length: int) -> list[tuple[int, ...]]:
    """Masks for items of ``length`` tokens, fewer than LONG: whole, or without each third in turn where one token may differ.

    Each begins at its first picked place, so it also meets a document that begins inside the item.
    """
    if needed(length) == length:
        return [tuple(range(length))]
    picked = [[k for k in range(length) if k * 3 // length != third] for third in range(3)]
    return list(dict.fromkeys(tuple(k - own[0] for k in own) for own in picked))


def seeds(rows: DataFrame, keep: list[str], masks: list[tuple[int, ...]], kind: int) -> DataFrame:
    """(keep..., place, seed) for each mask at each place of the array ``tokens``; ``kind`` keeps the seeds of other sets apart."""

    def of(n: int, mask: tuple[int, ...]) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("tokens") - mask[-1] - 1, F.lit(0))), lambda i: i + mask[-1] < F.size("tokens"))
        picked = lambda i: [F.get(F.col("tokens"), i + o) for o in mask]
        return F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(F.lit(kind), F.lit(n), *picked(i)).alias("seed")))

    at = [of(n, mask) for n, mask in enumerate(masks)]
    return rows.select(*keep, F.explode(F.concat(*at)).alias("_at")).select(*keep, "_at.place", "_at.seed")


def _blocks(items: DataFrame) -> list[DataFrame]:
    """Items in blocks whose token counts are bounded, one longer item apart."""
    total = items.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).head()[0]
    count = -(-total // BLOCK_TOKENS)
    if count <= 1:
        return [items]
    return [items.filter(F.pmod(F.xxhash64("item"), F.lit(2 * count)) == b) for b in range(2 * count)]


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_agree, best_window) of verified overlaps, one row per pair."""
    items = stored(benchmark.select(F.col(item_id).alias("item"), tokens(F.col(text)).alias("tokens")).filter(F.size("tokens") > 0))
    read = docs.select(F.col(doc_id).alias("doc"), tokens(F.col(text)).alias("tokens"))
    short = sorted(r["n"] for r in items.select(F.size("tokens").alias("n")).filter(F.col("n") < LONG).distinct().collect())
    sets = [(0, list(MASKS), items.filter(F.size("tokens") >= LONG)), *((n, short_masks(n), items.filter(F.size("tokens") == n)) for n in short)]
    compared, copied = [], []
    for kind, masks, own in sets:
        for block in _blocks(own):
            hashes = seeds(block, ["item"], masks, kind).withColumnRenamed("place", "item_place")
            hit = seeds(read, ["doc"], masks, kind).join(F.broadcast(hashes), "seed")
            if kind and needed(kind) == kind:
                copied.append(hit.groupBy("doc", "item").agg(F.min("place").alias("doc_start")).withColumn("n", F.lit(kind)))
            else:
                compared.append(hit.select("doc", "item", (F.col("place") - F.col("item_place")).alias("diagonal")))
    found = reduce(DataFrame.unionByName, compared)
    hits = stored(found.distinct())
    aligned = (
        read.join(hits, "doc")
        .join(items.withColumnRenamed("tokens", "item_tokens"), "item")
        .withColumn(
            "agree",
            F.transform("item_tokens", lambda t, k: F.coalesce((F.col("diagonal") + k >= 0) & (F.get(F.col("tokens"), F.col("diagonal") + k) == t), F.lit(False)).cast("int")),
        )
        .drop("tokens", "item_tokens")
    )
    width = F.least(F.lit(WINDOW), F.size("agree"))
    need = F.ceil(width * F.lit(AGREE) / F.lit(WINDOW))
    windows = F.transform(
        F.sequence(F.lit(1), F.size("agree") - width + 1), lambda s: F.aggregate(F.slice("agree", s, width), F.lit(0), lambda a, b: a + b)
    )
    verified = aligned.withColumns({"best_window": F.array_max(windows), "_need": need}).filter("best_window >= _need")
    first = F.array_position(F.col("agree"), 1) - 1
    close = verified.select("doc", "item", (F.col("diagonal") + first).alias("doc_start"), first.alias("item_start"),
                            F.aggregate("agree", F.lit(0), lambda a, b: a + b).alias("n_agree"), "best_window")
    for exact in copied:
        close = close.unionByName(exact.select("doc", "item", "doc_start", F.lit(0).cast("long").alias("item_start"), F.col("n").alias("n_agree"), F.col("n").alias("best_window")))
    return (
        close.groupBy("doc", "item")
        .agg(F.max_by(F.struct("doc_start", "item_start", "n_agree", "best_window"), F.struct("n_agree", -F.col("doc_start"))).alias("_best"))
        .select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "_best.*")
    )


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a verified overlap."""
    hit = overlaps(docs, benchmark, doc_id, text=text).select(F.col("doc_id").alias("_hit_id")).distinct()
    return docs.join(hit, docs[doc_id] == hit["_hit_id"], "left_anti")
