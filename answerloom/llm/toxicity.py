"""Toxicity with noisy-channel deobfuscation (operator 7).

A token that may be disguised (digits or signs between letters, letters held
down, letters spaced out) is a lattice: every place offers the letters it may
stand for, a sign may be noise, a repeated letter may count once.  A Viterbi
search finds the readings that a character trigram model and the channel's costs
like best.  The trigram model counts all texts of the corpus.  In a run of single
characters a word may end before any of them, at the price of the model.

The restored words are scored: words and word beginnings whose share of toxic
documents in a bounded labelled sample is far from chance carry log odds, and a
logistic regression on a document's strongest evidence, its amount and its
length gives the probability.

Null and empty texts have no evidence and get the score of such a document.
Labels that contradict each other for one document count as toxic; null labels
teach nothing.  Without toxic and clean examples every score is 0.  Repeated
rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from answerloom.llm.common import WordTable, held, stored, sums_by_part, text_chunks

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 20_000
#: A text is toxic from this score on.
THRESHOLD = 0.7
#: Toxic documents that must hold a feature, and its least surprise (log-likelihood ratio).
SUPPORT, SURPRISE = 3, 10.0
BEAM, READINGS, MARGIN = 12, 3, 3.0
#: The same for runs of single characters, whose readings differ in where words end.
RUN_BEAM, RUN_READINGS, RUN_MARGIN = 96, 32, 8.0
PREFIXES = range(3, 8)

# Letters of the character model and what a sign may stand for.
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâäæçèéêëìíîïñòóôöùúûüÿœ"
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h", "%": "",
}
SIZE = 64
OTHER = len(ALPHABET) + 1
SUBSTITUTE, REPEAT, WILD = 1.0, 0.4, 2.0
#: Cost of a sign that means nothing: one that looks like no letter, one that does.
NOISE, LOST = 1.0, 12.0

_PLACE = {c: k + 1 for k, c in enumerate(ALPHABET)}
_EDGE = re.compile(r"^[^\w@$!|+(€£¡]+|[^\w@$+€£]+$")
_DECOR = re.compile(r"^(?:\W{3,})|(?:\W{3,})$")
_HELD = re.compile(r"(.)\1\1")


def _codes() -> np.ndarray:
    """Symbol of each code point below 65536: 0 is no letter."""
    out = np.zeros(65_536, np.uint8)
    for code in range(65_536):
        letter = chr(code)
        out[code] = _PLACE.get(letter, OTHER if letter.isalpha() else 0)
    return out


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n) of the character trigrams of all texts; at most SIZE ** 3 rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = _codes(), np.zeros(SIZE**3, np.int64)
        for _, texts in text_chunks(batches):
            points = np.frombuffer((" " + "  ".join(texts).lower() + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
            symbols = codes[np.minimum(points, 65_535)].astype(np.int32)
            total += np.bincount((symbols[:-2] * SIZE + symbols[1:-1]) * SIZE + symbols[2:], minlength=SIZE**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["code", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class Deobfuscator:
    """Restores disguised words under a character model."""

    cost: np.ndarray  # minus log probability of a symbol after two others

    @staticmethod
    def learn(docs: DataFrame, text: str = "text") -> "Deobfuscator":
        counts = np.zeros((SIZE, SIZE, SIZE))
        for row in trigram_counts(docs, text).collect():
            counts[row["code"] // SIZE**2, row["code"] // SIZE % SIZE, row["code"] % SIZE] = row["n"]
        single = counts.sum(axis=(0, 1)) + 0.1
        pair = counts.sum(axis=0) + 5 * single / single.sum()
        pair /= pair.sum(axis=1, keepdims=True)
        triple = counts + 2 * pair[None]
        return Deobfuscator((-np.log(triple / triple.sum(axis=2, keepdims=True))).astype(np.float32))

    def readings(self, token: str, run: bool = False) -> list[str]:
        """The likeliest readings of a token, best first; the beam keeps the best states of each place.

        In a run of single characters a reading may hold blanks between words.
        """
        wide, most, margin = (RUN_BEAM, RUN_READINGS, RUN_MARGIN) if run else (BEAM, READINGS, MARGIN)
        beam: list[tuple[float, int, int, str]] = [(0.0, 0, 0, "")]
        for at, sign in enumerate(token):
            offers: dict[tuple[int, int, str], float] = {}

            def offer(paid: float, state: tuple[int, int, str]) -> None:
                if paid < offers.get(state, np.inf):
                    offers[state] = paid

            letter = sign.isalpha()
            if run:
                beam = beam + [(paid + float(self.cost[a, b, 0]), b, 0, text + " ") for paid, a, b, text in beam if text and text[-1] != " "]
            for paid, a, b, text in beam:
                for stands in sign if letter else SIGNS.get(sign, ""):
                    own = _PLACE.get(stands, OTHER)
                    extra = 0.0 if letter else WILD if sign == "*" else SUBSTITUTE
                    offer(paid + extra + float(self.cost[a, b, own]), (b, own, text + stands))
                if not letter:
                    offer(paid + (LOST if SIGNS.get(sign) and sign != "*" else NOISE), (a, b, text))
                elif text.endswith(sign) and at and token[at - 1] == sign:
                    offer(paid + REPEAT, (a, b, text))
            ranked = sorted(offers.items(), key=lambda x: (x[1], x[0][2]))[:wide]
            beam = [(paid, *state) for state, paid in ranked] or beam
        ends = sorted((paid + float(self.cost[a, b, 0]), text) for paid, a, b, text in beam if text)
        best = list(dict.fromkeys(text for paid, text in ends if paid <= ends[0][0] + margin))
        return best[:most]

    def restore_run(self, joined: str) -> list[list[str]]:
        """Readings of a run of single characters as words; the run as one token is the first."""
        return [self.restore(joined), *(text.split() for text in self.readings(joined, run=True))]

    def restore(self, token: str) -> list[str]:
        """Readings of a lower-case token between blanks; an ordinary word reads as itself."""
        bare = _EDGE.sub("", _DECOR.sub("", token))
        if bare.isalpha() and not _HELD.search(bare):
            return [bare]
        if not any(c.isalpha() for c in bare):
            return []
        plain = re.findall(r"[^\W\d_]+", bare)
        return list(dict.fromkeys([*(w for w in plain if len(w) > 2), *self.readings(bare)]))


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


def _words(tokens: list[str], restorer: Deobfuscator) -> list[str]:
    """Restored words of a text, letters spaced out among them."""
    out = [w for t in dict.fromkeys(tokens) for w in restorer.restore(t)]
    return out + [w for joined in spaced_out(tokens) for reading in restorer.restore_run(joined) for w in reading]


def spaced_out(tokens: list[str]) -> list[str]:
    """Runs of three or more single characters, joined."""
    runs, run = [], []
    for token in [*tokens, "  "]:
        core = token if len(token) == 1 else token.strip(".,;:-_")
        if len(core) == 1 and (core.isalnum() or core in SIGNS):
            run.append(core)
            continue
        if len(run) >= 3 and any(c.isalpha() for c in run):
            runs.append("".join(run))
        run = []
    return runs


@dataclass
class ToxicityModel:
    restorer: Deobfuscator
    weights: dict[str, float]
    fit: tuple[float, ...]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def word(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def token(self, token: str) -> float:
        return max(map(self.word, self.restorer.restore(token)), default=0.0)

    def describe(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Evidence of each token, and whether it is a single character."""
        out = np.zeros((len(tokens), 2), np.float32)
        for row, token in zip(out, tokens):
            row[0] = self.token(token)
            core = token if len(token) == 1 else token.strip(".,;:-_")
            row[1] = len(core) == 1
        return np.full(len(tokens), 2), out.ravel()

    def evidence(self, texts: list[str], memo: WordTable) -> np.ndarray:
        """Strongest evidence, logarithm of its amount and of the words, for each text."""
        split = [t.lower().split() for t in texts]
        sizes = np.array([len(w) for w in split])
        _, values = memo.gather(memo.rows([w for words in split for w in words]))
        values = values.reshape(-1, 2)
        strong = np.zeros(len(texts))
        rows = np.repeat(np.arange(len(texts)), sizes)
        found = values[:, 0] > 0
        np.maximum.at(strong, rows[found], values[found, 0])
        amount = sums_by_part(values[:, :1] * found[:, None], sizes)[:, 0]
        single = values[:, 1] > 0
        threes = single[2:] & single[1:-1] & single[:-2] & (rows[2:] == rows[:-2])
        for k in np.unique(rows[2:][threes]).tolist():
            for joined in spaced_out(split[k]):
                readings = [[self.word(w) for w in reading] for reading in self.restorer.restore_run(joined)]
                strong[k] = max(strong[k], *(max(own, default=0.0) for own in readings))
                # the words of one reading, not of all
                amount[k] += max(map(sum, readings))
        return np.stack([strong, np.log1p(amount), np.log1p(sizes)], axis=1)

    def chance(self, evidence: np.ndarray) -> np.ndarray:
        if not self.fit:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(evidence @ np.array(self.fit[1:]) + self.fit[0], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _memo(model: ToxicityModel) -> WordTable:
    return held(model.name, lambda: WordTable(model.describe, np.float32))


def learn(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on documents (doc_id, text) that ``labels`` (doc_id, toxic) names.

    ``corpus`` gives the character statistics, ``docs`` by default.
    """
    spark = docs.sparkSession
    restorer = Deobfuscator.learn(docs if corpus is None else corpus)
    drawn = (
        labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    known = stored(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").filter("text IS NOT NULL"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel(restorer, {}, ())
    sent = spark.sparkContext.broadcast(restorer)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            for label, text in zip(rows.column("toxic").to_pylist(), texts):
                own = sorted({f for w in _words(text.lower().split(), sent.value) for f in features(w)})
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([label] * len(own), pa.int32())], names=["feature", "toxic"])

    counted = (
        known.mapInArrow(held, "feature string, toxic int").groupBy("feature")
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).filter(F.col("a") >= SUPPORT)
    )
    share = toxic / (toxic + clean)
    both = F.col("a") + F.col("b")
    surprise = F.col("a") * F.log(F.col("a") / (both * share)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (both * (1 - share)))).otherwise(0.0)
    odds = F.log((F.col("a") + 0.1) / (toxic + 0.2)) - F.log((F.col("b") + 0.1) / (clean + 0.2))
    # bounded by the sample
    chosen = counted.filter((surprise > SURPRISE) & (odds > 1.5)).select("feature", odds.alias("odds")).collect()
    model = ToxicityModel(restorer, {r["feature"]: r["odds"] for r in chosen}, ())
    scored = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            x = scored.value.evidence(texts, _memo(scored.value))
            columns = [pa.array(np.ascontiguousarray(x[:, k])) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, rows.column("toxic").combine_chunks()], names=["x0", "x1", "x2", "toxic"])

    points = np.array([tuple(r) for r in known.mapInArrow(measure, "x0 double, x1 double, x2 double, toxic int").collect()])
    return ToxicityModel(restorer, model.weights, _logistic(points[:, :3], points[:, 3]), model.name)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``_toxic_score``; every column stays."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_toxic_score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches, text):
            own = sent.value
            chance = own.chance(own.evidence(texts, _memo(own)))
            for batch in rows.append_column("_toxic_score", pa.array(chance)).combine_chunks().to_batches():
                yield batch

    return docs.mapInArrow(run, schema)
