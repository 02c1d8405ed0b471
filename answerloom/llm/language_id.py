"""Language identification by words first, then shorter and shorter n-grams (operator 8).

Of each language a bounded sample of documents is counted: its most frequent
words and its most frequent character n-grams of one to five characters inside
words.  A known word scores its log frequency in each language.  An unseen word
scores the mean log frequency of its longest n-grams that are known, trying five
characters first.  The language with the greatest sum over the text's words
wins, the alphabetically first among equals.

A text that is null or has no letter, and any text when no language was learned,
is ``und`` with score 0.  Rows without a language, or without text, teach
nothing.  Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from answerloom.llm.common import WordTable, held, stored, sums_by_part, text_chunks
from answerloom.operators.ranking import first_per_group

#: Documents counted of each language, about.
SAMPLE = 2_000
#: Words kept of each language, and n-grams of each length.
WORDS, GRAMS = 20_000, 10_000
LONGEST = 5
#: A language is so much likelier for each unit of summed evidence.
TEMPER = 0.5
UNKNOWN = "und"

#: The same letters as in what is counted: figures and signs that only look like letters are none.
_LETTERS = regex.compile(r"\p{L}+")


@dataclass
class LanguageModel:
    """Rows of log frequencies, one column for each language, by word and by n-gram."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def pieces(self, word: str) -> list[int]:
        """Rows that speak for a word: its own, else those of its longest known n-grams."""
        own = self.words.get(word)
        if own is not None:
            return [own]
        marked, known = f"^{word}$", self.grams.get
        for n in range(min(LONGEST, len(marked)), 0, -1):
            found = [g for i in range(len(marked) - n + 1) if (g := known(marked[i : i + n])) is not None]
            if found:
                return found
        return []

    def describe(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Evidence and number of words of each token between blanks.

        A word's evidence is the mean of its rows, less that of its best language;
        all words of a batch are looked up and summed at once.
        """
        words = [_LETTERS.findall(token) for token in tokens]
        rows = [self.pieces(word) for own in words for word in own]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        means = sums_by_part(self.table[np.fromiter(chain.from_iterable(rows), np.int64, sizes.sum())], sizes) / np.maximum(sizes, 1)[:, None]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros((len(tokens), len(self.languages) + 1), np.float32)
        if self.languages:
            out[:, :-1] = sums_by_part(means - means.max(axis=1, keepdims=True), counts)
        out[:, -1] = counts
        return np.full(len(tokens), out.shape[1]), out.ravel()


def _log_frequencies(rows: list, languages: list[str], totals: dict[str, int], kept: int) -> tuple[dict[str, int], np.ndarray]:
    """Row number of each key and the rows; a language without the key has the least frequency."""
    place = {name: k for k, name in enumerate(languages)}
    number: dict[str, int] = {}
    for _, key, _ in rows:
        number.setdefault(key, len(number))
    table = np.tile(np.array([np.log(0.5 / (totals[name] + kept)) for name in languages], np.float32), (len(number), 1))
    for lang, key, n in rows:
        table[number[key], place[lang]] = np.log((n + 0.5) / (totals[lang] + kept))
    return number, table


def learn(docs: DataFrame, sample: int = SAMPLE, words: int = WORDS, grams: int = GRAMS) -> LanguageModel:
    """Fit on (doc_id, text, lang); the sample is bounded for each language."""
    usable = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    # one row for each language
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], {}, {}, np.zeros((0, 0), np.float32))
    rate = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, sample / sizes[name]))])
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(rate, F.col("lang")) * 1_000_000)
    tokens = drawn.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("key"))
    counted = stored(tokens.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n")))
    marked = F.concat(F.lit("^"), F.col("key"), F.lit("$"))
    pieces = F.flatten(F.array(*[
        F.when(F.length(marked) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1))), lambda i, n=n: F.substring(marked, i, F.lit(n))))
        .otherwise(F.array().cast("array<string>"))
        for n in range(1, LONGEST + 1)
    ]))
    gram_counts = counted.select("lang", "n", F.explode(pieces).alias("key")).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    best = [F.desc("n"), F.asc("key")]
    # at most ``words`` and LONGEST * ``grams`` rows for each language
    top_words = first_per_group(counted, ["lang"], best, words).select("lang", "key", "n").collect()
    top_grams = first_per_group(gram_counts.withColumn("size", F.length("key")), ["lang", "size"], best, grams).select("lang", "key", "n").collect()
    languages = sorted(totals)
    own, word_rows = _log_frequencies(top_words, languages, totals, words)
    parts, gram_rows = _log_frequencies(top_grams, languages, totals, grams)
    return LanguageModel(languages, own, {key: len(own) + n for key, n in parts.items()}, np.concatenate([word_rows, gram_rows]))


PREDICTED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()),
])


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_words) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        memo, width = held(own.name, lambda: WordTable(own.describe, np.float32)), len(own.languages) + 1
        for rows, texts in text_chunks(batches):
            split = [t.lower().split() for t in texts]
            _, values = memo.gather(memo.rows([w for words in split for w in words]))
            sums = sums_by_part(values.reshape(-1, width), np.array([len(w) for w in split]))
            count = sums[:, -1]
            if width > 1:
                evidence = sums[:, :-1] - sums[:, :-1].max(axis=1, keepdims=True)
                chance = np.exp(TEMPER * evidence)
                best = chance.argmax(axis=1)
                score = (chance / chance.sum(axis=1, keepdims=True))[np.arange(len(best)), best]
                names = [own.languages[k] if n > 0 else UNKNOWN for k, n in zip(best.tolist(), count.tolist())]
            else:
                score, names = np.zeros(len(texts)), [UNKNOWN] * len(texts)
            score = np.where(count > 0, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").combine_chunks(), pa.array(names, pa.string()), pa.array(score), pa.array(count.astype(np.int64))], names=PREDICTED.names
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PREDICTED)
