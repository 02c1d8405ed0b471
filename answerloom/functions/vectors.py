"""Vectors: embedding, codec, dot product, normalisation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# types as objects: workers import this module without a Spark context
VECTOR = T.ArrayType(T.FloatType())
HASHED_DIMENSIONS = 256
MODEL_BATCH = 32
EMBED_BATCH = 256
_TOKEN_CACHE_LIMIT = 500_000


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; cosine for unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(dot(vector, vector))
    return F.transform(
        vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)).cast("float")
    )


@F.pandas_udf(T.BinaryType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    """Vector to little-endian float32 bytes."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(VECTOR)
def decode_vector(payload: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to vector."""
    return payload.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


def _token_bucket(token: str) -> int:
    return hashlib.md5(token.encode("utf-8")).digest()[0]


@F.pandas_udf(VECTOR)
def hashed_embedding(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Default embedding: unit-length counts of hashed lower-case word tokens.

    The bucket of a token is the first byte of its MD5 digest.  Text without a
    token gives the zero vector, null text gives null.
    """
    words = re.compile(r"\w+")
    buckets: dict[str, int] = {}

    def embed_some(texts: list[str]) -> np.ndarray:
        tokens = [words.findall(t.lower()) for t in texts]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        if len(buckets) >= _TOKEN_CACHE_LIMIT:
            buckets.clear()
        new = set(chain.from_iterable(tokens)).difference(buckets)
        buckets.update((token, _token_bucket(token)) for token in new)
        found = np.fromiter(map(buckets.__getitem__, chain.from_iterable(tokens)), np.int64, sizes.sum())
        cells = np.repeat(np.arange(len(texts)) * HASHED_DIMENSIONS, sizes) + found
        counts = np.bincount(cells, minlength=len(texts) * HASHED_DIMENSIONS).reshape(len(texts), -1).astype("f8")
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return (counts / np.where(norms > 0, norms, 1.0)).astype("f4")

    for texts in batches:
        rows: list = [None] * len(texts)
        kept = [i for i, t in enumerate(texts) if t is not None]
        for start in range(0, len(kept), EMBED_BATCH):
            part = kept[start : start + EMBED_BATCH]
            for i, vector in zip(part, embed_some([texts.iloc[i] for i in part])):
                rows[i] = vector
        yield pd.Series(rows)


def model_embedding(load_model: Callable[[], Callable[[list[str]], np.ndarray]]):
    """Embedding by any model: ``load_model`` runs once per worker and returns
    a function from a list of texts to a matrix of unit rows."""

    @F.pandas_udf(VECTOR)
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load_model()
        for texts in batches:
            rows: list = [None] * len(texts)
            kept = [i for i, t in enumerate(texts) if t is not None]
            for start in range(0, len(kept), MODEL_BATCH):
                part = kept[start:start + MODEL_BATCH]
                for i, vector in zip(part, np.asarray(encode([texts.iloc[i] for i in part]), dtype="f4")):
                    rows[i] = vector
            yield pd.Series(rows)

    return embed
