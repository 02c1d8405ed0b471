"""Rows of 32-bit vectors as compressed bytes, bit by bit the same when they come back.

A vector of word counts has few filled places and fewer distinct values, so a
block says which places are filled, names each row's values once and refers to
them.  A block without such rows is kept as it is.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa

_HEAD = struct.Struct("<?III")


def pack(vecs: np.ndarray) -> bytes:
    bits = np.ascontiguousarray(vecs, "<f4").view("<u4")
    rows, dims = bits.shape
    body = _by_values(bits)
    few = body is not None
    body = body if few else bits.tobytes()
    return _HEAD.pack(few, rows, dims, len(body)) + pa.compress(body, codec="zstd", asbytes=True)


def _by_values(bits: np.ndarray) -> bytes | None:
    rows = len(bits)
    filled = bits != 0
    if 2 * len(np.unique(bits[0])) > 2 + filled[0].sum():
        return None
    row = np.nonzero(filled)[0]
    found, code = np.unique(row.astype("u8") << np.uint64(32) | bits[filled], return_inverse=True)
    values = np.bincount((found >> np.uint64(32)).astype("i8"), minlength=rows)
    if 2 * len(found) > len(row) or values.max() > 256:
        return None
    first = np.cumsum(values) - values
    parts = [np.packbits(filled, axis=1), values.astype("<u2"), found.astype("<u4"), (code - first[row]).astype("u1")]
    return b"".join(p.tobytes() for p in parts)


def unpack(block: bytes) -> np.ndarray:
    few, rows, dims, length = _HEAD.unpack_from(block)
    body = pa.decompress(memoryview(block)[_HEAD.size :], decompressed_size=length, codec="zstd", asbytes=True)
    if not few:
        return np.frombuffer(body, "<f4").reshape(rows, dims)
    wide = -(-dims // 8)
    filled = np.unpackbits(np.frombuffer(body, "u1", rows * wide).reshape(rows, wide), axis=1, count=dims).astype(bool)
    values = np.frombuffer(body, "<u2", rows, rows * wide).astype("i8")
    at = rows * (wide + 2)
    found = np.frombuffer(body, "<u4", values.sum(), at)
    code = np.frombuffer(body, "u1", -1, at + 4 * len(found))
    bits = np.zeros((rows, dims), "<u4")
    bits[filled] = found[np.repeat(np.cumsum(values) - values, filled.sum(axis=1)) + code]
    return bits.view("<f4")


def digests(vecs: np.ndarray) -> list[bytes]:
    """One value for equal vectors: there is one zero and one NaN."""
    plain = vecs + np.float32(0)
    plain[np.isnan(plain)] = np.nan
    return [hashlib.blake2b(row, digest_size=16).digest() for row in np.ascontiguousarray(plain, "<f4")]
