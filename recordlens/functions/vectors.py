"""Vector expressions and the repeatable hash embedding."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, functions as F

EMBEDDING_DIMENSIONS = 1024
HASH_BYTES = 32


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def unit(v: Column) -> Column:
    """Scale to length one; a zero vector becomes the first axis."""
    size = F.sqrt(dot(v, v))
    axis = F.transform(v, lambda x, i: F.when(i == 0, 1.0).otherwise(0.0).cast("float"))
    return F.when(size == 0, axis).otherwise(
        F.transform(v, lambda x: (x / size).cast("float"))
    )


def hash_bytes(text: Column, blocks: int) -> Column:
    """SHA-256 of the text and a little-endian block number, block after block, as hex."""
    return F.concat(*[
        F.sha2(F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit(b.to_bytes(4, "little").hex()))), 256)
        for b in range(blocks)
    ])


def hash_embed(texts: list[str], dim: int = EMBEDDING_DIMENSIONS) -> np.ndarray:
    """The default embedding provider: hash bytes centred on 128, scaled to length one."""
    vectors = np.empty((len(texts), dim), dtype=np.float32)
    blocks = -(-dim // HASH_BYTES)
    for row, text in enumerate(texts):
        seed = (text or "").encode("utf-8")
        stream = b"".join(hashlib.sha256(seed + b.to_bytes(4, "little")).digest() for b in range(blocks))
        vectors[row] = (np.frombuffer(stream[:dim], dtype=np.uint8).astype(np.float32) - 128) / 128
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, size, out=vectors, where=size > 0)
    vectors[size[:, 0] == 0, 0] = 1.0
    return vectors
