"""Vector expressions over array<float> columns."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.schema import EmbeddingError


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is 0; vectors of other lengths are an error."""
    size = norm(a) * norm(b)
    value = F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("embedding dimension mismatch")).cast("double"))


def distance_score(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.greatest(distance, F.lit(0.0)))


def l2_normalized(a: Column) -> Column:
    """The vector over its norm; a zero vector as it is."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of the token vectors under the mask, with length 1; zeros if nothing is masked in."""
    weight = mask.astype(np.float64)
    total = (tokens * weight[:, None]).sum(axis=0) / weight.sum() if weight.sum() else np.zeros(tokens.shape[1])
    length = np.sqrt((total**2).sum())
    return total / length if length > 0 else total


def encode_embedding(vector: list[float]) -> bytes:
    if not vector:
        raise EmbeddingError("an embedding must not be empty")
    return struct.pack(f"<{len(vector)}f", *vector)


def decode_embedding(raw: bytes) -> list[float]:
    if len(raw) % 4:
        raise EmbeddingError(f"{len(raw)} bytes are no whole number of floats")
    return list(struct.unpack(f"<{len(raw) // 4}f", raw))
