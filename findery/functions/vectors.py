"""Vector expressions, and deterministic stand-in embeddings."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def is_finite(vector: Column) -> Column:
    """Not null, with finite elements only."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def is_valid(vector: Column, dimension: int) -> Column:
    """Of the right length with finite elements only."""
    return is_finite(vector) & (F.size(vector) == dimension)


def stand_in_embedding(text: str, profile: str, dimension: int) -> np.ndarray:
    """A unit vector that depends on profile and text alone: hashed blocks read as big-endian numbers in [-1, 1)."""
    seed, numbers, block = f"{profile}\n{text}".encode(), [], 0
    while len(numbers) < dimension:
        digest = hashlib.sha256(seed + block.to_bytes(4, "big")).digest()
        numbers += (np.frombuffer(digest, ">u4") / 2**31 - 1).tolist()
        block += 1
    out = np.array(numbers[:dimension])
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def stand_in_embeddings(text: Column, profile: str, dimension: int) -> Column:
    """array<double> of a text column, in Arrow batches; null gives null."""

    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else stand_in_embedding(t, profile, dimension).tolist() for t in texts.to_pylist()], pa.list_(pa.float64()))

    return embed(text)
