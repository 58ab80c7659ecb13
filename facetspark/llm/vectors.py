"""Unit vectors in Arrow batches, and the vantage points that place them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 128
#: Vectors sampled (those of least hash of their id) to choose vantage points from.
SAMPLE = 4096
#: Leaf entries a tree may hold before it is sent on.
MOST_LEAVES = 8192


def usable(df: DataFrame, spaces: dict[str, str], row_id: str = "id", dim: int = DIM) -> DataFrame:
    """(space, id, vec) of every usable vector, vec being the float32 bytes of the unit vector.

    A vector is unusable if it is null, has another length than ``dim``, holds a null or non-finite number or is all zero.
    """
    names = list(spaces)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for i, name in enumerate(names):
                at, x = units_of(b.column(i + 1), dim)
                if len(at):
                    yield pa.record_batch([pa.array([name] * len(at)), ids.take(pa.array(at)), to_binary(x)], names=["space", "id", "vec"])

    return df.select(F.col(row_id).cast("long"), *[F.col(c).cast("array<float>") for c in spaces.values()]).mapInArrow(convert, "space string, id long, vec binary")


def units_of(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the usable entries of a list column."""
    length = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(length == dim)
    if not len(at):
        return at, np.empty((0, dim), np.float32)
    x = col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], (x[good] / norm[good, None]).astype(np.float32)


def to_binary(x: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix as a binary column."""
    x = np.ascontiguousarray(x, np.float32)
    width = x.shape[1] * 4
    offsets = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def matrix(vecs, dim: int = DIM) -> np.ndarray:
    """The rows of a binary column (a pandas series or list of bytes)."""
    return np.frombuffer(b"".join(vecs), np.float32).reshape(-1, dim)


def chord(cos):
    """Distance of unit vectors of the given cosine."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


def least_hashed(df: DataFrame, n: int, size: int, key: str, salt: int = 0) -> DataFrame:
    """About ``size`` of the ``n`` rows, those of least hash, in its order: the same ones whatever the partitions.

    Rows of a large hash are dropped where they are read, so partitions send few rows on, however many there are.
    """
    h = F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 1)
    most = min(2**63 - 1, (2 * size + 32 << 63) // max(n, 1))  # too few: a chance below e^-20
    return df.withColumn("__h", h).filter(F.col("__h") <= most).orderBy("__h", key).limit(size).drop("__h")


def sample_units(points: DataFrame, space: str, n: int, size: int = SAMPLE) -> np.ndarray:
    """At most ``size`` vectors of a space that has ``n``."""
    rows = least_hashed(points.filter(F.col("space") == space), n, size, "id").select("vec").collect()
    return matrix([bytes(r.vec) for r in rows]) if rows else np.empty((0, DIM), np.float32)
