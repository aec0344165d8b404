"""Vector arithmetic on arrays, in doubles and inside the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binding import let


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Null if a vector is null or the lengths differ."""
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 when either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def l2_normalize(v: Column, strict: bool = False) -> Column:
    """The unit vector; a zero vector is null, or an error if ``strict``."""
    otherwise = F.raise_error(F.lit("a zero vector has no direction")) if strict else F.lit(None)
    unit = lambda length: F.when(length > 0, F.transform(doubles(v), lambda x: x / length)).otherwise(otherwise.cast("array<double>"))
    return let(norm(v), unit)


def int8_scale(v: Column) -> Column:
    return F.array_max(F.transform(doubles(v), F.abs))


def int8_encode(v: Column) -> Column:
    """Symmetric codes round(x / scale * 127), halves to even, of ``scale`` = the largest magnitude."""
    code = lambda x, scale: F.when(scale > 0, F.bround(x / scale * 127)).otherwise(F.lit(0.0)).cast("tinyint")
    return let(int8_scale(v), lambda scale: F.transform(doubles(v), lambda x: code(x, scale)))


def int8_decode(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda c: c.cast("double") * scale / 127)


def valid_vector(v: Column, dim: int | None = None) -> Column:
    """Whether the vector has (the right number of) finite components."""
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return finite & (F.size(v) > 0) if dim is None else finite & (F.size(v) == dim)


def _lists(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all numbers of all vectors, where each begins, how many it has); null vectors have none."""
    sizes = np.array([0 if v is None else len(v) for v in vectors], np.int64)
    there = [v for v in vectors if v is not None and len(v)]
    return np.concatenate(there) if there else np.empty(0), np.cumsum(sizes) - sizes, sizes


@F.pandas_udf(T.StringType())
def sha256_f32(vectors: pd.Series) -> pd.Series:
    """Hex SHA-256 of the little-endian float32 bytes; the batch is converted at once, only the hash is per row."""
    from hashlib import sha256

    flat, begin, size = _lists(vectors)
    raw = memoryview(np.ascontiguousarray(flat, "<f4").tobytes())
    return pd.Series([None if v is None else sha256(raw[4 * b : 4 * (b + n)]).hexdigest() for v, b, n in zip(vectors, begin, size)], dtype=object)


@F.pandas_udf(T.BinaryType())
def f16_encode(vectors: pd.Series) -> pd.Series:
    flat, begin, size = _lists(vectors)
    raw = np.ascontiguousarray(flat, "<f2").tobytes()
    return pd.Series([None if v is None else raw[2 * b : 2 * (b + n)] for v, b, n in zip(vectors, begin, size)], dtype=object)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def f16_decode(blobs: pd.Series) -> pd.Series:
    there = blobs.notna().to_numpy()
    sizes = np.array([len(b) // 2 for b in blobs[there]], np.int64)
    flat = np.frombuffer(b"".join(blobs[there]), "<f2").astype(np.float32)
    out = np.full(len(blobs), None, object)
    for i, part in zip(np.flatnonzero(there), np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []):
        out[i] = part
    return pd.Series(out)
