"""Dense vectors in array columns, and their storage forms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity: 0 with a zero vector, null with different lengths."""
    both = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(both > 0, dot(a, b) / both).otherwise(0.0))


def l2_normalised(a: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    return F.transform(a, lambda x: F.when(norm(a) > 0, x / norm(a)).otherwise(x.cast("double")))


def argmax(a: Column) -> Column:
    """Place of the first greatest element, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Little-endian float32 bytes to an array; bytes of a broken length give null."""
    for series in blobs:
        yield series.map(lambda b: np.frombuffer(b, dtype="<f4") if b is not None and len(b) % 4 == 0 else None)


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in vectors:
        yield series.map(lambda v: np.asarray(v, dtype="<f4").tobytes() if v is not None else None)


def from_text(text: Column) -> Column:
    """Comma-separated numbers to an array; what is no number is left out."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("float")), lambda x: x.isNotNull())


def from_json_text(text: Column) -> Column:
    return F.from_json(text, "array<float>")
