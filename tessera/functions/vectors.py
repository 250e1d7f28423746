"""Dense vectors as array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: (x.cast("double") / length).cast("float"))).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """Similarity of vectors that are already normalised."""
    return dot(a, b)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_floats(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Little-endian float32 bytes as an array; null where the length is no multiple of 4."""
    for s in blobs:
        yield s.map(lambda b: np.frombuffer(b, "<f4").tolist() if b is not None and len(b) % 4 == 0 else None)
