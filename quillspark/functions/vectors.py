"""Vector arithmetic as Column expressions, and hyperplanes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Null for a zero vector, unless ``epsilon`` is added to the denominator."""
    return F.try_divide(dot(a, b), norm(a) * norm(b) + F.lit(float(epsilon)))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def hyperplanes(bits: int, dims: int, seed: int = 42) -> np.ndarray:
    """Normal random planes to six decimals; fewer bits give the first rows of more."""
    return np.round(np.random.default_rng(seed).standard_normal((bits, dims)), 6)


def band_keys(signature: Column, bits: int, bands: int) -> Column:
    """The bits of each band joined by commas; bands have equal numbers of bits."""
    if bits % bands:
        raise ValueError(f"{bits} bits can't be cut into {bands} equal bands")
    r = bits // bands
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.array_join(F.slice(signature, i * r + 1, r), ","))
