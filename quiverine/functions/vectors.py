"""Vector functions as column expressions, computed in double precision.

Vectors are arrays of floats. A function takes columns, or for the query side a plain
list of numbers, which is then written out component by component: such expressions
stay inside generated code and need no join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quiverine.config import DistanceMetric

#: Vectors up to this length are written out; longer ones use higher-order functions.
UNROLL = 128
#: What a distance of vectors of unlike length is (fixed value: the largest float).
FLOAT_MAX = 3.4028234663852886e38

Vector = Column | Sequence[float]


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; inside of a lambda it would be for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _fold(a: Column, b: Vector, term, dim: int | None) -> Column:  # noqa: ANN001
    """The sum of a term over both vectors' components, from the left."""
    if not isinstance(b, Column):
        b = [float(x) for x in b]
        dim = len(b)
    if dim is None or dim > UNROLL:
        return total(F.zip_with(doubles(a), doubles(b) if isinstance(b, Column) else literal(b), term))
    out = F.lit(0.0)
    for i in range(dim):
        out = out + term(a[i].cast("double"), b[i].cast("double") if isinstance(b, Column) else F.lit(b[i]))
    return out


def dot(a: Column, b: Vector, dim: int | None = None) -> Column:
    return _fold(a, b, lambda x, y: x * y, dim)


def norm(v: Column, dim: int | None = None) -> Column:
    return F.sqrt(dot(v, v, dim))


def l2(a: Column, b: Vector, dim: int | None = None) -> Column:
    """The Euclidean distance."""
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y), dim))


def cosine_distance(a: Column, b: Vector, dim: int | None = None) -> Column:
    """1 less the cosine; 1 where a vector is zero."""
    other = norm(b, dim) if isinstance(b, Column) else F.lit(math.sqrt(sum(float(x) ** 2 for x in b)))
    size = norm(a, len(b) if not isinstance(b, Column) else dim) * other
    return F.when(size == 0, F.lit(1.0)).otherwise(1 - dot(a, b, dim) / F.nullif(size, F.lit(0.0)))


def distance(metric: DistanceMetric, a: Column, b: Vector, dim: int | None = None) -> Column:
    """The score of a metric; only for inner products is more better."""
    return {DistanceMetric.L2: l2, DistanceMetric.INNER_PRODUCT: dot, DistanceMetric.COSINE: cosine_distance}[metric](a, b, dim)


def cosine_similarity(a: Column, b: Column) -> Column:
    """The cosine; 0 for a zero vector and for unlike lengths."""
    size = total(F.transform(doubles(a), lambda x: x * x)) * total(F.transform(doubles(b), lambda x: x * x))
    return F.when((F.size(a) != F.size(b)) | (size == 0), F.lit(0.0)).otherwise(dot(a, b) / F.sqrt(F.nullif(size, F.lit(0.0))))


def euclidean(a: Column, b: Column) -> Column:
    """The Euclidean distance; the largest float for unlike lengths."""
    return F.when(F.size(a) != F.size(b), F.lit(FLOAT_MAX)).otherwise(l2(a, b))


def normalized(v: Column) -> Column:
    """The vector divided by its norm; a zero vector as it is."""

    def divided(d: Column) -> Column:
        return let(norm(d), lambda length: F.when(length > 0, F.transform(d, lambda x: x / F.nullif(length, F.lit(0.0)))).otherwise(d))

    return let(doubles(v), divided)


def bucket_bounds(n: int, d: int) -> list[tuple[int, int]]:
    """Where the ``d`` buckets of ``n`` components begin and end, by steps in single precision."""
    step = np.float32(n) / np.float32(d)
    ends = [int(np.float32(i) * step) for i in range(d + 1)]
    return [(a, min(b, n)) for a, b in zip(ends, ends[1:], strict=False)]


def aligned(v: Column, d: int, n: int | None = None) -> Column:
    """The vector brought to ``d`` components: filled up with zeros, or the means of ``d`` buckets.

    ``n`` is its length, if known; without it the bounds are worked out row by row.
    """
    x = doubles(v)
    if n is not None:
        if n == d:
            return x
        if n < d:
            return F.concat(x, F.array_repeat(F.lit(0.0), d - n))
        means = [F.lit(0.0) if a >= b else sum((x[i] for i in range(a + 1, b)), x[a]) / (b - a) for a, b in bucket_bounds(n, d)]
        return F.array(*means)
    step = F.size(x).cast("float") / F.lit(d).cast("float")
    begin = lambda i: (i.cast("float") * step).cast("int")

    def mean(i: Column) -> Column:
        a, b = begin(i), F.least(begin(i + 1), F.size(x))
        return F.when(b > a, total(F.slice(x, a + 1, F.greatest(b - a, F.lit(0)))) / F.nullif(b - a, F.lit(0))).otherwise(0.0)

    return (
        F.when(F.size(x) == d, x)
        .when(F.size(x) < d, F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(F.lit(d) - F.size(x), F.lit(0)))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), mean))
    )


def resized(v: Column, d: int) -> Column:
    """The vector filled up with zeros or cut off at ``d`` components."""
    return F.slice(F.concat(doubles(v), F.array_repeat(F.lit(0.0), d)), 1, d)


def average(vectors: Sequence[Column]) -> Column:
    """The mean by component, as long as the first; components that a vector lacks count as 0."""
    first = doubles(vectors[0])
    summed = first
    for v in vectors[1:]:
        summed = F.zip_with(summed, F.slice(doubles(v), 1, F.greatest(F.size(first), F.lit(1))), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    return F.transform(summed, lambda x: x / len(vectors))


def projection_matrix(n: int, d: int, seed: int = 42) -> np.ndarray:
    """Standard normal numbers; the same for a seed, though not those of any other library."""
    return np.random.default_rng(seed).standard_normal((d, n))


def projected(vectors: Sequence[Column], n: int, d: int, seed: int = 42) -> Column:
    """A random projection of some vectors' outer product, of ``n`` components in all, to ``d``."""

    @F.pandas_udf("array<double>")
    def project(*parts: pd.Series) -> pd.Series:
        if not len(parts[0]):
            return pd.Series([], dtype=object)
        product, *others = (np.stack(p.to_numpy()).astype(float) for p in parts)
        for other in others:
            product = (product[:, :, None] * other[:, None, :]).reshape(len(product), -1)
        return pd.Series(list(product @ projection_matrix(n, d, seed).T / np.sqrt(n)))

    # So marked, it is worked out once, also where a generator follows.
    return project.asNondeterministic()(*[doubles(v) for v in vectors])


def checked(v: Column, dim: int) -> Column:
    """The vector itself; rows of another length end the query with an error."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"expected dimension {dim}, got "), F.size(v).cast("string"))).cast("array<float>"))
