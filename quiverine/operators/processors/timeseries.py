"""Series of numbers: statistics, frequencies, trend and windows.

The single features are column expressions over arrays; ``process`` takes raw payloads.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quiverine.functions import vectors as V

from .tabular import fitted, unit

#: Settings of the features (fixed values).
DIMENSION, MOST_VALUES, WINDOW, STRIDE, LONGEST, SHORTEST = 128, 1000, 50, 10, 256, 16
FREQUENCIES = (1, 2, 3, 4, 5, 6, 8, 12, 16, 24, 32, 48, 64)


def mean(s: Column) -> Column:
    return V.total(s) / F.nullif(F.size(s), F.lit(0))


def deviation(s: Column) -> Column:
    squares = V.let(mean(s), lambda m: V.total(F.transform(s, lambda x: (x - m) * (x - m))))
    return F.sqrt(squares / F.nullif(F.size(s), F.lit(0)) + 1e-12)


def z_normalized(s: Column) -> Column:
    return V.let(F.struct(mean(s).alias("m"), deviation(s).alias("d")), lambda of: F.transform(s, lambda x: (x - of["m"]) / of["d"]))


def stats(s: Column) -> Column:
    return F.struct(mean(s).alias("mean"), deviation(s).alias("std"), F.array_min(s).alias("min"), F.array_max(s).alias("max"))


def trend(s: Column) -> Column:
    """The slope of the least-squares line over the index; null under two values."""
    n = F.size(s).cast("double")
    x = n * (n - 1) / 2
    xx = (n - 1) * n * (2 * n - 1) / 6
    y = V.total(s)
    xy = V.total(F.transform(s, lambda v, i: v * i))
    return F.when(F.size(s) >= 2, (n * xy - x * y) / F.nullif(n * xx - x * x, F.lit(0.0)))


def window_means(s: Column, window: int = WINDOW, stride: int = STRIDE) -> Column:
    """The means of windows of so many values, every so many values; not normalised."""
    last = F.floor((F.size(s) - window) / stride).cast("int")
    starts = F.when(F.size(s) >= window, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: V.total(F.slice(s, i * stride + 1, F.lit(window))) / window)


def frequencies(s: Column) -> Column:
    """Magnitudes of the transform of the first values at fixed frequencies, not normalised."""
    n = F.least(F.size(s), F.lit(LONGEST))

    def magnitudes(head: Column) -> Column:
        def magnitude(k: Column) -> Column:
            angle = lambda i: 2 * math.pi * k * i / n
            re_ = V.total(F.transform(head, lambda v, i: v * F.cos(angle(i))))
            im = V.total(F.transform(head, lambda v, i: v * F.sin(angle(i))))
            return F.hypot(re_, im)

        wanted = F.array(*[F.lit(k) for k in FREQUENCIES])
        return F.transform(F.filter(wanted, lambda k: (k < n) & (n >= SHORTEST)), magnitude)

    return V.let(F.slice(s, F.lit(1), F.greatest(n, F.lit(0))), magnitudes)


_NUMBER = re.compile(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def parse(raw: bytes) -> np.ndarray:
    """Numbers parted by commas where there are digits and commas or line ends; else little-endian floats."""
    if any(48 <= b < 58 for b in raw) and (b"," in raw or b"\n" in raw):
        found = [float(m[0]) for t in raw.decode("latin-1").split(",") if (m := _NUMBER.match(t))]
        if found:
            return np.array(found[:MOST_VALUES])
    return np.frombuffer(raw[: len(raw) // 4 * 4], "<f4").astype(float)[:MOST_VALUES]


def encode(raw: bytes, dim: int = DIMENSION) -> np.ndarray:
    s = parse(raw)
    if not len(s):
        return np.zeros(dim)
    s = (s - s.mean()) / np.sqrt(s.var() + 1e-12)
    parts = [np.array([s.mean(), np.sqrt(s.var() + 1e-12), s.min(), s.max()])]
    n = min(len(s), LONGEST)
    if n >= SHORTEST:
        spectrum = np.abs(np.exp(-2j * np.pi * np.outer([k for k in FREQUENCIES if k < n], np.arange(n)) / n) @ s[:n])
        parts.append(unit(spectrum))
    if len(s) >= 2:
        parts.append(np.array([np.polyfit(np.arange(len(s)), s, 1)[0]]))
    parts.append(unit(np.array([s[i : i + WINDOW].mean() for i in range(0, len(s) - WINDOW + 1, STRIDE)])))
    return unit(fitted(np.concatenate(parts), dim))


def process(raw: Column) -> Column:
    @F.pandas_udf("array<double>")
    def embed(part: pd.Series) -> pd.Series:
        return part.map(lambda b: encode(bytes(b)) if b else None)

    return embed(raw)
