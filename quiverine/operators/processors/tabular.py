"""Tables: column types, column statistics and their embedding."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bucket

#: Sizes of the encodings (fixed values).
DIMENSION, MOST_ROWS, CATEGORY_BINS, TEXT_BINS = 256, 1000, 32, 64
NUMBER = r"^[+-]?(?:[0-9]*\.[0-9]+|[0-9]+)$"
_LEADING = re.compile(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def column_type(rows: DataFrame, column: str) -> DataFrame:
    """One row (column, kind): numeric, categorical or text, from the whole column."""
    cell = F.col(column).cast("string")
    counted = rows.select(cell.alias("cell")).filter("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    numbers = F.coalesce(F.sum(F.when(F.col("cell").rlike(NUMBER), F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    few = F.count(F.lit(1)) < F.least(F.floor(total / 4) + 1, F.lit(50))
    kind = F.when(numbers >= total - numbers, "numeric").when(few, "categorical").otherwise("text")
    return counted.agg(kind.alias("kind")).select(F.lit(column).alias("column_name"), "kind")


def numeric_stats(rows: DataFrame, column: str) -> DataFrame:
    """One row: mean, population deviation, smallest and largest of what can be read as numbers."""
    x = F.expr(f"try_cast(`{column}` AS double)")
    return rows.select(x.alias("x")).agg(F.avg("x").alias("mean"), F.sqrt(F.var_pop("x") + 1e-12).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def category_histogram(rows: DataFrame, column: str, bins: int = CATEGORY_BINS) -> DataFrame:
    """(bucket, share) of the column's values."""
    counted = rows.filter(F.col(column).isNotNull()).groupBy(bucket(F.col(column).cast("string"), bins).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # At most ``bins`` rows are left here.
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("bucket", (F.col("n") / F.col("total")).alias("share"))


def token_histogram(rows: DataFrame, column: str, bins: int = TEXT_BINS) -> DataFrame:
    """(bucket, share) of the tokens of the column's texts."""
    token = rows.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"([A-Za-z0-9_]+)"))).alias("token"))
    return category_histogram(token, "token", bins)


def split_line(line: str, delimiter: str = ",") -> list[str]:
    """The fields of a line; quotes switch quoting on and off and are left out."""
    out, quoted = [""], False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif not quoted and c == delimiter:
            out.append("")
        elif quoted or c not in "\r\n":
            out[-1] += c
    return out


def parse(raw: bytes, delimiter: str = ",") -> tuple[list[str], list[list[str]]]:
    """The header and up to MOST_ROWS rows of a table."""
    lines = [split_line(x, delimiter) for x in raw.decode("utf-8", "replace").split("\n") if x]
    return (lines[0], lines[1 : MOST_ROWS + 1]) if lines else ([], [])


def _share(counts: np.ndarray) -> np.ndarray:
    return counts / counts.sum() if counts.sum() else counts


def _hashed(words: list[str], bins: int) -> np.ndarray:
    places = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % bins for w in words]
    return _share(np.bincount(places, minlength=bins).astype(float))


def kind_of(cells: list[str]) -> str:
    numbers = sum(bool(re.match(NUMBER, c)) for c in cells)
    if numbers >= len(cells) - numbers:
        return "numeric"
    return "categorical" if len(set(cells)) < min(len(cells) // 4 + 1, 50) else "text"


def encode(raw: bytes, dim: int = DIMENSION, delimiter: str = ",") -> np.ndarray:
    """The embedding of a whole table: its columns' encodings one after another, cut or filled up, normalised."""
    header, rows = parse(raw, delimiter)
    parts: list[np.ndarray] = [np.zeros(0)]
    for c in range(len(header)):
        cells = [r[c] for r in rows if c < len(r)]
        kind = kind_of(cells)
        if kind == "numeric":
            x = np.array([float(m[0]) for s in cells if (m := _LEADING.match(s))])
            parts.append(np.array([x.mean(), np.sqrt(x.var() + 1e-12), x.min(), x.max()]) if len(x) else np.zeros(0))
        elif kind == "categorical":
            parts.append(_hashed(cells, CATEGORY_BINS))
        else:
            parts.append(_hashed([w for s in cells for w in re.findall(r"[A-Za-z0-9_]+", s)], TEXT_BINS))
        if sum(map(len, parts)) >= dim:
            break
    return unit(fitted(np.concatenate(parts), dim))


def fitted(v: np.ndarray, dim: int) -> np.ndarray:
    out = np.zeros(dim)
    out[: min(dim, len(v))] = v[:dim]
    return out


def unit(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum())
    return v / size if size > 0 else v


def process(raw: Column) -> Column:
    @F.pandas_udf("array<double>")
    def embed(part: pd.Series) -> pd.Series:
        return part.map(lambda b: encode(bytes(b)) if b else None)

    return embed(raw)
