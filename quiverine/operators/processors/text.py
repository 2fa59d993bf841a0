"""Text: tokens and hashed bags of tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longer tokens are cut into chunks (fixed values).
LONG_TOKEN, CHUNK, DIMENSION = 12, 6, 768


def tokens(text: Column, cut_long: bool = True) -> Column:
    """Runs of a-z, 0-9 and _ in lower case; with ``cut_long`` those over 12 characters in chunks of 6."""
    found = F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([a-z0-9_]+)"))
    if not cut_long:
        return found
    return F.flatten(F.transform(found, lambda t: F.when(F.length(t) > LONG_TOKEN, F.regexp_extract_all(t, F.lit(f"(.{{1,{CHUNK}}})"))).otherwise(F.array(t))))


def bucket(token: Column, buckets: int) -> Column:
    """A token's bucket: the first 32 bits of its MD5, which any engine can work out."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


class Buckets:
    """The buckets of tokens by a hash table of bounded size; the same tokens and hashes as ``tokens`` and ``bucket``."""

    MOST = 1_000_000
    WORD = re.compile(rb"[a-z0-9_]+")

    def __init__(self, dim: int, cut_long: bool = True) -> None:
        self.dim, self.cut_long = dim, cut_long
        self.known: dict[bytes, int] = {}

    def _bucket(self, token: bytes) -> int:
        if len(self.known) >= self.MOST:
            self.known.clear()
        return self.known.setdefault(token, int(md5(token).hexdigest()[:8], 16) % self.dim)

    def sums(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that a text has, ascending, and their weights, normalised."""
        found = self.WORD.findall(text.encode("utf-8", "surrogatepass").lower())
        if self.cut_long and any(len(t) > LONG_TOKEN for t in found):
            found = [c for t in found for c in ([t] if len(t) <= LONG_TOKEN else [t[i : i + CHUNK] for i in range(0, len(t), CHUNK)])]
        get, make = self.known.get, self._bucket
        own = np.fromiter((b if (b := get(t)) is not None else make(t) for t in found), np.int64, len(found))
        weight = np.bincount(own, 1.0 + 0.1 * np.fromiter(map(len, found), float, len(found)), self.dim) if len(found) else np.zeros(self.dim)
        there = np.flatnonzero(weight)
        return there, weight[there] / np.sqrt((weight[there] ** 2).sum())


def weighted_buckets(docs: DataFrame, id_col: str, text_col: str, dim: int = DIMENSION) -> DataFrame:
    """(id, bucket, weight) of each text's bag of tokens, normalised; the sparse form of its embedding. Nothing is shuffled."""
    schema = T.StructType([docs.schema[id_col], T.StructField("bucket", T.IntegerType()), T.StructField("weight", T.DoubleType())])

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Buckets(dim)
        for batch in rows:
            found = [own.sums(t) if t else (np.zeros(0, np.int64), np.zeros(0)) for t in batch.column(text_col).to_pylist()]
            if not found:
                continue
            of = pa.array(np.repeat(np.arange(len(found)), [len(b) for b, _ in found]))
            columns = [batch.column(id_col).take(of), pa.array(np.concatenate([b for b, _ in found]).astype(np.int32)), pa.array(np.concatenate([w for _, w in found]))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "bucket", "weight"])

    return docs.select(id_col, text_col).mapInArrow(work, schema)


def embedding(text: Column, dim: int = DIMENSION, cut_long: bool = True) -> Column:
    """The embedding as a dense vector; zeros for a text without tokens, null for none."""

    @F.pandas_udf("array<double>")
    def embed(part: pd.Series) -> pd.Series:
        own, out = Buckets(dim, cut_long), []
        for t in part:
            dense = None
            if t is not None:
                dense = np.zeros(dim)
                there, weight = own.sums(t)
                dense[there] = weight
            out.append(dense)
        return pd.Series(out, dtype=object)

    return embed(text)


def process(raw: Column) -> Column:
    return embedding(F.decode(raw, "UTF-8"))


def is_valid(raw: Column) -> Column:
    """Not empty, and more than half of the bytes printable (in ASCII)."""
    chars = F.decode(raw.cast("binary"), "ISO-8859-1")
    printable = F.length(F.regexp_replace(chars, r"[^\n\r\t\x20-\x7E]", ""))
    return (F.length(chars) > 0) & (printable * 2 > F.length(chars) - F.length(chars) % 2)
