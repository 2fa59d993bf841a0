"""Sharding by jump consistent hashing.

A stable key and the number of shards decide a row's shard; there is no ring table.
With one more shard, a row either stays or moves to the new shard, and about one row
in ``n + 1`` moves.

Defined results: a null text counts as empty; a null id has a key of its own, so such
rows go to one shard; repeated ids share a shard; ties in a shard are numbered by
(id, checksum, size), and equal rows among them in any order; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, running, ship, split_count, text_of

#: The published generator's multiplier (Lamping and Veach, 2014): a fixed value.
STEP = np.uint64(2862933555777941757)
#: Bytes that a row takes beside its text.
ROW_OVERHEAD = 16


def stable_key(ids: np.ndarray) -> np.ndarray:
    """64-bit keys of integer ids: the same on every machine and in every run (a splitmix finaliser)."""
    x = ids.astype(np.uint64)
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key; the loop runs about ln(shards) times over what still jumps."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state, at, ahead = keys.astype(np.uint64).copy(), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        at[todo] = ahead[todo]
        state[todo] = state[todo] * STEP + np.uint64(1)
        draw = ((state[todo] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[todo] = ((at[todo] + 1).astype(np.float64) * (float(1 << 31) / draw)).astype(np.int64)
        todo = todo[ahead[todo] < shards]
    return at.astype(np.int32)


def _known(ident: Column) -> Column:
    """The id, or for a null one a number that stands for it: pandas would make floats of a part with nulls."""
    return F.coalesce(ident, F.lit(-(1 << 62)))


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its shard among ``shards``, its slot there and its shard among one more.

    Slots count the documents of a shard from 0 in id order. They come from running
    totals over range partitions, so no task holds a whole shard.
    """
    spark = docs.sparkSession
    ship(spark)
    text = text_of(text_col)

    @F.pandas_udf("shard int, grown_shard int")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for ids in parts:
            keys = stable_key(ids.to_numpy(np.int64))
            yield pd.DataFrame({"shard": jump(keys, shards), "grown_shard": jump(keys, shards + 1)})

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    scratch = Scratch(spark, "sharding")
    # Written first, so that the texts are read once: finding the ranges reads its input, too.
    placed = scratch.table(rows.withColumn("place", place(_known(F.col("doc_id")))).select("doc_id", "size", "text_crc32", "place.shard", "place.grown_shard"), "placed")
    order = [F.col(c) for c in ("shard", "doc_id", "text_crc32", "size")]
    numbered = running(placed, scratch, "numbered", order, "shard", [])
    scratch.drop("placed")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("rank_").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id") -> None:
    """Write the rows with all their columns, a folder for each shard, by a column ``shard`` (longer where there is one).

    Rows move to a few tasks for each shard, so that a shard has a few files and no task holds a large one.
    """
    spark = docs.sparkSession
    ship(spark)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(jump(stable_key(ids.to_numpy(np.int64)), shards))

    name, parts = free_name(docs, "shard"), split_count(spark)
    placed = docs.withColumn(name, place(_known(F.col(id_col).cast("long"))))
    salted = placed.repartition(max(parts, shards), name, F.pmod(F.xxhash64(id_col), F.lit(-(-parts // shards) + 1)))
    salted.write.mode("overwrite").partitionBy(name).parquet(path)
