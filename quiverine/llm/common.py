"""What the training-data operators share: scratch tables, shipping, running totals."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverine.sources.shared import file_system, new_folder

class Scratch:
    """Tables written once in the shared folder: they cut lineage and outlive executors.

    A result that is still to be read may need them, so they go when the application
    ends, or earlier by ``drop``; a driver that is killed leaves them behind.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.base = new_folder(spark, label)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return what was written."""
        df.write.option("compression", "zstd").mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads."""
        for name in names:
            files, path = file_system(self.spark, self.path(name))
            files.delete(path, True)

    def remove(self) -> None:
        """Remove all tables."""
        files, path = file_system(self.spark, self.base)
        files.delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    # Very long texts: a batch that goes to Python is bounded in bytes, not only in rows.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    context = spark.sparkContext
    if getattr(context, "_quiverine_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):
        folder = tempfile.mkdtemp(prefix="quiverine-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = os.path.join(folder, "quiverine_pkg.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for at, _, files in os.walk(root):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(at, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(root)))
        context.addPyFile(archive)
    context._quiverine_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def slices(sizes: Iterable[int], limit: int = 512 << 10) -> Iterator[tuple[int, int]]:
    """Bounds of runs of items that hold about ``limit`` bytes each."""
    start = held = end = 0
    for end, n in enumerate(sizes, 1):
        held += n
        if held >= limit:
            yield start, end
            start, held = end, 0
    if start < end:
        yield start, end


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first lengthened form of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def settle() -> None:
    """Give freed memory back to the system: workers stay for later tasks beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def batches(rows: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches that hold about ``limit`` bytes of ``column`` each."""
    for batch in rows:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for start, end in slices(sizes, limit):
            yield batch.slice(start, end - start)
    settle()


#: Groups of at least 1 in so many rows are hot; where there are more partitions than this, of 1 in as many.
HOT_SHARE = 1000


def hot_share(spark: SparkSession) -> int:
    """Groups of at least 1 in so many rows are looked up in a broadcast table, which has no more rows than this.

    Any other group is no larger than a partition is on average.
    """
    return max(HOT_SHARE, split_count(spark))


def split_count(spark: SparkSession) -> int:
    """How many parts a table is dealt to: the session's number of shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


#: Numbers of 64 bits that a filter has at most.
FILTER_WORDS = 1 << 19


def bits_of(values: Column, rows: DataFrame) -> DataFrame:
    """A set of values as bits by hash: (word_, bits_), FILTER_WORDS rows at most whatever the set's size."""
    places = rows.select(F.pmod(F.xxhash64(values), F.lit(FILTER_WORDS * 64)).alias("place_"))
    return places.groupBy(F.shiftright("place_", 6).alias("word_")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place_ & 63 AS INT))")).alias("bits_"))


def sifted(df: DataFrame, value: Column, bits: DataFrame, inside: bool) -> DataFrame:
    """The rows whose value may be in a set (``inside``), or those whose value surely isn't; no row moves.

    Of the rows that aren't in the set, the more pass for those that may be the fuller the bits are; none that is in it is lost.
    """
    place, columns = free_name(df, "place_"), df.columns
    marked = df.withColumn(place, F.pmod(F.xxhash64(value), F.lit(FILTER_WORDS * 64)))
    side = F.broadcast(bits.select(F.col("word_").alias(free_name(marked, "word_")), F.col("bits_").alias(free_name(marked, "bits_"))))
    both = marked.join(side, F.shiftright(marked[place], 6) == side[side.columns[0]], "inner" if inside else "left")
    hit = F.coalesce(F.expr(f"shiftright(`{side.columns[1]}`, cast(`{place}` & 63 AS INT)) & 1"), F.lit(0)) == 1
    return both.filter(hit if inside else ~hit).select(*[marked[c] for c in columns])


def without_ids(docs: DataFrame, ident: Column, lost: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows whose id isn't in ``lost``, a table of one column, of any size; only rows that may be in it move."""
    bits = scratch.table(bits_of(F.col(lost.columns[0]), lost), "lost-bits")
    return sifted(docs, ident, bits, False).unionByName(unmatched(sifted(docs, ident, bits, True), lost, ident == lost[lost.columns[0]]))


def unmatched(df: DataFrame, lost: DataFrame, on: Column) -> DataFrame:
    """The rows that no row of ``lost`` matches; either table may be of any size.

    An anti join would be moved below a sieve, before the rows are few; an outer join stays where it is written.
    """
    gone = free_name(df, "gone_")
    both = df.join(lost.withColumn(gone, F.lit(True)).hint("merge"), on, "left")
    return both.filter(F.col(gone).isNull()).select(*[df[c] for c in df.columns])


def running(df: DataFrame, scratch: Scratch, name: str, order: list[Column], group: str | None, sums: Iterable[str]) -> DataFrame:
    """Running totals over a total order, without one task that sees a whole group.

    Rows are range-partitioned by ``order`` (which must begin with ``group``), sorted
    and written. Every partition then adds up its own rows; the totals of the parts
    before it, one small row for each part and group, are joined on. The result has
    for each name ``x`` in ``sums`` a column ``before_x``: the total of ``x`` over the
    earlier rows of the same group; ``rank_`` counts those rows.
    """
    sums = list(sums)
    parts = split_count(df.sparkSession)
    ranged = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("part_", F.spark_partition_id())
    )
    key = ["part_"] + ([group] if group else [])
    written = scratch.table(ranged.transform(lambda d: _local_totals(d, group, sums)), name)
    totals = written.groupBy(*key).agg(F.count(F.lit(1)).alias("n_"), *[F.sum(s).alias(f"sum_{s}") for s in sums])
    # One row for each part and group; with the group first in the order there are at
    # most parts + groups of them.
    over = "PARTITION BY " + (f"`{group}`" if group else "0") + " ORDER BY part_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    offsets = totals.select(
        *[F.col(k).alias(f"{k}__o") for k in key],
        F.expr(f"coalesce(sum(n_) OVER ({over}), 0)").alias("off_n"),
        *[F.expr(f"coalesce(sum(`sum_{s}`) OVER ({over}), 0)").alias(f"off_{s}") for s in sums],
    )
    on = [F.col(k).eqNullSafe(F.col(f"{k}__o")) for k in key]
    joined = written.join(offsets, on)
    return joined.withColumns(
        {"rank_": F.col("local_rank_") + F.col("off_n")} | {f"before_{s}": F.col(f"local_{s}") + F.col(f"off_{s}") for s in sums}
    ).drop(*[f"{k}__o" for k in key], "off_n", "local_rank_", "part_", *[f"off_{s}" for s in sums], *[f"local_{s}" for s in sums])


def _local_totals(df: DataFrame, group: str | None, sums: list[str]) -> DataFrame:
    """Totals of the earlier rows of the same group in this partition, by a streaming pass."""
    from pyspark.sql import types as T

    schema = T.StructType(
        [*df.schema.fields, T.StructField("local_rank_", T.LongType()), *[T.StructField(f"local_{s}", T.LongType()) for s in sums]]
    )

    def add_up(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        last: object = None
        seen = 0
        held = dict.fromkeys(sums, 0)
        for batch in rows:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, bool)
            if group:
                keys = batch.column(group).to_pylist()
                before = [last, *keys[:-1]]
                starts = np.array([a != b for a, b in zip(keys, before, strict=True)])
                if seen == 0:
                    starts[0] = False
                last = keys[-1]
            at = np.arange(n)
            first = np.maximum.accumulate(np.where(starts, at, -1))
            rank = np.where(first < 0, at + seen, at - first)
            columns = [pa.array(rank, pa.int64())]
            for s in sums:
                values = batch.column(s).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(values)
                earlier = total - values
                local = np.where(first < 0, earlier + held[s], earlier - earlier[np.maximum(first, 0)])
                held[s] = int(local[-1] + values[-1])
                columns.append(pa.array(local, pa.int64()))
            seen = int(rank[-1]) + 1
            names = [*batch.schema.names, "local_rank_", *[f"local_{s}" for s in sums]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return df.mapInArrow(add_up, schema)
