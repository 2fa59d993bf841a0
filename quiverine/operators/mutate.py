"""Changes of a collection: each takes its rows and returns new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverine.sources import shared

SCHEMA = "id long, vector array<float>, metadata map<string,string>"


def empty(spark) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame([], SCHEMA)


def append(rows: DataFrame, new: DataFrame) -> DataFrame:
    return rows.unionByName(new.select("id", "vector", "metadata"))


def number(new: DataFrame, order: str, start: int, path: str | None = None) -> DataFrame:
    """(id, ...) with gapless ids from ``start`` in the order of a column.

    Ranges of the order are numbered apart, and each range's start is the sum of the
    rows before it, so no task sees all rows. The ranges are written first, to ``path``
    or to the shared folder, and are not worked out twice.
    """
    spark = new.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = new.repartitionByRange(parts, order).sortWithinPartitions(order)
    own = ranged.withColumn("part_", F.spark_partition_id()).withColumn("place_", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    path = path or f"{shared.new_folder(spark, 'numbered')}/rows"
    own.write.mode("overwrite").parquet(path)
    own = spark.read.schema(own.schema).parquet(path)
    counts = {r.part_: r.n for r in own.groupBy("part_").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    if not offsets:
        return new.withColumn("id", F.lit(0).cast("long"))
    # A row for each partition.
    starts = F.broadcast(spark.createDataFrame(offsets, "part_ int, start_ long"))
    return own.join(starts, "part_").withColumn("id", F.col("start_") + F.col("place_") + start).drop("part_", "place_", "start_")


def remove(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows without those of some ids: vectors and metadata go."""
    return rows.join(ids.select("id").distinct(), "id", "left_anti")


def update(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (id, vector, metadata) changes, one for each id.

    A null or empty vector keeps the old one and counts for known ids only; metadata
    that isn't empty replaces the old, and is stored for unknown ids, too.
    """
    new = changes.select("id", F.when(F.size("vector") > 0, F.col("vector")).alias("new_vector"), F.when(F.size("metadata") > 0, F.col("metadata")).alias("new_metadata"))
    both = rows.join(new, "id", "full_outer")
    vector = F.when(F.col("vector").isNull(), F.col("vector")).otherwise(F.coalesce("new_vector", "vector"))
    return both.select("id", vector.alias("vector"), F.coalesce("new_metadata", "metadata").alias("metadata")).filter(F.col("vector").isNotNull() | F.col("metadata").isNotNull())


def set_metadata(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Replace the metadata of (id, metadata) rows; unknown ids get a row without a vector."""
    both = rows.join(entries.select("id", F.col("metadata").alias("new_metadata")), "id", "full_outer")
    return both.select("id", "vector", F.coalesce("new_metadata", "metadata").alias("metadata"))


def remove_metadata(rows: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("id", F.lit(True).alias("gone")).distinct()
    both = rows.join(gone, "id", "left")
    return both.select("id", "vector", F.when(F.col("gone").isNull(), F.col("metadata")).alias("metadata")).filter(F.col("vector").isNotNull() | F.col("metadata").isNotNull())
