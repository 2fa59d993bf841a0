"""Incremental ingestion: micro-batches are appended to a collection on disk.

A batch's files are written under its number, so that a batch that is run again
replaces its own rows and never doubles them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quiverine.functions.vectors import checked
from quiverine.operators.metadata import is_valid


def valid_rows(rows: DataFrame, dim: int) -> DataFrame:
    """Rows (id, vector, metadata) as a collection has them; wrong dimensions or metadata end the batch."""
    metadata = F.when(F.col("metadata").isNull() | is_valid(F.col("metadata")), F.col("metadata")).otherwise(F.raise_error(F.lit("invalid metadata")).cast("map<string,string>"))
    return rows.select(F.col("id").cast("long"), checked(F.col("vector").cast("array<float>"), dim).alias("vector"), metadata.alias("metadata"))


def ingest(stream: DataFrame, path: str, checkpoint: str, dim: int) -> StreamingQuery:
    """Append a stream of (id, vector, metadata) to the folder of a collection until its input is used up."""

    def write(batch: DataFrame, number: int) -> None:
        valid_rows(batch, dim).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("id", "vector", "metadata")
