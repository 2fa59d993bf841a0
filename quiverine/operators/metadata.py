"""The metadata of a collection: lookups, scans and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of a row's metadata (fixed values).
MOST_FIELDS, KEY_BYTES, VALUE_BYTES = 1000, 256, 10_000


def with_metadata(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("metadata").isNotNull())


def get(rows: DataFrame, id_: int) -> DataFrame:
    return with_metadata(rows).filter(F.col("id") == id_).select("id", "metadata")


def get_batch(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """For (position, id) rows, in their order and with repeats: their metadata, empty where there is none."""
    found = ids.join(with_metadata(rows).select("id", "metadata"), "id", "left")
    return found.select("position", "id", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def find(rows: DataFrame, key: str, value: str) -> DataFrame:
    return with_metadata(rows).filter(F.element_at("metadata", key) == value).select("id")


def find_prefix(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Ids of rows whose value begins with ``prefix``; an empty one finds every row that has the key."""
    return with_metadata(rows).filter(F.element_at("metadata", key).startswith(prefix)).select("id")


def filter_ids(rows: DataFrame, ids: DataFrame, predicate: Column) -> DataFrame:
    """Of (position, id) rows, those whose metadata satisfies a predicate."""
    return ids.join(with_metadata(rows).select("id", "metadata"), "id").filter(predicate).select("position", "id")


def all_keys(rows: DataFrame) -> DataFrame:
    return with_metadata(rows).select(F.explode(F.map_keys("metadata")).alias("key")).distinct().orderBy("key")


def matches(conditions: dict[str, object]) -> Column:
    """That all values agree as strings; a missing key counts as ``None``, its name."""
    out = F.lit(True)
    for key, value in conditions.items():
        out = out & (F.coalesce(F.element_at("metadata", key), F.lit("None")) == str(value))
    return out


def scan(rows: DataFrame, conditions: dict[str, object], limit: int) -> DataFrame:
    """The first rows in order of insertion that satisfy the conditions."""
    holding = rows.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    return holding.filter(matches(conditions)).orderBy("id").limit(limit).select("id", "metadata")


def is_valid(metadata: Column) -> Column:
    """Whether metadata keeps to the limits on fields, keys and values (in bytes)."""
    keys = F.forall(F.map_keys(metadata), lambda k: F.octet_length(k).between(1, KEY_BYTES))
    return (F.size(metadata) <= MOST_FIELDS) & keys & F.forall(F.map_values(metadata), lambda v: F.octet_length(v) <= VALUE_BYTES)


def check(metadata: dict[str, str]) -> None:
    """The same limits for a value on the driver; raises."""
    from quiverine.errors import VectorEngineError

    if len(metadata) > MOST_FIELDS:
        raise VectorEngineError("too many metadata fields")
    for k, v in metadata.items():
        if not 1 <= len(k.encode()) <= KEY_BYTES or len(v.encode()) > VALUE_BYTES:
            raise VectorEngineError(f"metadata key or value out of bounds: {k[:40]!r}")


def latest(entries: DataFrame) -> DataFrame:
    """Of (position, id, metadata) rows, the last of each id."""
    return entries.groupBy("id").agg(F.max_by("metadata", "position").alias("metadata"))


def ids_frame(like: DataFrame, ids: Sequence[int]) -> DataFrame:
    return like.sparkSession.createDataFrame(list(enumerate(ids)), "position int, id long")
