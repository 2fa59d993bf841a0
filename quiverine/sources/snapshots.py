"""Collections on disk: Parquet rows in numbered versions beside a JSON file of properties."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from quiverine.config import DatabaseConfig, DistanceMetric, IndexType
from quiverine.errors import VectorEngineError

from .shared import file_system

FORMAT = 1


def save(rows: DataFrame, config: DatabaseConfig, next_id: int, path: str, index: Callable[[str], bool] | None = None) -> None:
    """Write a new version, then the properties that name it; a reader sees the old or the new one.

    ``index`` writes the fitted index to a folder, and tells whether there was anything to write.
    """
    spark = rows.sparkSession
    try:
        version = properties(spark, path)["version"] + 1
    except VectorEngineError:
        version = 1
    rows.write.mode("overwrite").parquet(f"{path}/v={version}")
    indexed = bool(index and index(f"{path}/index-{version}"))
    own = asdict(config) | {"index_type": config.index_type.value, "metric": config.metric.value}
    text = json.dumps({"format": FORMAT, "version": version, "next_id": next_id, "indexed": indexed, "config": own})
    fs, at = file_system(spark, f"{path}/properties.json")
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def properties(spark: SparkSession, path: str) -> dict:
    fs, at = file_system(spark, f"{path}/properties.json")
    if not fs.exists(at):
        raise VectorEngineError(f"no collection at {path}")
    text = "\n".join(r.value for r in spark.read.text(f"{path}/properties.json", wholetext=True).collect())
    found = json.loads(text)
    if found.get("format") != FORMAT:
        raise VectorEngineError(f"unknown format of {path}")
    return found


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DatabaseConfig, int, str | None]:
    """Rows, config, the next id and the index's folder; all is checked before anything is returned."""
    found = properties(spark, path)
    own = found["config"]
    config = DatabaseConfig(**(own | {"index_type": IndexType(own["index_type"]), "metric": DistanceMetric(own["metric"])}))
    return spark.read.parquet(f"{path}/v={found['version']}"), config, int(found["next_id"]), f"{path}/index-{found['version']}" if found.get("indexed") else None
