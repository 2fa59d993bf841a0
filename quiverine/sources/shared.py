"""The folder that the cluster shares, and files on whatever file system Spark uses."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from typing import Any

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is missing, a local session gets a folder of its own; on a
    cluster that would lose rows, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="quiverine-")
        atexit.register(shutil.rmtree, _own[key], ignore_errors=True)
    return f"file://{_own[key]}"


def file_system(spark: SparkSession, uri: str) -> tuple[Any, Any]:
    """Hadoop's file system of a path, as Spark itself uses it, and the path there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared one; it goes when the application ends (a driver that is killed leaves it)."""
    base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    files, path = file_system(spark, base)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return base


def stored_bytes(spark: SparkSession, uri: str) -> int:
    """The size of all files of a folder."""
    files, path = file_system(spark, uri)
    return int(files.getContentSummary(path).getLength())
