"""Import of collections that are kept in three files: vectors, metadata and config.

Vectors, version 1, little-endian: version u32, length of the algorithm's name u32, the
name, metric i32, dimension u32, count u64; then for each row id u64, dimension u32 and
its floats; at last the next id, u64. Metadata is text: an id and a brace on a line, then
a line for each key and value, without escapes. Config is text: ``name=number`` lines.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quiverine.config import DatabaseConfig, DistanceMetric, IndexType
from quiverine.errors import VectorEngineError

VERSION = 1
_ID = re.compile(r'^\s*"(\d+)": \{\s*$')
_FIELD = re.compile(r'^\s*"([^"]*)": "([^"]+)')


def _rows(dim: int) -> np.dtype:
    return np.dtype([("id", "<u8"), ("dim", "<u4"), ("v", "<f4", (dim,))])


def write(ids: np.ndarray, vectors: np.ndarray, next_id: int, algorithm: str = "brute_force", metric: int = 0) -> bytes:
    name, dim = algorithm.encode(), vectors.shape[1]
    body = np.zeros(len(ids), _rows(dim))
    body["id"], body["dim"], body["v"] = ids, dim, vectors
    return struct.pack("<II", VERSION, len(name)) + name + struct.pack("<iIQ", metric, dim, len(ids)) + body.tobytes() + struct.pack("<Q", next_id)


def parse(raw: bytes) -> tuple[str, int, np.ndarray, np.ndarray, int]:
    """Algorithm, metric, ids, vectors and next id of a vectors file."""
    version, size = struct.unpack_from("<II", raw, 0)
    if version != VERSION:
        raise ValueError(f"unknown version {version}")
    at = 8 + size
    name = raw[8:at].decode()
    metric, dim, count = struct.unpack_from("<iIQ", raw, at)
    at += 16
    body = np.frombuffer(raw, _rows(dim), count, at)
    if (body["dim"] != dim).any():
        raise ValueError("a row's dimension differs from the file's")
    return name, metric, body["id"].astype(np.int64), body["v"], struct.unpack_from("<Q", raw, at + count * body.itemsize)[0]


def parse_metadata(text: str) -> dict[int, dict[str, str]]:
    """What the text holds; fields with empty values are lost in it, and values end at a quote."""
    out: dict[int, dict[str, str]] = {}
    own: dict[str, str] = {}
    for line in text.split("\n"):
        if m := _ID.match(line):
            own = out[int(m[1])] = {}
        elif m := _FIELD.match(line):
            own[m[1]] = m[2]
    return out


def parse_config(text: str) -> DatabaseConfig:
    found = dict(line.split("=", 1) for line in text.split("\n") if "=" in line)
    number = lambda k, default: int(found.get(k, default))
    return DatabaseConfig(
        dimension=number("dimension", 0), index_type=list(IndexType)[number("index_type", 4)], metric=list(DistanceMetric)[number("metric", 0)],
        nlist=number("nlist", 100), m=number("m", 8), nbits=number("nbits", 8), M=number("M", 16), ef_construction=number("efConstruction", 200),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector) of all vectors files of a path; each file is parsed by one task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                _, _, ids, vectors, _ = parse(content.as_py())
                offsets = pa.array(np.arange(len(ids) + 1) * vectors.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(vectors).ravel()))], names=["id", "vector"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "id long, vector array<float>")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(id, metadata) of all metadata files of a path."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = parse_metadata(content.as_py().decode("utf-8", "replace"))
                fields = pa.array([list(m.items()) for m in found.values()], pa.map_(pa.string(), pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), fields], names=["id", "metadata"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "id long, metadata map<string,string>")


def read_collection(spark: SparkSession, base: str) -> tuple[DataFrame, DatabaseConfig]:
    """Rows (id, vector, metadata) and settings of ``base`` with its three suffixes; settings may be missing."""
    try:
        text = "\n".join(r.value for r in spark.read.text(f"{base}.config", wholetext=True).collect())
    except Exception:  # noqa: BLE001  Spark has no own class for a missing path
        text = ""
    config = parse_config(text)
    if not config.dimension:
        first = read(spark, f"{base}.vectors").limit(1).collect()
        if not first:
            raise VectorEngineError(f"the dimension of {base} isn't known")
        config.dimension = len(first[0].vector)
    rows = read(spark, f"{base}.vectors").join(read_metadata(spark, f"{base}.metadata"), "id", "full_outer")
    return rows.select("id", "vector", "metadata"), config
