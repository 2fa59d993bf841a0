"""The database API: collections with search, metadata, changes, an index and persistence.

A collection's state is an immutable snapshot: rows, the next id, and the strategy with
the rows that it was fitted on. Every change makes a new snapshot, after all checks.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DatabaseConfig, DistanceMetric, Fusion, FusionParams, IndexType, Modality, Params, SearchParams, SearchStats, parse_index_type, parse_metric
from .errors import MultimodalError, VectorEngineError
from .functions import vectors as V
from .operators import metadata as M
from .operators import mutate
from .operators import search as S
from .operators.fusion import FusionEngine
from .operators.index import SearchStrategy, registry
from .operators.processors import ProcessorRegistry
from .sources import shared, snapshots

Metadata = dict[str, str]
#: Changes after which the rows' lineage is cut.
CUT_AFTER = 16


class VectorDatabase:
    def __init__(self, spark: SparkSession, config: DatabaseConfig, id_base: int = 1) -> None:
        if config.dimension <= 0:
            raise VectorEngineError("dimension must be positive")
        self.spark, self._config = spark, config
        self.strategy = self._new_strategy(config)
        self.rows, self.next_id, self.id_base = mutate.empty(spark), id_base, id_base
        self._dirty, self._changes = True, 0
        self._stats, self._asked = SearchStats(), None

    @staticmethod
    def _new_strategy(config: DatabaseConfig) -> SearchStrategy:
        return registry.create(config.algorithm, config.metric, dict(config.build_params) | dict(config.query_params))

    @classmethod
    def from_dataframe(cls, rows: DataFrame, config: DatabaseConfig, id_col: str = "id", vector_col: str = "vector", metadata: Column | None = None) -> VectorDatabase:
        """A collection over rows that have ids already, such as a Parquet table."""
        own = cls(rows.sparkSession, config)
        fields = F.lit(None).cast("map<string,string>") if metadata is None else metadata
        own.rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"), fields.alias("metadata"))
        own.next_id = (own.rows.agg(F.max("id")).first()[0] or 0) + 1
        return own

    # Properties

    def size(self) -> int:
        return self.rows.filter(F.col("vector").isNotNull()).count()

    def dimension(self) -> int:
        return self._config.dimension

    def index_type(self) -> IndexType:
        return self._config.index_type

    def config(self) -> DatabaseConfig:
        return self._config

    def ids(self) -> DataFrame:
        return self.rows.filter(F.col("vector").isNotNull()).select("id")

    # Changes

    def _vector(self, vector: Sequence[float]) -> list[float]:
        out = np.asarray(vector, dtype=np.float32)
        if out.ndim != 1 or len(out) != self._config.dimension:
            raise VectorEngineError(f"dimension mismatch: expected {self._config.dimension}, got {out.shape}")
        if np.isnan(out).any():
            raise VectorEngineError("a vector holds NaN")
        return out.tolist()

    def _become(self, rows: DataFrame, next_id: int | None = None) -> None:
        self._changes += 1
        if self._changes % CUT_AFTER == 0:
            path = shared.new_folder(self.spark, "collection")
            rows.write.mode("overwrite").parquet(f"{path}/rows")
            rows = self.spark.read.schema(rows.schema).parquet(f"{path}/rows")
        self.rows, self._dirty = rows, True
        self.next_id = self.next_id if next_id is None else next_id

    def add(self, vector: Sequence[float], metadata: Metadata | None = None) -> int:
        return self.add_batch([vector], [metadata or {}])[0]

    def add_batch(self, vectors: Sequence[Sequence[float]], metadata: Sequence[Metadata] | None = None) -> list[int]:
        """Ids follow each other in the order of the input."""
        new, ids = self._new_rows(vectors, metadata, self.next_id)
        if new is not None:
            self._take_in(new, self.next_id + len(ids))
        return ids

    def _new_rows(self, vectors: Sequence[Sequence[float]], metadata: Sequence[Metadata] | None, start: int) -> tuple[DataFrame | None, list[int]]:
        """Checked rows with their ids; none where there are no vectors."""
        if metadata and len(metadata) != len(vectors):
            raise VectorEngineError("as many metadata maps as vectors are needed")
        own = [self._vector(v) for v in vectors]
        fields = list(metadata or [{}] * len(own))
        for m in fields:
            M.check(m)
        ids = list(range(start, start + len(own)))
        if not own:
            return None, ids
        return self.spark.createDataFrame([(i, v, m or None) for i, v, m in zip(ids, own, fields, strict=True)], mutate.SCHEMA), ids

    def _take_in(self, new: DataFrame, next_id: int) -> None:
        live = not self._dirty and self.strategy.built and self.strategy.capabilities.updates
        self._become(mutate.append(self.rows, new), next_id)
        if live:
            self.strategy.add(new)
            self._dirty = False

    def add_numpy(self, vectors: np.ndarray, metadata: Sequence[Metadata] | None = None) -> list[int]:
        array = np.asarray(vectors, dtype=np.float32)
        if array.ndim != 2:
            raise VectorEngineError("a two-dimensional array is needed")
        return self.add_batch(array, metadata)

    def add_dataframe(self, new: DataFrame, order: str, vector_col: str = "vector", metadata: Column | None = None, path: str | None = None) -> None:
        """Append any number of rows; ids follow the order of a column, and no row comes to the driver."""
        fields = F.lit(None).cast("map<string,string>") if metadata is None else metadata
        own = new.select(F.col(order).alias("order_"), V.checked(F.col(vector_col).cast("array<float>"), self._config.dimension).alias("vector"), fields.alias("metadata"))
        numbered = mutate.number(own, "order_", self.next_id, path)
        added = numbered.count()
        self._take_in(numbered.select("id", "vector", "metadata"), self.next_id + added)

    def remove(self, id_: int) -> bool:
        self.strategy.require("deletions") if self.strategy.built and not self._dirty else None
        found = bool(self.ids().filter(F.col("id") == id_).limit(1).count())
        self._become(mutate.remove(self.rows, self._ids([id_])))
        return found

    def update(self, id_: int, vector: Sequence[float] = (), metadata: Metadata | None = None) -> bool:
        new = self._vector(vector) if len(vector) else None
        M.check(metadata or {})
        known = bool(self.ids().filter(F.col("id") == id_).limit(1).count())
        change = self.spark.createDataFrame([(id_, new, metadata or {})], mutate.SCHEMA)
        self._become(mutate.update(self.rows, change))
        return (known and new is not None) or bool(metadata) or (known and new is None)

    def clear(self) -> None:
        self._become(mutate.empty(self.spark))

    def clear_metadata(self) -> None:
        """Drop all metadata; vectors stay."""
        bare = self.rows.filter(F.col("vector").isNotNull()).withColumn("metadata", F.lit(None).cast("map<string,string>"))
        self._become(bare)

    def replace_all(self, vectors: Sequence[Sequence[float]], metadata: Sequence[Metadata] | None = None) -> list[int]:
        """These rows instead of all there are, with ids from the first; nothing changes where any of them is bad."""
        new, ids = self._new_rows(vectors, metadata, self.id_base)
        self._become(new if new is not None else mutate.empty(self.spark), self.id_base + len(ids))
        return ids

    def _ids(self, ids: Sequence[int]) -> DataFrame:
        return M.ids_frame(self.rows, ids)

    # Metadata

    def set_metadata(self, id_: int, metadata: Metadata) -> None:
        self.set_batch_metadata([id_], [metadata])

    def set_batch_metadata(self, ids: Sequence[int], metadata: Sequence[Metadata]) -> None:
        """All are checked before any is stored; of a repeated id the last counts."""
        if len(ids) != len(metadata):
            raise VectorEngineError("as many metadata maps as ids are needed")
        for m in metadata:
            M.check(m)
        entries = self.spark.createDataFrame([(p, i, m) for p, (i, m) in enumerate(zip(ids, metadata, strict=True))], "position int, id long, metadata map<string,string>")
        self._become(mutate.set_metadata(self.rows, M.latest(entries)))

    def get_metadata(self, id_: int) -> Metadata | None:
        found = M.get(self.rows, id_).first()
        return dict(found.metadata) if found else None

    def has_metadata(self, id_: int) -> bool:
        return bool(M.get(self.rows, id_).limit(1).count())

    def remove_metadata(self, id_: int) -> bool:
        had = self.has_metadata(id_)
        self._become(mutate.remove_metadata(self.rows, self._ids([id_])))
        return had

    def get_batch_metadata(self, ids: Sequence[int]) -> list[Metadata]:
        return [dict(r.metadata) for r in M.get_batch(self.rows, self._ids(ids)).orderBy("position").collect()]

    def find_by_metadata(self, key: str, value: str) -> DataFrame:
        return M.find(self.rows, key, value)

    def find_by_metadata_prefix(self, key: str, prefix: str) -> DataFrame:
        return M.find_prefix(self.rows, key, prefix)

    def filter_ids(self, ids: Sequence[int], predicate: Column) -> list[int]:
        return [r.id for r in M.filter_ids(self.rows, self._ids(ids), predicate).orderBy("position").collect()]

    def get_all_keys(self) -> list[str]:
        return [r.key for r in M.all_keys(self.rows).collect()]

    def metadata_size(self) -> int:
        return M.with_metadata(self.rows).count()

    # Index

    def build_index(self) -> None:
        self.strategy.fit(self.rows, getattr(self, "_training", None))
        self._dirty = False

    def train_index(self, data: Sequence[Sequence[float]]) -> None:
        """A sample to fit the index on at its next build."""
        self._training = np.array([self._vector(v) for v in data])
        self._dirty = True

    def is_trained(self) -> bool:
        return not self._dirty and self.strategy.built

    def _fresh(self) -> SearchStrategy:
        if self._dirty or not self.strategy.built:
            self.build_index()
        return self.strategy

    # Search

    def search(self, query: Sequence[float], k: int | SearchParams = 10, include_metadata: bool = True) -> DataFrame:
        """The best rows (id, score, metadata), or with a radius all rows within it, in no order."""
        params = k if isinstance(k, SearchParams) else SearchParams(k=k, include_metadata=include_metadata)
        found = self._fresh().query(self._vector(query), params)
        self._asked = (found, None, params.k if params.radius <= 0 else None)
        return found if params.include_metadata else found.withColumn("metadata", F.lit(None).cast("map<string,string>"))

    def search_numpy(self, query: np.ndarray, k: int | SearchParams = 10) -> DataFrame:
        return self.search(np.asarray(query, dtype=np.float32), k)

    def batch_search(self, queries: DataFrame | Sequence[Sequence[float]], params: SearchParams | None = None) -> DataFrame:
        if not isinstance(queries, DataFrame):
            queries = self.spark.createDataFrame([(i, self._vector(q)) for i, q in enumerate(queries)], "query_id long, vector array<float>")
        return self._fresh().query_batch(queries, params or SearchParams(), self._config.dimension)

    def _finder(self, query: list[float], params: SearchParams, holds: Column | None = None) -> S.Find:
        """What composite searches start from: rows that the index finds; the counts of this step are what the statistics tell."""

        def find(k: int) -> DataFrame:
            found = self._fresh().query(query, replace(params, k=k))
            self._asked = (found, holds, params.k)
            return found

        return find

    def range_search(self, query: Sequence[float], radius: float, metric_aware: bool = False) -> DataFrame:
        """All rows within the radius; an index leaves out only lists that can't have any."""
        own = self._vector(query)
        if radius > 0 and not (metric_aware and self._config.metric.higher_is_better):
            found = self._fresh().query(own, SearchParams(radius=radius))
        else:
            found = S.range_search(self.rows, own, radius, self._config.metric, metric_aware)
        self._asked = (found, None, None)
        return found

    def filtered_search(self, query: Sequence[float], predicate: Column | Callable[[dict], bool], params: SearchParams | None = None, mode: str = "compat") -> DataFrame:
        """``compat`` filters what the index finds; ``exact`` filters all rows first, and scans them."""
        p, own = params or SearchParams(), self._vector(query)
        holds = F.col("metadata").isNotNull() & S.condition(predicate)
        if mode == "exact":
            found = S.filtered(self.rows, own, predicate, p.k, self._config.metric, mode)
            self._asked = (self.rows.filter(F.col("vector").isNotNull()), holds, p.k)
            return found
        return S.filtered(self.rows, own, predicate, p.k, self._config.metric, mode, find=self._finder(own, p, holds))

    def batch_filtered_search(self, queries: DataFrame, predicate: Column | Callable[[dict], bool], params: SearchParams | None = None, mode: str = "compat") -> DataFrame:
        p, dim = params or SearchParams(), self._config.dimension
        find = lambda k: self._fresh().query_batch(queries, replace(p, k=k, include_metadata=True), dim)
        return S.filtered_batch(self.rows, queries, predicate, p.k, self._config.metric, mode, dim, find)

    def search_with_metadata(self, query: Sequence[float], key: str, value: str, params: SearchParams | None = None, mode: str = "compat") -> DataFrame:
        return self.filtered_search(query, F.element_at("metadata", key) == value, params, mode)

    def hybrid_search(self, query: Sequence[float], text: str = "", params: SearchParams | None = None, vector_weight: float = 0.7, text_weight: float = 0.3, metric_aware: bool = False) -> DataFrame:
        p, own = params or SearchParams(), self._vector(query)
        return S.hybrid(self.rows, own, p.k, text, vector_weight, text_weight, self._config.metric, metric_aware, find=self._finder(own, p))

    def search_with_rerank(self, query: Sequence[float], rank: Callable[[Column], Column], params: SearchParams | None = None, rerank_k: int = S.RERANK_K, metric_aware: bool = False) -> DataFrame:
        """``rank`` makes a column of the metadata's; ``operators.search.ranking`` makes one of a Python function."""
        p, own = params or SearchParams(), self._vector(query)
        return S.reranked(self.rows, own, rank, p.k, rerank_k, self._config.metric, metric_aware, find=self._finder(own, p))

    def collect_results(self, found: DataFrame) -> list[tuple[int, float, Metadata]]:
        """A search's rows as a list, best first; takes the time that get_last_search_stats tells."""
        began = time.perf_counter()
        rows = [(r.id, r.score, dict(r.metadata or {})) for r in found.collect()]
        spent = (time.perf_counter() - began) * 1000
        self._stats = replace(self._stats, search_ms=spent, total_ms=spent)
        return rows

    def get_last_search_stats(self) -> SearchStats:
        """Of the last search: the rows that it started from, those of them that its filter left, and its results.

        Searches are plans, so the counts are worked out here, in one job; times are those of ``collect_results``.
        """
        if self._asked:
            found, holds, k = self._asked
            began = time.perf_counter()
            counted = found.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.lit(True) if holds is None else F.coalesce(holds, F.lit(False))).alias("left")).first()
            final = counted["left"] if k is None else min(k, counted["left"])
            spent = (time.perf_counter() - began) * 1000 if holds is not None else 0.0
            self._stats = replace(self._stats, total_candidates=counted["all"], filtered_candidates=counted["left"], final_results=final, filter_ms=spent)
            self._asked = None
        return self._stats

    # Persistence

    def save(self, path: str) -> None:
        """Write the rows, the settings, and the index where it is up to date."""
        snapshots.save(self.rows, self._config, self.next_id, path, self.strategy.save if self.is_trained() else None)

    def load(self, path: str) -> None:
        """Replace this collection by a stored one, its settings and its index included; nothing changes if that fails."""
        rows, config, next_id, index = snapshots.load(self.spark, path)
        strategy = self._new_strategy(config)
        if index:
            strategy.load(self.spark, index)
        else:
            strategy.fit(rows)
        self.rows, self._config, self.next_id, self.strategy, self._dirty = rows, config, next_id, strategy, False


def create_database(spark: SparkSession, dimension: int | DatabaseConfig, index_type: IndexType | str = IndexType.AUTO, metric: DistanceMetric | str = DistanceMetric.L2, backend: str = "native", algorithm: str | None = None, **params: object) -> VectorDatabase | AnnAdapter:
    """A collection, or with an ``anns`` backend an adapter around one strategy."""
    if backend.lower() in ("cpp", "native"):
        if isinstance(dimension, DatabaseConfig):
            return VectorDatabase(spark, dimension)
        kind = index_type if isinstance(index_type, IndexType) else parse_index_type(index_type)
        return VectorDatabase(spark, DatabaseConfig(dimension=dimension, index_type=kind, metric=parse_metric(metric), algorithm=algorithm or "brute_force", build_params=params))
    if backend.lower() in ("anns", "ann"):
        if not algorithm:
            raise ValueError("this backend needs an algorithm")
        return AnnAdapter(spark, int(dimension), algorithm, parse_metric(metric), **params)
    raise ValueError(f"unknown backend: {backend}")


class AnnAdapter:
    """One strategy with ids from 0 and metadata kept as strings."""

    def __init__(self, spark: SparkSession, dimension: int, algorithm: str, metric: DistanceMetric = DistanceMetric.L2, **params: object) -> None:
        self.db = VectorDatabase(spark, DatabaseConfig(dimension=dimension, metric=metric, algorithm=algorithm, build_params=params), id_base=0)

    @staticmethod
    def _strings(metadata: Sequence[dict] | None) -> list[Metadata] | None:
        return [{str(k): str(v) for k, v in m.items()} for m in metadata] if metadata is not None else None

    def _rows(self, vectors: object) -> np.ndarray:
        out = np.asarray(vectors, dtype=np.float32)
        out = out[None, :] if out.ndim == 1 else out
        if out.ndim != 2 or out.shape[1] != self.db.dimension():
            raise ValueError(f"expected vectors of dimension {self.db.dimension()}")
        return out

    def build_index(self, vectors: object, metadata: Sequence[dict] | None = None) -> None:
        """Replace everything by these rows."""
        self.db.replace_all(self._rows(vectors), self._strings(metadata))
        self.db.build_index()

    def add(self, vector: object, metadata: dict | None = None) -> int:
        return self.db.add_batch(self._rows(vector), self._strings([metadata or {}]))[0]

    def add_batch(self, vectors: object, metadata: Sequence[dict] | None = None) -> list[int]:
        return self.db.add_batch(self._rows(vectors), self._strings(metadata))

    def _params(self, k: int, include_metadata: bool, given: dict[str, object]) -> SearchParams:
        """A search's own parameters, by their names or the strategies' names for them."""
        names = {"nprobe": "nprobe", "efSearch": "ef_search", "ef_search": "ef_search", "radius": "radius"}
        if unknown := set(given) - set(names):
            raise VectorEngineError(f"unknown search parameters: {sorted(unknown)}")
        return SearchParams(k=k, include_metadata=include_metadata, **{names[n]: v for n, v in given.items()})

    def search(self, query: object, k: int = 10, include_metadata: bool = True, **params: object) -> DataFrame:
        return self.db.search(self._rows(query)[0], self._params(k, include_metadata, params))

    def batch_search(self, queries: object, k: int = 10, include_metadata: bool = True, **params: object) -> DataFrame:
        return self.db.batch_search(self._rows(queries), self._params(k, include_metadata, params))

    def save(self, path: str) -> None:
        self.db.save(path)

    def load(self, path: str) -> None:
        """Take over a stored collection of the same dimension, metric and algorithm; nothing changes otherwise."""
        rows, config, next_id, _ = snapshots.load(self.db.spark, path)
        own = self.db.config()
        if config.dimension != own.dimension or config.metric != own.metric:
            raise ValueError("the stored collection has another dimension or metric")
        if registry.factory(config.algorithm) is not registry.factory(own.algorithm):
            raise ValueError(f"the stored collection is for {config.algorithm}")
        if next_id < self.db.id_base or (last := rows.agg(F.max("id")).first()[0]) is not None and last >= next_id:
            raise ValueError("the stored collection's next id is in use")
        self.db.load(path)


class StringIdBridge:
    """A collection addressed by string ids, kept in a reserved metadata key."""

    KEY = "__str_id__"

    def __init__(self, db: VectorDatabase) -> None:
        self.db = db

    def add(self, ids: Sequence[str], vectors: Sequence[Sequence[float]], metadata: Sequence[dict] | None = None) -> None:
        """Insert, or replace what has the same id; of a repeated id the last counts. Nothing changes where any row is bad."""
        fields = list(metadata or [{}] * len(ids))
        if not len(ids) == len(vectors) == len(fields):
            raise ValueError("ids, vectors and metadata must be of one length")
        last = list({i: p for p, i in enumerate(ids)}.values())
        own = [{str(k): str(v) for k, v in fields[p].items()} | {self.KEY: ids[p]} for p in last]
        start = self.db.next_id
        new, numbers = self.db._new_rows([vectors[p] for p in last], own, start)
        self.delete(ids)
        if new is not None:
            self.db._take_in(new, start + len(numbers))

    def _known(self, ids: Sequence[str]) -> DataFrame:
        return M.with_metadata(self.db.rows).filter(F.element_at("metadata", self.KEY).isin(list(ids))).select("id")

    def delete(self, ids: Sequence[str]) -> bool:
        found = [r.id for r in self._known(ids).collect()]
        if found:
            self.db._become(mutate.remove(self.db.rows, self.db._ids(found)))
        return bool(found)

    def clear(self) -> None:
        self.db.clear()
        self.db.next_id = self.db.id_base

    def query(self, vector: Sequence[float] | None = None, filter_metadata: dict | None = None, top_k: int = 10) -> DataFrame:
        """The nearest rows, filtered afterwards; without a vector a scan in order of insertion."""
        own = F.element_at("metadata", self.KEY).alias("str_id")
        if vector is None:
            found = M.scan(self.db.rows.filter(F.col("vector").isNotNull()), filter_metadata or {}, top_k)
            return found.select(own, F.map_filter("metadata", lambda k, v: k != self.KEY).alias("metadata"))
        k = min(top_k, max(self.db.size(), 1))
        found = self.db.search(vector, k).filter(M.matches(filter_metadata or {}))
        return found.select(own, "score", F.map_filter("metadata", lambda k, v: k != self.KEY).alias("metadata"))

    def get_all_ids(self) -> list[str]:
        return [r.str_id for r in self.db.rows.filter(F.col("vector").isNotNull()).orderBy("id").select(F.element_at("metadata", self.KEY).alias("str_id")).collect()]

    def count(self) -> int:
        return self.db.size()


class MultimodalDatabase(VectorDatabase):
    """A collection whose vectors are fused from several modalities' embeddings."""

    def __init__(self, spark: SparkSession, config: DatabaseConfig, fusion: FusionParams | None = None, max_modalities: int = 5) -> None:
        if max_modalities <= 0:
            raise MultimodalError("at least one modality must be allowed")
        super().__init__(spark, config)
        self.fusion, self.max_modalities = fusion or FusionParams(), max_modalities
        self.engine, self.processors = FusionEngine(), ProcessorRegistry()

    def _fused(self, embeddings: dict[Modality, Sequence[float]], params: FusionParams) -> list[float]:
        if not embeddings:
            raise MultimodalError("no modalities")
        if len(embeddings) > self.max_modalities:
            raise MultimodalError("too many modalities")
        if any(not len(e) for e in embeddings.values()):
            raise MultimodalError("empty embedding")
        column = self.engine.fuse({m: V.literal(e) for m, e in embeddings.items()}, params, {m: len(e) for m, e in embeddings.items()})
        return list(self.spark.range(1).select(column.alias("v")).first().v)

    def add_multimodal(self, embeddings: dict[Modality, Sequence[float]], metadata: Metadata | None = None) -> int:
        return self.add(self._fused(embeddings, self.fusion), metadata)

    def add_multimodal_dataframe(self, rows: DataFrame, columns: dict[Modality, str], order: str, lengths: dict[Modality, int], metadata: Column | None = None) -> None:
        """Fuse and append any number of rows."""
        if not columns or len(columns) > self.max_modalities:
            raise MultimodalError("too few or too many modalities")
        self.add_dataframe(self.engine.batch_fuse(rows, columns, self.fusion, lengths, "fused_"), order, "fused_", metadata)

    def search_multimodal(self, embeddings: dict[Modality, Sequence[float]], k: int = 10, params: FusionParams | None = None, include_metadata: bool = True) -> DataFrame:
        """A query's own fusion settings count only if they name another strategy."""
        use = params if params and params.strategy is not self.fusion.strategy else self.fusion
        return self.search(self._fused(embeddings, use), k, include_metadata)

    def update_fusion_params(self, params: FusionParams) -> None:
        self.fusion = params

    def get_fusion_params(self) -> FusionParams:
        return self.fusion

    def register_fusion_strategy(self, kind: Fusion | str, strategy) -> None:  # noqa: ANN001
        self.engine.register(kind, strategy)

    def register_modality_processor(self, kind: Modality | str, processor) -> None:  # noqa: ANN001
        self.processors.register(kind, processor)

    def get_supported_modalities(self) -> list[Modality | str]:
        return list(self.processors.processors)

    def get_supported_strategies(self) -> list[Fusion | str]:
        return self.engine.supported()


def create_text_image_db(spark: SparkSession, dimension: int) -> MultimodalDatabase:
    weights = {Modality.TEXT: 0.6, Modality.IMAGE: 0.4}
    return MultimodalDatabase(spark, DatabaseConfig(dimension=dimension), FusionParams(Fusion.WEIGHTED_AVERAGE, weights, dimension), 2)


def create_audio_visual_db(spark: SparkSession, dimension: int) -> MultimodalDatabase:
    return MultimodalDatabase(spark, DatabaseConfig(dimension=dimension), FusionParams(Fusion.ATTENTION_BASED, {}, dimension), 2)


__all__ = ["AnnAdapter", "DatabaseConfig", "MultimodalDatabase", "Params", "StringIdBridge", "VectorDatabase", "create_audio_visual_db", "create_database", "create_text_image_db"]
