"""Enumerations and settings."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum, IntEnum

from .errors import VectorEngineError


class IndexType(Enum):
    FLAT = "FLAT"
    IVF_FLAT = "IVF_FLAT"
    IVF_PQ = "IVF_PQ"
    HNSW = "HNSW"
    AUTO = "AUTO"


class DistanceMetric(Enum):
    L2 = "L2"
    INNER_PRODUCT = "INNER_PRODUCT"
    COSINE = "COSINE"

    @property
    def higher_is_better(self) -> bool:
        return self is DistanceMetric.INNER_PRODUCT


class Modality(IntEnum):
    """Kinds of input; their order is the order of concatenation."""

    TEXT = 0
    IMAGE = 1
    AUDIO = 2
    VIDEO = 3
    TABULAR = 4
    GRAPH = 5
    TIME_SERIES = 6
    CUSTOM = 7


class Fusion(Enum):
    CONCATENATION = "CONCATENATION"
    WEIGHTED_AVERAGE = "WEIGHTED_AVERAGE"
    ATTENTION_BASED = "ATTENTION_BASED"
    CROSS_MODAL_TRANSFORMER = "CROSS_MODAL_TRANSFORMER"
    TENSOR_FUSION = "TENSOR_FUSION"
    BILINEAR_POOLING = "BILINEAR_POOLING"
    CUSTOM = "CUSTOM"


#: Other names that parameters may use (fixed values).
INDEX_ALIASES = {"flat": "FLAT", "ivfflat": "IVF_FLAT", "ivf-flat": "IVF_FLAT", "ivf_flat": "IVF_FLAT", "ivf": "IVF_FLAT", "ivfpq": "IVF_PQ", "ivf-pq": "IVF_PQ", "ivf_pq": "IVF_PQ", "hnsw": "HNSW", "auto": "AUTO"}
METRIC_ALIASES = {"l2": "L2", "euclidean": "L2", "ip": "INNER_PRODUCT", "inner": "INNER_PRODUCT", "inner_product": "INNER_PRODUCT", "cosine": "COSINE"}


def index_type_to_string(kind: IndexType) -> str:
    return kind.value


def string_to_index_type(name: str) -> IndexType:
    """The type of that exact name; others raise."""
    try:
        return IndexType(name)
    except ValueError:
        raise VectorEngineError(f"unknown index type: {name}") from None


def distance_metric_to_string(metric: DistanceMetric) -> str:
    return metric.value


def string_to_distance_metric(name: str) -> DistanceMetric:
    try:
        return DistanceMetric(name)
    except ValueError:
        raise VectorEngineError(f"unknown distance metric: {name}") from None


def parse_index_type(name: str) -> IndexType:
    """A parameter's index type by any of its names; unknown ones mean AUTO."""
    return IndexType(INDEX_ALIASES.get(name.lower(), "AUTO"))


def parse_metric(value: str | int | DistanceMetric) -> DistanceMetric:
    """A metric by name, alias or number."""
    if isinstance(value, DistanceMetric):
        return value
    if isinstance(value, int) or str(value).isdigit():
        kinds = list(DistanceMetric)
        if int(value) < len(kinds):
            return kinds[int(value)]
    elif str(value).lower() in METRIC_ALIASES:
        return DistanceMetric(METRIC_ALIASES[str(value).lower()])
    raise VectorEngineError(f"unknown distance metric: {value}")


class Params(dict[str, str]):
    """String parameters with typed reading."""

    def __init__(self, *sources: dict[str, object] | None) -> None:
        super().__init__()
        for s in sources:
            self.update({k: str(v) for k, v in (s or {}).items()})

    def integer(self, key: str, default: int) -> int:
        return int(self[key]) if key in self else default

    def number(self, key: str, default: float) -> float:
        return float(self[key]) if key in self else default

    def flag(self, key: str, default: bool) -> bool:
        return self[key].lower() in ("1", "true", "yes") if key in self else default

    def positive(self, *keys: str) -> None:
        for k in keys:
            if k in self and self.integer(k, 1) <= 0:
                raise VectorEngineError(f"{k} must be positive")


@dataclass
class SearchParams:
    k: int = 10
    nprobe: int | None = None
    ef_search: int | None = None
    radius: float = -1.0
    include_metadata: bool = True


@dataclass
class DatabaseConfig:
    dimension: int = 0
    index_type: IndexType = IndexType.AUTO
    metric: DistanceMetric = DistanceMetric.L2
    algorithm: str = "brute_force"
    build_params: dict[str, object] = field(default_factory=dict)
    query_params: dict[str, object] = field(default_factory=dict)
    nlist: int = 100
    m: int = 8
    nbits: int = 8
    M: int = 16
    ef_construction: int = 200


@dataclass
class FusionParams:
    strategy: Fusion = Fusion.WEIGHTED_AVERAGE
    weights: dict[Modality, float] = field(default_factory=lambda: {Modality.TEXT: 0.4, Modality.IMAGE: 0.3, Modality.AUDIO: 0.2, Modality.VIDEO: 0.1})
    target_dimension: int = 0


@dataclass
class SearchStats:
    total_candidates: int = 0
    filtered_candidates: int = 0
    final_results: int = 0
    search_ms: float = 0.0
    filter_ms: float = 0.0
    total_ms: float = 0.0
