"""Fusion of the embeddings of several modalities into one vector.

Strategies build column expressions from a mapping of modalities to vector columns.
Modalities always come in the order of the enumeration.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverine.config import Fusion, FusionParams, Modality
from quiverine.errors import MultimodalError, VectorEngineError
from quiverine.functions import vectors as V

#: The dimension that tensor and bilinear fusion are made for (fixed value).
OWN_DIMENSION = 512

Embeddings = dict[Modality, Column]
#: How long each modality's vectors are, where that is known; expressions are simpler then.
Lengths = dict[Modality, int]
Strategy = Callable[[Embeddings, FusionParams, Lengths], Column]


def _ordered(embeddings: Embeddings) -> list[tuple[Modality, Column]]:
    return sorted(embeddings.items())


def _target(embeddings: Embeddings, params: FusionParams, lengths: Lengths) -> int:
    """The dimension to align to: the given one, or that of the first modality."""
    first = min(embeddings)
    dim = params.target_dimension or lengths.get(first, 0)
    if not dim:
        raise MultimodalError("give a target dimension or the length of the first modality's vectors")
    return dim


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = F.zip_with(out, t, lambda a, b: a + b)
    return out


def _scaled(v: Column, by: Column | float) -> Column:
    return F.transform(v, lambda x: x * by)


def concatenation(embeddings: Embeddings, params: FusionParams, lengths: Lengths) -> Column:
    joined = F.concat(*[V.doubles(e) for _, e in _ordered(embeddings)])
    if not params.target_dimension:
        return joined
    n = sum(lengths[m] for m in embeddings) if all(m in lengths for m in embeddings) else None
    return V.aligned(joined, params.target_dimension, n)


def weighted_average(embeddings: Embeddings, params: FusionParams, lengths: Lengths) -> Column:
    dim = _target(embeddings, params, lengths)
    weights = [params.weights.get(m, 1.0) for m, _ in _ordered(embeddings)]
    summed = _sum([_scaled(V.aligned(e, dim, lengths.get(m)), w) for (m, e), w in zip(_ordered(embeddings), weights, strict=True)])
    return F.transform(summed, lambda x: x / sum(weights)) if sum(weights) > 0 else summed


def attention(embeddings: Embeddings, params: FusionParams, lengths: Lengths) -> Column:
    """Weights are the cosines with the mean vector, where positive, brought to a sum of 1."""
    dim = _target(embeddings, params, lengths)
    own = _ordered(embeddings)

    def by_share(heeded: Column, whole: Column) -> Column:
        shares = [F.when(whole > 0, heeded[i] / F.nullif(whole, F.lit(0.0))).otherwise(0.0) for i in range(len(own))]
        return _sum([_scaled(V.aligned(e, dim, lengths.get(m)), s) for (m, e), s in zip(own, shares, strict=True)])

    def by_context(context: Column) -> Column:
        heeded = F.array(*[F.greatest(F.lit(0.0), V.cosine_similarity(e, context)) for _, e in own])
        return V.let(heeded, lambda h: V.let(V.total(h), lambda whole: by_share(h, whole)))

    return V.let(V.average([e for _, e in own]), by_context)


def _outer(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def tensor(embeddings: Embeddings, params: FusionParams, lengths: Lengths) -> Column:
    """Outer products, one modality after another; projected if they come out longer than the target."""
    (m, out), *rest = _ordered(embeddings)
    if not rest:
        return V.aligned(out, OWN_DIMENSION, lengths.get(m))
    out, n = V.doubles(out), lengths.get(m)
    for m, e in rest:
        out = _outer(out, V.doubles(e))
        n = n * lengths[m] if n and m in lengths else None
    if n is None:
        raise MultimodalError("tensor fusion needs the lengths of all vectors")
    dim = params.target_dimension or OWN_DIMENSION
    return out if n <= dim else V.projected([e for _, e in _ordered(embeddings)], n, dim)


def bilinear(embeddings: Embeddings, params: FusionParams, lengths: Lengths) -> Column:
    """Products by component on the shortest length, aligned to the target."""
    (m, out), *rest = _ordered(embeddings)
    if not rest:
        return V.aligned(out, OWN_DIMENSION, lengths.get(m))
    out, n = V.doubles(out), lengths.get(m)
    for m, e in rest:
        short = F.greatest(F.least(F.size(out), F.size(e)), F.lit(0))
        out = F.zip_with(F.slice(out, F.lit(1), short), F.slice(V.doubles(e), F.lit(1), short), lambda a, b: a * b)
        n = min(n, lengths[m]) if n and m in lengths else None
    return V.aligned(out, params.target_dimension or OWN_DIMENSION, n)


#: Another name of the same pooling.
compact_bilinear = bilinear


def create_strategy(kind: Fusion) -> Strategy:
    """The strategy of a kind; the transformer and custom kinds have none of their own."""
    known: dict[Fusion, Strategy] = {
        Fusion.CONCATENATION: concatenation, Fusion.WEIGHTED_AVERAGE: weighted_average, Fusion.ATTENTION_BASED: attention,
        Fusion.TENSOR_FUSION: tensor, Fusion.BILINEAR_POOLING: bilinear,
    }
    if kind not in known:
        raise VectorEngineError(f"no built-in fusion strategy: {kind.value}")
    return known[kind]


class FusionEngine:
    """Registered strategies. Bilinear pooling can be created, but isn't registered from the start."""

    def __init__(self) -> None:
        self.strategies: dict[Fusion | str, Strategy] = {
            k: create_strategy(k) for k in (Fusion.CONCATENATION, Fusion.WEIGHTED_AVERAGE, Fusion.ATTENTION_BASED, Fusion.TENSOR_FUSION)
        }

    def register(self, kind: Fusion | str, strategy: Strategy) -> None:
        self.strategies[kind] = strategy

    def supported(self) -> list[Fusion | str]:
        return list(self.strategies)

    def fuse(self, embeddings: Embeddings, params: FusionParams | None = None, lengths: Lengths | None = None) -> Column:
        params = params or FusionParams()
        if not embeddings:
            raise MultimodalError("no embeddings")
        if params.strategy not in self.strategies:
            raise MultimodalError(f"fusion strategy isn't registered: {params.strategy.value}")
        return self.strategies[params.strategy](embeddings, params, lengths or {})

    def batch_fuse(self, rows: DataFrame, columns: dict[Modality, str], params: FusionParams | None = None, lengths: Lengths | None = None, to: str = "fused") -> DataFrame:
        return rows.withColumn(to, self.fuse({m: F.col(c) for m, c in columns.items()}, params, lengths))
