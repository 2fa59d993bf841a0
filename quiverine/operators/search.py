"""Search: exact nearest neighbours, ranges, filters, text hits and re-ranking.

Every operator takes a collection (id, vector, metadata) and returns rows of (id,
score, metadata). Ties are ordered by id. A query given as numbers becomes part of the
expression, so that a search is one scan with a bounded top-k in each partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quiverine.config import DistanceMetric
from quiverine.errors import VectorEngineError
from quiverine.functions import vectors as V

#: Over-fetch of the composite searches (fixed values).
FILTER_FACTOR, FILTER_MOST, HYBRID_FACTOR, RERANK_K, RANGE_MOST = 10, 1000, 2, 100, 10_000
#: Queries that go to every task at once, by number and by bytes; larger batches go over the rows in several passes.
BROADCAST_QUERIES, BROADCAST_BYTES = 10_000, 32 << 20
#: Sums of products in another order may differ by so much, for each unit of the norms' product.
ROUNDING = 1e-12
#: Queries of a matrix product, and pairs that are scored exactly, at a time.
BLOCK, PAIRS = 128, 4096
#: How the over-fetched rows of a composite search are found: the best so many, as (id, score, metadata).
Find = Callable[[int], DataFrame]
#: Pairs of a batch: the query's index in its block, the row's id, the score.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Which pairs of some queries (from, to) with all rows at hand count.
Allow = Callable[[int, int], np.ndarray]
#: A pass over the rows for a block of queries, by their ids and vectors.
Pass = Callable[[pa.Array, np.ndarray], DataFrame]


def condition(predicate: Column | Callable[[dict], bool]) -> Column:
    """A predicate on ``metadata``; a Python function of a row's map becomes an Arrow function, and is the slow way."""
    if isinstance(predicate, Column):
        return predicate
    return F.udf(lambda m: bool(predicate(dict(m or {}))), "boolean", useArrow=True)(F.col("metadata"))


def ranking(query: Sequence[float], rank: Callable) -> Callable[[Column], Column]:
    """A scoring function for ``reranked`` made of a Python function of (query, a row's map)."""
    return F.udf(lambda m: float(rank(query, dict(m or {}))), "double", useArrow=True)


def best_first(metric: DistanceMetric, score: str = "score") -> list[Column]:
    return [F.desc(score) if metric.higher_is_better else F.asc(score), F.asc("id")]


def scored(rows: DataFrame, query: Sequence[float], metric: DistanceMetric) -> DataFrame:
    stored = rows.filter(F.col("vector").isNotNull())
    vector = V.checked(F.col("vector"), len(query))
    return stored.select("id", V.distance(metric, vector, query).alias("score"), "metadata")


def knn(rows: DataFrame, query: Sequence[float], k: int = 10, metric: DistanceMetric = DistanceMetric.L2) -> DataFrame:
    """The ``k`` best rows, best first."""
    if k <= 0:
        raise VectorEngineError("k must be positive")
    return scored(rows, query, metric).orderBy(*best_first(metric)).limit(k)


def in_range(rows: DataFrame, query: Sequence[float], radius: float, metric: DistanceMetric = DistanceMetric.L2, metric_aware: bool = False) -> DataFrame:
    """All rows with a score of ``radius`` at most, in no order; inner products too, unless ``metric_aware``."""
    hit = F.col("score") >= radius if metric_aware and metric.higher_is_better else F.col("score") <= radius
    return scored(rows, query, metric).filter(hit)


def candidates(rows: DataFrame, query: Sequence[float], k: int, metric: DistanceMetric, radius: float = -1.0) -> DataFrame:
    """What a composite search starts from: the best ``k``, or the whole range where a radius is given."""
    return in_range(rows, query, radius, metric) if radius > 0 else knn(rows, query, k, metric)


def range_search(rows: DataFrame, query: Sequence[float], radius: float, metric: DistanceMetric = DistanceMetric.L2, metric_aware: bool = False) -> DataFrame:
    """The range; for a radius of 0 or less, what of the best RANGE_MOST rows is within it."""
    if radius > 0:
        return in_range(rows, query, radius, metric, metric_aware)
    return knn(rows, query, RANGE_MOST, metric).filter(F.col("score") <= radius)


def filtered(rows: DataFrame, query: Sequence[float], predicate: Column | Callable[[dict], bool], k: int = 10, metric: DistanceMetric = DistanceMetric.L2, mode: str = "compat", radius: float = -1.0, find: Find | None = None) -> DataFrame:
    """The best rows that have metadata and satisfy ``predicate``, a condition on ``metadata``.

    ``compat`` filters the best 10k rows (1000 at most), and may find fewer than there
    are; ``exact`` filters before ranking.
    """
    holds = F.col("metadata").isNotNull() & condition(predicate)
    if mode == "exact":
        return knn(rows.filter(holds), query, k, metric)
    most = min(FILTER_FACTOR * k, FILTER_MOST)
    found = find(most) if find else candidates(rows, query, most, metric, radius)
    return found.filter(holds).orderBy(*best_first(metric)).limit(k)


def by_metadata(rows: DataFrame, query: Sequence[float], key: str, value: str, k: int = 10, metric: DistanceMetric = DistanceMetric.L2, mode: str = "compat", find: Find | None = None) -> DataFrame:
    return filtered(rows, query, F.element_at("metadata", key) == value, k, metric, mode, find=find)


def hybrid(rows: DataFrame, query: Sequence[float], k: int = 10, text: str = "", vector_weight: float = 0.7, text_weight: float = 0.3, metric: DistanceMetric = DistanceMetric.L2, metric_aware: bool = False, radius: float = -1.0, find: Find | None = None) -> DataFrame:
    """The best 2k rows, re-ordered by weighted scores that a text hit in any metadata value lowers.

    Without a text, the best ``k`` with their own scores. ``metric_aware`` raises hits
    and sorts downwards for inner products.
    """
    found = find(HYBRID_FACTOR * k) if find else candidates(rows, query, HYBRID_FACTOR * k, metric, radius)
    bare = F.lit(None).cast("map<string,string>").alias("metadata")
    if not text:
        return found.orderBy(*best_first(metric)).limit(k).select("id", "score", bare)
    upward = metric_aware and metric.higher_is_better
    hit = F.coalesce(F.exists(F.map_values("metadata"), lambda v: v.contains(text)), F.lit(False))
    weighted = F.col("score") * vector_weight
    better = weighted / (1 - text_weight) if upward else weighted * (1 - text_weight)
    again = found.select("id", F.when(hit, better).otherwise(weighted).alias("score"))
    return again.orderBy(F.desc("score") if upward else F.asc("score"), "id").limit(k).select("id", "score", bare)


def reranked(rows: DataFrame, query: Sequence[float], rank: Callable[[Column], Column], k: int = 10, rerank_k: int = RERANK_K, metric: DistanceMetric = DistanceMetric.L2, metric_aware: bool = False, radius: float = -1.0, find: Find | None = None) -> DataFrame:
    """The best ``rerank_k`` rows, by 0.7 of their score and 0.3 of what ``rank`` makes of their metadata."""
    found = find(rerank_k) if find else candidates(rows, query, rerank_k, metric, radius)
    metadata = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    again = found.withColumn("score", 0.7 * F.col("score") + 0.3 * rank(metadata).cast("double"))
    return again.orderBy(F.desc("score") if metric_aware and metric.higher_is_better else F.asc("score"), "id").limit(k)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(flat) and (np.diff(flat.offsets.to_numpy()) != dim).any():
        raise VectorEngineError(f"dimension mismatch: expected {dim}")
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _sums(a: np.ndarray, b: np.ndarray, term: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """A term's sum over the components of pairs of rows, from the left, as the column expressions add it up."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += term(a[:, d], b[:, d])
    return out


def exact_scores(q: np.ndarray, x: np.ndarray, metric: DistanceMetric) -> np.ndarray:
    """The score of each pair of rows."""
    product = lambda u, v: u * v
    if metric is DistanceMetric.L2:
        return np.sqrt(_sums(x, q, lambda u, v: (u - v) * (u - v)))
    dot = _sums(x, q, product)
    if metric is DistanceMetric.INNER_PRODUCT:
        return dot
    size = np.sqrt(_sums(x, x, product)) * np.sqrt(_sums(q, q, product))
    return np.where(size == 0, 1.0, 1 - dot / np.where(size == 0, 1.0, size))


def pair_scores(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, metric: DistanceMetric) -> np.ndarray:
    """The scores of pairs by index, some thousands at a time."""
    step = range(0, len(i), PAIRS)
    return np.concatenate([exact_scores(q[i[at : at + PAIRS]], x[j[at : at + PAIRS]], metric) for at in step]) if len(i) else np.zeros(0)


def best_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, metric: DistanceMetric, allow: Allow | None = None) -> Found:
    """(index of the query, row id, score) of each query's ``k`` best rows, best first, ties by id.

    A matrix product finds which rows can be among the best, within what rounding may change; their scores are then
    exact. What isn't finite is scored exactly always. ``allow`` tells which pairs count.
    """
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1.0)
    with np.errstate(invalid="ignore", over="ignore"):
        a, b = (unit(q), unit(x)) if metric is DistanceMetric.COSINE else (q, x)
        square = (b * b).sum(1)
    odd = ~np.isfinite(square)
    bound = np.sqrt(square[~odd].max(initial=0.0))
    out: list[Found] = []
    for at in range(0, len(a), BLOCK):
        own = a[at : at + BLOCK]
        allowed = allow(at, at + len(own)) if allow else None
        if allowed is not None and not allowed.any():
            continue
        with np.errstate(invalid="ignore", over="ignore"):
            near = own @ b.T
            if metric is DistanceMetric.L2:
                near = 2 * near - square
            sizes = np.sqrt((own * own).sum(1))
            near[:, odd] = -np.inf
            if allowed is not None:
                near[~allowed] = -np.inf
            if len(x) > k:
                least = np.partition(near, len(x) - k, axis=1)[:, len(x) - k] - 8 * ROUNDING * (bound * sizes + bound * bound + sizes * sizes + 1e-300)
            else:
                least = np.full(len(own), -np.inf)
            take = near >= least[:, None]
        take[:, odd] = True
        take[~np.isfinite(sizes)] = True
        if allowed is not None:
            take &= allowed
        i, j = np.nonzero(take)
        i, own_ids, score = top_rows(i, ids[j], pair_scores(q[at : at + BLOCK], x, i, j, metric), len(own), k, metric)
        out.append((i + at, own_ids, score))
    return joined(out)


def joined(parts: Sequence[Found]) -> Found:
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return tuple(np.concatenate(p) for p in zip(none, *parts, strict=True))  # type: ignore[return-value]


def top_rows(i: np.ndarray, ids: np.ndarray, score: np.ndarray, n: int, k: int, metric: DistanceMetric) -> Found:
    """What is among the ``k`` best of each of ``n`` queries, in their order; NaN is the largest score, as in Spark."""
    best = np.lexsort((ids, -score, ~np.isnan(score), i) if metric.higher_is_better else (ids, score, i))
    i, ids, score = i[best], ids[best], score[best]
    keep = np.arange(len(i)) - np.searchsorted(i, np.arange(n))[i] < k
    return i[keep], ids[keep], score[keep]


def over_rows(rows: DataFrame, columns: Sequence[str], query_ids: pa.Array, k: int, metric: DistanceMetric, find: Callable[[pa.RecordBatch], Iterable[Found]]) -> DataFrame:
    """One pass over the rows: each task keeps the best ``k`` of what ``find`` finds for each query, and passes them on at its end."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Found] = []
        for batch in batches:
            if batch.num_rows:
                held = [top_rows(*joined([*held, *find(batch)]), len(query_ids), k, metric)]
        for i, ids, score in held:
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(i)), pa.array(ids), pa.array(score)], names=["query_id", "id", "score"])

    stored = rows.filter(F.col("vector").isNotNull()).select("id", "vector", *columns)
    return stored.mapInArrow(best, "query_id long, id long, score double")


def vectors_of(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and vectors of a batch of rows."""
    return batch.column("id").to_numpy(), _matrix(batch.column("vector"), dim)


def all_rows(rows: DataFrame, k: int, metric: DistanceMetric) -> Pass:
    """A pass in which every query meets every row."""

    def one(query_ids: pa.Array, q: np.ndarray) -> DataFrame:
        def find(batch: pa.RecordBatch) -> Iterator[Found]:
            ids, x = vectors_of(batch, q.shape[1])
            yield best_of(q, x, ids, k, metric)

        return over_rows(rows, (), query_ids, k, metric, find)

    return one


def best_rows(rows: DataFrame, queries: DataFrame, k: int, metric: DistanceMetric, one: Pass | None = None) -> DataFrame:
    """The ``k`` best rows of each query (query_id, vector): query_id, rank, id, score.

    The queries come to the driver in blocks of bounded size, and each block is one pass over the rows (``one``; by
    default all rows are met): vectors meet as matrices, and k rows for each query are all that leaves a task.
    """
    if k <= 0:
        raise VectorEngineError("k must be positive")
    asked = queries.select(F.col("query_id").cast("long"), F.transform("vector", lambda v: v.cast("double")).alias("query")).filter(F.col("query").isNotNull())
    spark, found, one = rows.sparkSession, None, one or all_rows(rows, k, metric)
    blocks: list[pa.RecordBatch] = []
    held = count = 0

    def take() -> None:
        nonlocal found, held, count
        block = pa.Table.from_batches(blocks)
        new = one(pa.concat_arrays(block["query_id"].chunks), _matrix(block["query"], len(block["query"][0])))
        found = new if found is None else found.unionByName(new)
        blocks.clear()
        held = count = 0

    for r in _arrow_blocks(asked):
        blocks.append(r)
        held, count = held + r.nbytes, count + r.num_rows
        if count >= BROADCAST_QUERIES or held >= BROADCAST_BYTES:
            take()
    if blocks:
        take()
    if found is None:
        found = spark.createDataFrame([], "query_id long, id long, score double")
    return ranked(found, k, metric)


def _arrow_blocks(asked: DataFrame) -> Iterator[pa.RecordBatch]:
    """The rows of a table in blocks; the driver holds those of one partition at a time."""
    names = asked.schema
    held: list[tuple[int, list[float]]] = []
    step = max(1, min(BROADCAST_QUERIES, 4096))

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.list_(pa.float64()))], names=names.names)

    for r in asked.toLocalIterator(prefetchPartitions=True):
        held.append((r[0], r[1]))
        if len(held) >= step:
            yield block()
            held = []
    if held:
        yield block()


def described(found: DataFrame, rows: DataFrame, metadata: bool = True) -> DataFrame:
    """The results with their rows' metadata, which only the survivors of the ranking are joined to."""
    columns = ["query_id", "rank", "id", "score"]
    if not metadata:
        return found.select(*columns, F.lit(None).cast("map<string,string>").alias("metadata"))
    return found.select(*columns).join(rows.select("id", "metadata"), "id").select(*columns, "metadata")


def ranked(found: DataFrame, k: int, metric: DistanceMetric) -> DataFrame:
    """The best ``k`` of each query with their ranks; Spark keeps ``k`` of each in every partition before it shuffles."""
    over = Window.partitionBy("query_id").orderBy(*best_first(metric))
    return found.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)


def knn_batch(rows: DataFrame, queries: DataFrame, k: int = 10, metric: DistanceMetric = DistanceMetric.L2, dim: int | None = None, metadata: bool = True) -> DataFrame:
    """The ``k`` best rows of each query (query_id, vector): query_id, rank, id, score, metadata."""
    return described(best_rows(rows, queries, k, metric), rows.filter(F.col("vector").isNotNull()), metadata)


def filtered_batch(rows: DataFrame, queries: DataFrame, predicate: Column | Callable[[dict], bool], k: int = 10, metric: DistanceMetric = DistanceMetric.L2, mode: str = "compat", dim: int | None = None, find: Find | None = None) -> DataFrame:
    holds = F.col("metadata").isNotNull() & condition(predicate)
    if mode == "exact":
        return knn_batch(rows.filter(holds), queries, k, metric, dim)
    most = min(FILTER_FACTOR * k, FILTER_MOST)
    first = (find(most) if find else knn_batch(rows, queries, most, metric, dim)).drop("rank")
    return ranked(first.filter(holds), k, metric).select("query_id", "rank", "id", "score", "metadata")
