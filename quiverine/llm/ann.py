"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts that few of its edges
cross. A small classifier learns the parts of a vector's neighbours, so that it tells
for any vector how likely each part holds them. Every row is indexed in its likeliest
part; a query goes to its likeliest parts until their probabilities add up to a share,
and all rows of those parts are scored exactly, by inner products in double precision.

The number of parts grows with the square root of the rows. The share is measured when
the model is fitted: it is what RECALL takes for rows that the model hasn't seen, at any
size. Where vectors lie in clusters, that is few parts; where they are uniform, as no
partition separates them, it is most. A query goes on to further parts only while those
it has hold fewer rows than it asks for.

Parts of any size are dealt out in cells of bounded size: a cell holds some of a part's
rows and some of the queries that go there, and meets them as one matrix product.

Defined results: vectors that are null, zero, of another length than most, or with
null or non-finite components take no part, neither as queries nor as candidates, nor
do rows with a null id; of rows that repeat an id the one with the smallest vector
counts; ties go to the smaller id; a query gets all candidates where there are fewer
than asked for; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ship

#: Rows that the graph and the classifier are fitted on, at most: those with the smallest hashes of their ids.
FIT_ROWS = 8192
#: One in so many of these isn't learned from; the share of probability that queries visit is measured on them.
HELD_OUT = 16
#: The part of a query's neighbours that its parts are to hold, as measured.
RECALL = 0.95
#: Parts at most, so that the model that goes to every task is bounded.
MOST_PARTS = 1024
#: Rows and queries that meet in a cell, about.
CELL_ROWS, CELL_QUERIES = 32_768, 16_384
#: Sums of products in another order may differ by so much, for each unit of the norms' product.
ROUNDING = 1e-12


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's ``k`` neighbours of largest inner product."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        near = x[at : at + 1024] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at : at + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def parts_for(rows: int) -> int:
    """A power of two near a quarter of the square root of the rows."""
    return min(1 << round(np.log2(max(np.sqrt(rows) / 4, 1))), MOST_PARTS)


def halves(graph: np.ndarray, inside: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Two halves of some nodes, as a mask, with few edges between them.

    A slowly mixing vector of the graph's random walk orders the nodes; its median
    parts them. Then pairs of nodes change sides while that saves edges.
    """
    n = len(inside)
    place = np.full(len(graph), -1)
    place[inside] = np.arange(n)
    to = place[graph[inside]]
    a, b = np.nonzero(to >= 0)[0], to[to >= 0]
    pull = lambda v: np.bincount(a, v[b], n) + np.bincount(b, v[a], n)
    degree = pull(np.ones(n)) + 1e-9
    v = rng.standard_normal(n)
    for _ in range(60):
        v -= (v * degree).sum() / degree.sum()
        v = (v + pull(v) / degree) / 2
        v /= np.linalg.norm(v) or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(10):
        gain = -pull(np.where(side, 1.0, -1.0)) * np.where(side, 1, -1)
        up, down = (np.flatnonzero(s)[np.argsort(-gain[s], kind="stable")] for s in (side, ~side))
        pairs = min(len(up), len(down))
        change = int(((gain[up[:pairs]] + gain[down[:pairs]]) > 0).sum()) // 2
        if not change:
            break
        side[up[:change]], side[down[:change]] = False, True
    return side


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """The part of each node; parts are a power of two and differ by a row or so in size."""
    out = np.zeros(len(graph), np.int64)
    size = parts
    while size > 1:
        for p in range(0, parts, size):
            inside = np.flatnonzero(out == p)
            if len(inside) > 1:
                out[inside[halves(graph, inside, rng)]] = p + size // 2
        size //= 2
    return out


@dataclass
class Router:
    """A classifier with one hidden layer: how likely each part holds a vector's neighbours."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]

    @staticmethod
    def fit(x: np.ndarray, parts: int, neighbours: int = 16, hidden: int = 64, rounds: int = 30, seed: int = 7) -> Router:
        rng = np.random.default_rng(seed)
        n, d = x.shape
        graph = neighbour_graph(x, neighbours) if n > 1 else np.zeros((n, 0), np.int64)
        part = balanced_parts(graph, parts, rng)
        # What is learned: the parts of a row's neighbours, and a little its own.
        wanted = np.zeros((n, parts))
        np.add.at(wanted, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1.0)
        wanted[np.arange(n), part] += neighbours / 4
        wanted /= wanted.sum(1, keepdims=True)
        scale = x.std(0)
        own = Router(x.mean(0), np.where(scale > 0, scale, 1.0), [rng.standard_normal((d, hidden)) / np.sqrt(d), np.zeros(hidden), rng.standard_normal((hidden, parts)) * 0.05, np.zeros(parts)])
        first, second = ([np.zeros_like(w) for w in own.layers] for _ in range(2))
        step = 0
        for _ in range(rounds):
            order = rng.permutation(n)
            for at in range(0, n, 256):
                rows = order[at : at + 256]
                z, h, p = own._forward(x[rows])
                error = (p - wanted[rows]) / len(rows)
                back = error @ own.layers[2].T * (h > 0)
                step += 1
                for i, g in enumerate((z.T @ back + 1e-4 * own.layers[0], back.sum(0), h.T @ error + 1e-4 * own.layers[2], error.sum(0))):
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.001 * (g * g - second[i])
                    own.layers[i] -= 0.003 * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        return own

    @staticmethod
    def measured(x: np.ndarray, parts: int, k: int) -> tuple[Router, float]:
        """A classifier, and the share of probability that holds RECALL of the ``k`` neighbours of rows it hasn't seen."""
        held = np.arange(len(x)) % HELD_OUT == HELD_OUT - 1
        known, asked = x[~held], x[held]
        router = Router.fit(known, parts)
        if not len(asked) or parts == 1:
            return router, 1.0
        part = router.probabilities(known).argmax(1)
        p = router.probabilities(asked)
        near = asked @ known.T
        own = part[np.argsort(-near, axis=1, kind="stable")[:, :k]]
        order = np.argsort(-p, axis=1, kind="stable")
        sorted_ = np.take_along_axis(p, order, 1)
        before = np.empty_like(p)
        np.put_along_axis(before, order, np.cumsum(sorted_, 1) - sorted_, 1)
        # A part is visited while the likelier ones add up to less than the share.
        needed = np.sort(np.take_along_axis(before, own, 1), axis=None)
        return router, float(needed[int(np.ceil(RECALL * len(needed))) - 1]) + 1e-9

    def visits(self, x: np.ndarray, share: float, held: np.ndarray, least: int) -> list[np.ndarray]:
        """The parts that each query goes to: by probability up to a share, and until they hold ``least`` rows."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        sorted_ = np.take_along_axis(p, order, 1)
        before, rows = np.cumsum(sorted_, 1) - sorted_, np.cumsum(held[order], 1) - held[order]
        wide = ((before < share) | (rows < least)).sum(1)
        return [order[i, : wide[i]].astype(np.int32) for i in range(len(x))]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = (x - self.mean) / self.scale
        h = np.maximum(z @ self.layers[0] + self.layers[1], 0)
        s = h @ self.layers[2] + self.layers[3]
        e = np.exp(s - s.max(1, keepdims=True))
        return z, h, e / e.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[2]


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, vector of doubles) of the rows that take part, and their length."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("vector")).filter(
        F.col("vec_id").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("vector", lambda v: v != 0)
    )
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    length = lengths[0]["length"] if lengths else 0
    rows = rows.filter(F.size("vector") == length)
    if rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return rows, length


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the query, row id, score) of each query's ``k`` best rows but its own; exact, ties to smaller ids.

    A matrix product finds which rows can be among the best; their scores are then
    added up component by component from the left, so that they don't depend on how
    rows are dealt.
    """
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    bound = np.sqrt((rows**2).sum(1).max()) if len(rows) else 0.0
    for at in range(0, len(queries), 128):
        q, ids = queries[at : at + 128], query_ids[at : at + 128]
        near = q @ rows.T
        near[row_ids[None, :] == ids[:, None]] = -np.inf
        if len(rows) > k:
            least = np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k]
            least = least - 2 * ROUNDING * bound * np.sqrt((q**2).sum(1))
        else:
            least = np.full(len(q), -np.inf)
        i, j = np.nonzero((near >= least[:, None]) & (near > -np.inf))
        score = np.zeros(len(i))
        for d in range(q.shape[1]):
            score += q[i, d] * rows[j, d]
        best = np.lexsort((row_ids[j], -score, i))
        i, j, score = i[best], j[best], score[best]
        first = np.searchsorted(i, np.arange(len(q)))
        keep = np.arange(len(i)) - first[i] < k
        out.append((i[keep] + at, row_ids[j[keep]], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # type: ignore[return-value]


def search(table: DataFrame, k: int = 20, every: int = 20, parts: int | None = None, share: float | None = None, fit_rows: int = FIT_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found for each row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = table.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ann")
    valid, length = valid_vectors(table, id_col, vector_col)
    rows = scratch.table(valid, "vectors")
    # fit_rows rows at most come to the driver, and a model of bounded size goes out.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).toArrow()
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = parts or parts_for(total)
    router, measured = Router.measured(_matrix(sample["vector"], length), parts, k)
    share = measured if share is None else share

    def assign(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            part = router.probabilities(_matrix(batch.column("vector"), length)).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=["vec_id", "vector", "part"])

    routed = scratch.table(rows.mapInArrow(assign, "vec_id long, vector array<double>, part int"), "routed")
    # A number for each part.
    in_parts = np.zeros(parts, np.int64)
    for r in routed.groupBy("part").count().collect():
        in_parts[r["part"]] = r["count"]

    def ask(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            visits = router.visits(_matrix(batch.column("vector"), length), share, in_parts, k + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(visits, pa.list_(pa.int32()))], names=["vec_id", "vector", "probes"])

    queries_ = routed.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "vector")
    asked = scratch.table(queries_.mapInArrow(ask, "vec_id long, vector array<double>, probes array<int>"), "asked")
    asked = asked.select("vec_id", "vector", F.explode("probes").alias("part"))
    # A row for each part: how many cells its rows and its queries are dealt to.
    held = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("row_cells"))
    wanted = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("int").alias("query_cells"))
    grid = F.broadcast(held.join(wanted, "part"))
    cell = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["part", "row_cell", "query_cell"]
    candidates = routed.join(grid, "part").select("part", cell("row_cells").alias("row_cell"), "query_cells", "vec_id", "vector").withColumn("query_cell", spread("query_cells"))
    queries = asked.join(grid, "part").select("part", cell("query_cells").alias("query_cell"), "row_cells", "vec_id", "vector").withColumn("row_cell", spread("row_cells"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, r_ids = left["q_vec_id"].to_numpy(), right["r_vec_id"].to_numpy()
        i, ids, score = nearest(_matrix(left["q_vector"], length), q_ids, _matrix(right["r_vector"], length), r_ids, k)
        return pa.table({"query_id": q_ids[i], "vec_id": ids, "score": score})

    found = (
        queries.select(*[F.col(c).alias(f"q_{c}") for c in (*key, "vec_id", "vector")]).groupBy(*[f"q_{c}" for c in key])
        .cogroup(candidates.select(*[F.col(c).alias(f"r_{c}") for c in (*key, "vec_id", "vector")]).groupBy(*[f"r_{c}" for c in key]))
        .applyInArrow(meet, "query_id long, vec_id long, score double")
    )
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
