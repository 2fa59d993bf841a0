"""Every named query against its SQL, or at least its rows."""

import pytest

from quiverine.operators import search
from quiverine.plans.oracle import ORACLE_SQL
from quiverine.plans.queries import QUERIES

from .helpers import agree


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert agree(spark, sf, QUERIES[name], ORACLE_SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["batch_knn_l2", "batch_filtered_knn_compat", "ivf_all_lists"])
def test_batch_asks_for_every_twentieth_id(spark, sf, name, monkeypatch):
    """Also where the batch is too large to be broadcast."""
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 5)
    want = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 20 = 0").select("vec_id").collect()}
    assert len(want) > 10 and {r.query_id for r in QUERIES[f"{name}_every20"](spark, sf).select("query_id").distinct().collect()} == want
    assert agree(spark, sf, QUERIES[f"{name}_every20"], ORACLE_SQL[f"{name}_every20"]) > 0


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_projected_outer_products_equal_plain_ones(spark, sf):
    import numpy as np

    from quiverine.functions.vectors import projection_matrix

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    matrix = projection_matrix(32 * 32, 32)
    got = QUERIES["fuse_tensor_projected"](spark, sf).toPandas().sort_values(["vec_id", "pos"]).groupby("vec_id").val.apply(list)
    assert len(got) == len(rows)
    for r in rows.itertuples():
        v = np.array(r.embedding, float)
        plain = [sum(matrix[d, 32 * i + j] * v[i] * v[32 + j] for i in range(32) for j in range(32)) / 32 for d in (0, 31)] if r.vec_id % 50 == 0 else None
        whole = matrix @ np.kron(v[:32], v[32:]) / 32
        assert np.allclose(got[r.vec_id], whole, atol=2e-6) and (plain is None or np.allclose(plain, whole[[0, 31]]))


def test_series_embeddings_equal_plain_ones(spark, sf):
    import numpy as np

    from quiverine.operators.processors import timeseries

    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id", "value").toPandas().sort_values(["ts", "event_id"])
    got = QUERIES["ts_embedding"](spark, sf).toPandas().sort_values(["user_id", "pos"]).groupby("user_id").val.apply(list)
    want = {u: timeseries.encode(",".join(map(repr, g.value.tolist())).encode()) for u, g in events.groupby("user_id")}
    assert set(got.index) == set(want) and all(np.allclose(got[u], want[u], atol=1e-4) for u in want)
