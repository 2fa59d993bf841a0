"""The database API, fusion, processors, indexes, persistence and streams on small fixtures."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverine.collection import AnnAdapter, MultimodalDatabase, StringIdBridge, VectorDatabase, create_audio_visual_db, create_database, create_text_image_db
from quiverine.config import DatabaseConfig, DistanceMetric, Fusion, FusionParams, IndexType, Modality, Params, SearchParams, parse_index_type, parse_metric, string_to_index_type
from quiverine.errors import CapabilityError, MultimodalError, VectorEngineError
from quiverine.functions import vectors as V
from quiverine.operators import search
from quiverine.operators.index import automatic, list_algorithms, registry
from quiverine.operators.processors import ProcessorRegistry, audio, image, tabular, text, timeseries
from quiverine.plans import queries
from quiverine.sources import binary
from quiverine.streaming import ingest

L2, IP, COSINE = DistanceMetric.L2, DistanceMetric.INNER_PRODUCT, DistanceMetric.COSINE


def database(spark, vectors, metadata=None, metric=L2, **config):
    db = VectorDatabase(spark, DatabaseConfig(dimension=len(vectors[0]), metric=metric, **config))
    db.add_batch(vectors, metadata)
    return db


def found(rows):
    return [(r.id, round(r.score, 6)) for r in rows.collect()]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_basic_search(spark):
    db = database(spark, [[0.1] * 8, [0.2] * 8, [0.3] * 8], [{"category": c} for c in "ABA"])
    rows = db.search([0.1] * 8, 2).collect()
    assert [r.id for r in rows] == [1, 2] and rows[0].metadata == {"category": "A"} and rows[0].score == 0
    assert db.size() == 3 and db.is_trained()
    assert [r.id for r in db.find_by_metadata("category", "A").orderBy("id").collect()] == [1, 3]


def test_range_keeps_its_border(spark):
    db = database(spark, [[0, 0], [3, 4], [6, 8]])
    assert sorted(found(db.search([0, 0], SearchParams(radius=5)))) == [(1, 0.0), (2, 5.0)]
    assert sorted(found(db.range_search([0, 0], 5))) == [(1, 0.0), (2, 5.0)]


def test_metrics(spark):
    assert found(database(spark, [[1, 0], [2, 0], [-1, 0]], metric=IP).search([1, 0], 3)) == [(2, 2.0), (1, 1.0), (3, -1.0)]
    assert found(database(spark, [[0, 0], [1, 1]], metric=COSINE).search([1, 0], 2)) == [(2, round(1 - math.sqrt(0.5), 6)), (1, 1.0)]


def test_hybrid_and_rerank(spark):
    db = database(spark, [[1.0], [1.2]], [{"t": "none"}, {"t": "a hit"}])
    assert found(db.hybrid_search([0.0], "hit", SearchParams(k=2))) == [(2, 0.588), (1, 0.7)]
    db = database(spark, [[1.0], [2.0]], [{"s": "10"}, {"s": "0"}])
    assert found(db.search_with_rerank([0.0], lambda m: F.element_at(m, "s").cast("double"))) == [(2, 1.4), (1, 3.7)]


def test_filtered_over_fetch(spark):
    db = database(spark, [[float(i)] for i in range(1, 26)], [{"m": "1" if i == 25 else "0"} for i in range(1, 26)])
    hit = F.element_at("metadata", "m") == "1"
    assert found(db.filtered_search([0.0], hit, SearchParams(k=2))) == []
    assert found(db.filtered_search([0.0], hit, SearchParams(k=2), "exact")) == [(25, 25.0)]
    assert found(db.filtered_search([0.0], lambda m: m["m"] == "1", SearchParams(k=2), "exact")) == [(25, 25.0)]
    again = db.search_with_rerank([0.0], search.ranking([0.0], lambda q, m: -100 * int(m["m"])), SearchParams(k=1))
    assert found(again) == [(25, round(0.7 * 25 - 30, 6))]


def test_batch_is_a_loop_of_singles_and_cells_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    db = database(spark, rng.random((40, 4)).tolist())
    asked = rng.random((7, 4)).astype(np.float32)
    single = [(i, *x) for i, q in enumerate(asked.tolist()) for x in found(db.search(q, 3))]
    batch = lambda: sorted([(r.query_id, r.rank, r.id, round(r.score, 6)) for r in db.batch_search(asked, SearchParams(k=3)).collect()])
    once = batch()
    assert [(q, i, s) for q, _, i, s in once] == single
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 3)
    assert batch() == once


def test_changes(spark):
    db = database(spark, [[1, 0], [0, 1]], [{"a": "1"}, {}])
    assert db.get_metadata(2) is None and db.has_metadata(1)
    assert db.update(1, [5, 5]) and db.update(2, metadata={"b": "2"}) and db.update(99, metadata={"c": "3"})
    assert not db.update(77, [1, 1])
    assert db.get_metadata(99) == {"c": "3"} and db.size() == 2
    assert db.remove(1) and not db.remove(1) and not db.remove(99)
    assert db.add([2, 2]) == 3
    db.set_batch_metadata([3, 3], [{"x": "1"}, {"x": "2"}])
    assert db.get_batch_metadata([3, 50, 3]) == [{"x": "2"}, {}, {"x": "2"}]
    assert db.filter_ids([3, 2, 3], F.element_at("metadata", "x") == "2") == [3, 3]
    assert db.get_all_keys() == ["b", "x"] and db.remove_metadata(3) and db.metadata_size() == 1


def test_bad_input_changes_nothing(spark):
    db = database(spark, [[1, 0]])
    for call in (
        lambda: db.add([1, 2, 3]), lambda: db.add([float("nan"), 0]), lambda: db.add([1, 1], {"k" * 300: "v"}),
        lambda: db.add_batch([[1, 1]], [{}, {}]), lambda: db.search([1]), lambda: VectorDatabase(spark, DatabaseConfig()), lambda: db.load("/nowhere/at/all"),
        lambda: create_database(spark, 4, algorithm="definitely_unknown"), lambda: string_to_index_type("NOPE"), lambda: db.add_numpy(np.zeros(3)),
    ):
        with pytest.raises(VectorEngineError):
            call()
    assert db.size() == 1 and db.next_id == 2
    with pytest.raises(ValueError, match="backend"):
        create_database(spark, 4, backend="other")


def test_save_and_load(spark, tmp_path):
    rng = np.random.default_rng(29)
    db = database(spark, rng.random((20, 8)).tolist(), [{"i": str(i), "empty": "", "odd": '"\n'} for i in range(20)], COSINE)
    db.remove(20)
    q = rng.random(8).tolist()
    for _ in range(2):
        db.save(str(tmp_path / "c"))
    again = VectorDatabase(spark, DatabaseConfig(dimension=4))
    again.load(str(tmp_path / "c"))
    assert again.dimension() == 8 and again.config().metric is COSINE and again.is_trained()
    assert found(again.search(q, 5)) == found(db.search(q, 5)) and again.get_metadata(3) == db.get_metadata(3)
    assert again.add([0.5] * 8) == 21


def test_bulk_ids_follow_the_order(spark):
    db = VectorDatabase(spark, DatabaseConfig(dimension=1))
    new = spark.range(100).select((99 - F.col("id")).alias("o"), F.array(F.col("id").cast("float")).alias("v"))
    db.add_dataframe(new, "o", "v")
    assert [(r.id, r.vector[0]) for r in db.rows.orderBy("id").collect()] == [(i + 1, 99 - i) for i in range(100)]
    assert db.next_id == 101


def test_adapter_and_bridge(spark, tmp_path):
    own = create_database(spark, 4, backend="anns", algorithm="brute_force")
    assert isinstance(own, AnnAdapter) and own.add_batch(np.eye(4)) == [0, 1, 2, 3]
    assert own.add(np.ones(4), {"row": 1, "active": False}) == 4 and own.db.get_metadata(4) == {"row": "1", "active": "False"}
    own.save(str(tmp_path / "a"))
    with pytest.raises(ValueError, match="dimension"):
        AnnAdapter(spark, 5, "flat").load(str(tmp_path / "a"))
    own.build_index(np.eye(4)[:2])
    assert own.db.size() == 2 and own.batch_search(np.eye(4)[0], 1).first().id == 0
    b = StringIdBridge(VectorDatabase(spark, DatabaseConfig(dimension=2)))
    b.add(["x", "y"], [[0, 0], [1, 1]], [{"c": 1}, {"c": 2}])
    b.add(["x"], [[2, 2]])
    assert b.count() == 2 and b.get_all_ids() == ["y", "x"]
    assert [r.str_id for r in b.query([2, 2], top_k=1).collect()] == ["x"]
    assert [r.str_id for r in b.query(filter_metadata={"c": "None"}).collect()] == ["x"] and b.delete(["x"]) and not b.delete(["x"])


@pytest.mark.parametrize(("name", "least"), [("ivf_flat", 0.6), ("ivf_pq", 0.6), ("lsh", 0.5)])
def test_approximate_recall(spark, name, least):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((8, 16)), 30, 0) + 0.3 * rng.standard_normal((240, 16))
    exact = database(spark, x.tolist())
    near = database(spark, x.tolist(), algorithm=name, build_params={"nlist": 8, "nprobe": 4, "nbits": 5, "bits": 1} if name != "lsh" else {"bits": 1})
    hits = [len({r[0] for r in found(exact.search(x[i], 10))} & {r[0] for r in found(near.search(x[i], 10))}) for i in (0, 50, 100, 200)]
    assert sum(hits) / 40 >= least
    everything = near.search(x[0], SearchParams(k=10, nprobe=8))
    if name == "ivf_flat":
        assert found(everything) == found(exact.search(x[0], 10))


@pytest.mark.parametrize(("name", "params"), [("ivf_flat", {"nlist": 16}), ("ivf_flat", {}), ("ivf_pq", {"nlist": 16, "m": 16, "nbits": 6}), ("ivf_pq", {}), ("lsh", {}), ("hnsw", {})])
def test_recall_on_embeddings(spark, name, params):
    """100 queries, as the registered index queries ask, against brute force over the whole table."""
    rows = queries.collection(spark, "/root/testdata/sf0.1")
    found = rows.select("id", "vector").orderBy("id").toPandas()
    assert found.id.tolist() == list(range(len(found)))
    x = np.stack(found.vector).astype(float)
    strategy = registry.create(name, L2, params)
    strategy.fit(rows)
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    got = {(r.query_id, r.id) for r in strategy.query_batch(asked, SearchParams(k=10, include_metadata=False), 64).collect()}
    want = {(i, int(j)) for i in range(0, len(x), 20) for j in np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:10]}
    assert len(want) == 1000 and len(got & want) / len(want) >= 0.9
    single = [r.id for r in strategy.query(x[0].tolist(), SearchParams(k=10)).collect()]
    assert set(single) == {j for i, j in got if i == 0}
    plan = strategy.query(x[0].tolist(), SearchParams(k=10))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("metric", [L2, IP, COSINE])
def test_default_lists_reach_recall_on_uniform_vectors(spark, metric):
    x = np.random.default_rng(2).standard_normal((4000, 64)).astype("float32").astype(float)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vector array<float>").withColumn("metadata", F.lit(None).cast("map<string,string>")).cache()
    strategy = registry.create("ivf_flat", metric)
    strategy.fit(rows)
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    got = {(r.query_id, r.id) for r in strategy.query_batch(asked, SearchParams(k=10), 64).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = {L2: -((x * x).sum(1)) + 2 * x[::20] @ x.T, IP: x[::20] @ x.T, COSINE: unit[::20] @ unit.T}[metric]
    want = {(20 * i, int(j)) for i, row in enumerate(np.argsort(-score, 1)[:, :10]) for j in row}
    assert len(got & want) / len(want) >= 0.9 and strategy.probes(SearchParams(k=10)) < len(strategy.centres)
    assert strategy.probes(SearchParams(k=10, nprobe=3)) == 3


@pytest.mark.parametrize(("name", "params"), [("ivf_pq", {"nlist": 4, "nprobe": 2, "m": 2, "nbits": 2, "refine": 1}), ("lsh", {"tables": 2, "bits": 8, "width": 3.0})])
@pytest.mark.parametrize("metric", [L2, COSINE])
def test_batches_use_the_method(spark, name, params, metric):
    """A batch finds what its queries find one by one, with settings so coarse that exact search finds others."""
    x = np.random.default_rng(3).standard_normal((200, 8)).astype("float32").astype(float) * (3 if metric is L2 else 1)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vector array<float>").withColumn("metadata", F.lit(None).cast("map<string,string>")).cache()
    strategy, exact = registry.create(name, metric, params), registry.create("flat", metric)
    strategy.fit(rows)
    exact.fit(rows)
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    by_query = lambda s: sorted((r.query_id, r.id) for r in s.query_batch(asked, SearchParams(k=10), 8).collect())
    single = sorted((i, row[0]) for i in range(0, 200, 50) for row in found(strategy.query(x[i].tolist(), SearchParams(k=10))))
    assert by_query(strategy) == single != by_query(exact)


@pytest.mark.parametrize(("name", "params"), [("ivf_flat", {"nlist": 4}), ("ivf_pq", {"nlist": 4, "m": 4, "nbits": 4}), ("lsh", {"tables": 4}), ("hnsw", {"nlist": 4, "efSearch": 30})])
def test_indexes_are_saved_with_their_collections(spark, tmp_path, monkeypatch, name, params):
    x = np.random.default_rng(5).standard_normal((120, 8)).astype("float32").astype(float)
    db = database(spark, x.tolist(), [{"n": str(i)} for i in range(120)], algorithm=name, build_params=params)
    db.build_index()
    for i in range(3):
        db.add((x[i] + 0.001).tolist(), {"n": "new"})
    before = found(db.search(x[0], 8))
    db.save(str(tmp_path / "c"))
    again = VectorDatabase(spark, DatabaseConfig(dimension=2))
    monkeypatch.setattr(type(db.strategy), "fit", lambda *a: pytest.fail("fitted anew"))
    again.load(str(tmp_path / "c"))
    assert again.is_trained() and found(again.search(x[0], 8)) == before and again.strategy.stats()["rows"] == 123 and again.strategy.stats()["bytes"] > 0
    assert {r.id for r in again.search((x[0] + 0.001).tolist(), 2).collect()} == {1, 121}
    other = registry.create("lsh" if name != "lsh" else "ivf_flat", L2)
    with pytest.raises(VectorEngineError, match="stored index"):
        other.load(spark, str(tmp_path / "c" / "index-1"))


def test_lists_out_of_reach_are_not_read(spark):
    """A range through the index finds what exact search finds, and leaves lists out; also among rows added later."""
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((8, 8)) * 5, 20, 0) + 0.1 * rng.standard_normal((160, 8))
    for metric, radius in ((L2, 1.0), (COSINE, 0.01)):
        near = database(spark, x.tolist(), metric=metric, algorithm="ivf_flat", build_params={"nlist": 8})
        near.build_index()
        near.add((x[0] * 1.01).tolist())
        exact = search.in_range(near.rows, near._vector(x[0]), radius, metric)
        assert sorted(found(near.range_search(x[0], radius))) == sorted(found(exact)) and (161, 0) in {(i, 0) for i, _ in found(exact)}
        assert near.strategy.reach(near._vector(x[0]), radius).count() < 100


def test_composite_searches_go_through_the_index(spark):
    x = np.random.default_rng(7).standard_normal((100, 4)).tolist()
    meta = [{"m": str(i % 4), "t": "hit" if i % 3 == 0 else ""} for i in range(100)]
    few = {"algorithm": "ivf_flat", "build_params": {"nlist": 10}, "query_params": {"nprobe": 1}}
    near, exact = database(spark, x, meta, **few), database(spark, x, meta)
    inside = near._fresh().candidates(near._vector(x[0]), SearchParams(k=5)).count()
    assert 0 < inside < 60 and near.strategy.probes(SearchParams(k=5)) == 1
    p = SearchParams(k=5)
    assert near.filtered_search(x[0], F.element_at("metadata", "m") == "1", p).count() <= 5
    told = near.get_last_search_stats()
    assert (told.total_candidates, told.final_results) == (min(inside, 50), min(told.filtered_candidates, 5)) and told.filtered_candidates < told.total_candidates
    near.hybrid_search(x[0], "hit", p)
    assert near.get_last_search_stats().total_candidates == min(inside, 10)
    near.search_with_rerank(x[0], lambda m: F.length(F.element_at(m, "t")), p)
    assert near.get_last_search_stats().total_candidates == inside
    exact.filtered_search(x[0], F.element_at("metadata", "m") == "1", p, "exact")
    told = exact.get_last_search_stats()
    assert (told.total_candidates, told.filtered_candidates, told.final_results) == (100, 25, 5)
    wide = SearchParams(k=5, nprobe=10)
    assert found(near.hybrid_search(x[0], "hit", wide)) == found(exact.hybrid_search(x[0], "hit", p))
    batch = lambda db, q: sorted((r.query_id, r.id) for r in db.batch_filtered_search(spark.createDataFrame([(i, v) for i, v in enumerate(x[:4])], "query_id long, vector array<float>"), F.element_at("metadata", "m") == "1", q).collect())
    assert batch(near, wide) == batch(exact, p)


def test_failed_changes_lose_nothing(spark, tmp_path):
    b = StringIdBridge(VectorDatabase(spark, DatabaseConfig(dimension=2)))
    b.add(["x", "y", "x"], [[0, 0], [1, 1], [5, 5]], [{}, {}, {"c": 1}])
    own = create_database(spark, 2, backend="anns", algorithm="ivf_flat", nlist=2)
    own.build_index([[0, 0], [1, 1]], [{"a": 1}, {"a": 2}])
    state = lambda db: (sorted((r.id, r.vector, r.metadata) for r in db.rows.collect()), db.next_id)
    kept = state(b.db), state(own.db), found(own.search([0, 0], 2))
    lsh = create_database(spark, 2, backend="anns", algorithm="lsh")
    lsh.build_index([[0, 0]])
    lsh.save(str(tmp_path / "lsh"))
    for call in (
        lambda: b.add(["x"], [[1, 2, 3]]), lambda: b.add(["y"], [[1, 2]], [{"k" * 300: 1}]), lambda: own.build_index([[0, 0], [1, 1]], [{}]),
        lambda: own.build_index([[0, 0, 0]]), lambda: own.load(str(tmp_path / "lsh")), lambda: own.load(str(tmp_path / "nowhere")), lambda: own.search([0, 0], 1, unheard=1),
    ):
        with pytest.raises((ValueError, VectorEngineError)):
            call()
    assert kept == (state(b.db), state(own.db), found(own.search([0, 0], 2))) and b.get_all_ids() == ["x", "y"]
    assert own.batch_search([[0, 0]], 1, include_metadata=False, nprobe=2).first().metadata is None and own.search([0, 0], 2, efSearch=10).count() == 2
    b.db.clear_metadata()
    assert b.db.size() == 2 and b.db.metadata_size() == 0


def test_strategy_by_size(spark):
    rows = database(spark, np.random.default_rng(0).random((30, 4)).tolist()).rows
    for params, chosen in (({}, "brute_force"), ({"auto_threshold_ivf": 20}, "ivf_flat"), ({"index_type": "ivfpq", "m": 2, "nbits": 2}, "ivf_pq"), ({"index_type": "?"}, "brute_force")):
        own = registry.create("by_size", L2, params)
        own.fit(rows)
        assert own.stats()["chosen"] == chosen and own.query([0.5] * 4, SearchParams(k=3)).count() == 3


def test_matrices_find_what_expressions_find(spark):
    """Also with zero vectors, ties, and queries in several blocks."""
    x = np.random.default_rng(4).integers(-2, 3, (300, 3)).astype(float)
    rows = database(spark, x.tolist()).rows.repartition(5)
    asked = [x[i].tolist() for i in (0, 1, 2)] + [[0.0, 0.0, 0.0]]
    for metric in (L2, IP, COSINE):
        got = sorted((r.query_id, r["rank"], r.id, r.score) for r in search.best_rows(rows, spark.createDataFrame(list(enumerate(asked)), "query_id long, vector array<float>"), 7, metric).collect())
        want = [(i, n + 1, r.id, r.score) for i, q in enumerate(asked) for n, r in enumerate(search.knn(rows, q, 7, metric).collect())]
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-15)


def test_registry():
    assert {"brute_force", "flat", "ivf_flat", "ivf_pq", "hnsw", "lsh"} <= set(list_algorithms())
    assert "lsh" not in registry.supporting(IP) and automatic(10) == "brute_force" and automatic(60_000) == "ivf_flat"
    with pytest.raises(CapabilityError):
        registry.create("lsh", IP)
    with pytest.raises(VectorEngineError):
        registry.register("FLAT", lambda *a: None)
    assert parse_index_type("ivf-flat") is IndexType.IVF_FLAT and parse_index_type("?") is IndexType.AUTO and parse_metric(1) is IP
    assert Params({"a": "yes", "n": 3}).flag("a", False) and Params({"n": 3}).integer("n", 0) == 3


def test_vector_functions(spark):
    a = V.literal([1, 2, 3, 4])
    assert value(spark, V.aligned(a, 2)) == value(spark, V.aligned(a, 2, 4)) == [1.5, 3.5]
    assert value(spark, V.aligned(V.literal([1, 2, 3]), 5)) == [1, 2, 3, 0, 0] and value(spark, V.resized(a, 2)) == [1, 2]
    assert value(spark, V.average([V.literal([1, 2, 3]), V.literal([4, 5, 6])]))[0] == 2.5
    assert value(spark, V.cosine_similarity(a, V.literal([1]))) == 0 and value(spark, V.euclidean(a, V.literal([1]))) == V.FLOAT_MAX
    assert value(spark, V.normalized(V.literal([0, 0]))) == [0, 0]


def test_fusion(spark):
    both = {Modality.TEXT: [1, 2, 3], Modality.IMAGE: [4, 5, 6]}
    own = MultimodalDatabase(spark, DatabaseConfig(dimension=3))
    fuse = lambda kind, target=0: own._fused(both, FusionParams(kind, FusionParams().weights, target))
    assert fuse(Fusion.CONCATENATION) == [1, 2, 3, 4, 5, 6]
    assert np.allclose(fuse(Fusion.WEIGHTED_AVERAGE), [16 / 7, 23 / 7, 30 / 7])
    assert fuse(Fusion.TENSOR_FUSION) == [4, 5, 6, 8, 10, 12, 12, 15, 18] and len(fuse(Fusion.ATTENTION_BASED)) == 3
    with pytest.raises(MultimodalError):
        fuse(Fusion.BILINEAR_POOLING)
    from quiverine.operators.fusion import create_strategy

    own.register_fusion_strategy(Fusion.BILINEAR_POOLING, create_strategy(Fusion.BILINEAR_POOLING))
    assert fuse(Fusion.BILINEAR_POOLING, 3) == [4, 10, 18]
    with pytest.raises(VectorEngineError):
        create_strategy(Fusion.CROSS_MODAL_TRANSFORMER)
    for bad in ({}, {Modality.TEXT: []}):
        with pytest.raises(MultimodalError):
            own.add_multimodal(bad)


def test_multimodal_search(spark):
    db = create_text_image_db(spark, 4)
    db.add_multimodal({Modality.TEXT: [1] * 4, Modality.IMAGE: [0] * 4}, {"label": "item1"})
    db.add_multimodal({Modality.TEXT: [0] * 4, Modality.IMAGE: [1] * 4}, {"label": "item2"})
    rows = db.search_multimodal({Modality.TEXT: [1] * 4, Modality.IMAGE: [0] * 4}, 1).collect()
    assert rows[0].metadata["label"] == "item1" and create_audio_visual_db(spark, 8).max_modalities == 2
    with pytest.raises(MultimodalError):
        db.add_multimodal({m: [1.0] for m in (Modality.TEXT, Modality.IMAGE, Modality.AUDIO)})


def test_text_processor(spark):
    assert value(spark, text.tokens(F.lit("Hello_World extraordinarily 42"))) == ["hello_world", "extrao", "rdinar", "ily", "42"]
    v = value(spark, text.embedding(F.lit("a b a"), 16))
    assert len(v) == 16 and abs(sum(x * x for x in v) - 1) < 1e-9 and value(spark, text.embedding(F.lit("!!"), 4)) == [0, 0, 0, 0]
    ok = lambda s: value(spark, text.is_valid(F.lit(s)))
    assert ok("abc") and not ok("") and not ok("éé") and not ok("é1")


def test_buckets_equal_the_expressions(spark):
    said = ["Hello_World extraordinarily 42", "", None, "É and é, ABC abc 0123456789abcdef", "!!", "a " * 500]
    docs = spark.createDataFrame(list(enumerate(said)), "i int, t string")
    token = docs.select("i", F.explode(text.tokens(F.col("t"))).alias("token"))
    sums = token.groupBy("i", text.bucket(F.col("token"), 50).alias("bucket")).agg(F.sum(1.0 + 0.1 * F.length("token")).alias("w")).collect()
    size = {i: math.sqrt(sum(r.w**2 for r in sums if r.i == i)) for i in range(len(said))}
    got = {(r.i, r.bucket): r.weight for r in text.weighted_buckets(docs, "i", "t", 50).collect()}
    assert got == pytest.approx({(r.i, r.bucket): r.w / size[r.i] for r in sums}) and len(got) > 5
    dense = [r.v for r in docs.select(text.embedding(F.col("t"), 50).alias("v")).collect()]
    assert dense[2] is None and not any(dense[1]) and all(dense[i][b] == pytest.approx(w) for (i, b), w in got.items())


def test_series_processor(spark):
    s = F.array(*[F.lit(float(i)) for i in range(60)])
    assert value(spark, timeseries.trend(s)) == 1 and len(value(spark, timeseries.window_means(s))) == 2
    assert value(spark, timeseries.trend(F.array(F.lit(1.0)))) is None
    v = timeseries.encode(b"1,2,x,4,\n5")
    assert len(v) == 128 and abs((v * v).sum() - 1) < 1e-9 and list(timeseries.parse(struct.pack("<3f", 1, 2, 3))) == [1, 2, 3]


def test_tabular_processor():
    assert tabular.split_line('a,"b,c",d\r') == ["a", "b,c", "d"]
    v = tabular.encode(b"n,t\n1,x\n3,y\n")
    assert len(v) == 256 and np.allclose(v[:4] / v[0], [1, 0.5, 0.5, 1.5])
    assert tabular.kind_of(["a"] * 8 + ["b"] * 8) == "categorical" and tabular.kind_of(["a", "b"]) == "text"


def test_audio_and_image_processors(spark):
    samples = (np.sin(np.arange(4000) / 5) * 20000).astype("<i2").tobytes()
    wav = b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(samples)) + samples
    v = audio.encode(wav)
    assert len(v) == 512 and abs((v * v).sum() - 1) < 1e-9
    for bad in (b"x" * 50, b"", wav[:20]):
        with pytest.raises(ValueError, match="WAV"):
            audio.decode(bad)
    assert np.allclose(audio.decode(wav), np.frombuffer(samples, "<i2") / 32768)
    rows = b"".join(b"\0" + bytes([10, 20, 30] * 4) for _ in range(4))
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert image.decode(png)[0, 0].tolist() == [30, 20, 10]
    want = np.random.default_rng(1).integers(0, 256, (5, 7, 3))
    flat, lines = np.zeros((6, 24), np.int64), []
    flat[1:, 3:] = want.reshape(5, 21)
    for y in range(1, 6):
        left, up, corner = flat[y, :-3], flat[y - 1, 3:], flat[y - 1, :-3]
        guess = left + up - corner
        near = np.stack([left, up, corner])
        paeth = near[np.abs(guess - near).argmin(0), np.arange(21)]
        lines.append(bytes([y - 1]) + ((flat[y, 3:] - [np.zeros(21, np.int64), left, up, (left + up) // 2, paeth][y - 1]) % 256).astype(np.uint8).tobytes())
    ruled = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (image.decode(ruled) == want[:, :, ::-1]).all()
    told = spark.createDataFrame([(bytearray(p),) for p in (png, wav, b"\xff\xd8\xff\xe0", b"II*\0", b"xx")], "raw binary").select(image.sniffed(F.col("raw")).alias("f"))
    assert [r.f for r in told.collect()] == ["png", "riff", "jpg", "tiff", None]
    v = image.encode(png)
    assert len(v) == 2048 and np.count_nonzero(v[:96]) == 3 and len(image.encode_video([png] * 3)) == 1024
    own = ProcessorRegistry()
    assert len(spark.createDataFrame([(bytearray(png),)], "raw binary").select(own.process(Modality.IMAGE, F.col("raw")).alias("v")).first().v) == 2048
    with pytest.raises(VectorEngineError):
        own.process("unknown", F.lit(b""))


def test_binary_import(spark, tmp_path):
    base = tmp_path / "x"
    (tmp_path / "x.vectors").write_bytes(binary.write(np.array([1, 5]), np.array([[1, 2], [3, 4]], np.float32), 6))
    (tmp_path / "x.metadata").write_text('{\n  "5": {\n    "a": "b c",\n    "gone": "",\n    "cut": "x"y"\n  },\n  "9": {\n    "k": "v"\n  }\n}\n')
    assert sorted((r.id, r.vector) for r in binary.read(spark, f"{base}.vectors").collect()) == [(1, [1, 2]), (5, [3, 4])]
    rows, config = binary.read_collection(spark, str(base))
    assert config.dimension == 2 and config.index_type is IndexType.AUTO
    assert {r.id: (r.vector, r.metadata) for r in rows.collect()} == {1: ([1, 2], None), 5: ([3, 4], {"a": "b c", "cut": "x"}), 9: (None, {"k": "v"})}
    (tmp_path / "x.config").write_text("dimension=2\nindex_type=0\nmetric=2\nM=7\n")
    _, config = binary.read_collection(spark, str(base))
    assert config.metric is COSINE and config.index_type is IndexType.FLAT and config.M == 7
    db = VectorDatabase.from_dataframe(rows, config, metadata=F.col("metadata"))
    assert db.size() == 2 and db.get_metadata(9) == {"k": "v"} and db.next_id == 10


def test_stream(spark, tmp_path):
    spark.range(10).select("id", F.array(F.lit(1.0).cast("float")).alias("vector"), F.lit(None).cast("map<string,string>").alias("metadata")).write.parquet(str(tmp_path / "in"))
    schema = "id long, vector array<float>, metadata map<string,string>"
    ingest.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), 1).awaitTermination()
    assert ingest.collection(spark, str(tmp_path / "out")).count() == 10


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 10


def plain_collection(spark, x):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, vector array<float>")
    return rows.withColumn("metadata", F.lit(None).cast("map<string,string>")).cache()


def batch_and_rows(strategy, asked, k, monkeypatch):
    """What a batch finds, and how many pairs go on to the ranking."""
    ranked, n = search.ranked, []
    with monkeypatch.context() as m:
        m.setattr(search, "ranked", lambda found, *a: n.append(found.count()) or ranked(found, *a))
        got = [(r.query_id, r.rank, r.id, round(r.score, 9)) for r in strategy.query_batch(asked, SearchParams(k=k, include_metadata=False)).orderBy("query_id", "rank").collect()]
    return got, sum(n)


def singly(strategy, asked, k):
    return [(q.query_id, i + 1, r.id, round(r.score, 9)) for q in sorted(asked.collect()) for i, r in enumerate(strategy.query(list(q.vector), SearchParams(k=k)).collect())]


@pytest.mark.parametrize(("name", "params"), [("ivf_flat", {"nlist": 4, "nprobe": 4}), ("ivf_pq", {"nlist": 4, "nprobe": 4, "m": 4, "nbits": 3, "refine": 1_000_000})])
def test_pairs_of_lists_are_no_rows(spark, monkeypatch, name, params):
    """A batch equals exact search through all lists, and at most ``k`` rows of a query leave each task."""
    x = np.random.default_rng(7).integers(-3, 4, (4000, 8)).astype(float).tolist()
    rows = plain_collection(spark, x)
    strategy, exact = registry.create(name, L2, params), registry.create("flat", L2)
    strategy.fit(rows)
    exact.fit(rows)
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    got, pairs = batch_and_rows(strategy, asked, 2, monkeypatch)
    assert got == batch_and_rows(exact, asked, 2, monkeypatch)[0] and len(got) == 400 and pairs < 4000 * 200 / 8
    assert got[:20] == singly(strategy, asked.filter("query_id < 200"), 2)


@pytest.mark.parametrize("metric", [L2, IP, COSINE])
def test_batches_by_codes_are_cut_where_single_searches_are(spark, monkeypatch, metric):
    """Also among equal codes and copies of vectors, with queries whose lists are refined whole, and in several blocks."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.standard_normal((900, 8)), np.repeat(rng.standard_normal((3, 8)), 200, 0), rng.standard_normal((20, 8)) * 0.01 + 9]).astype("float32").tolist()
    rows = plain_collection(spark, x)
    asked = rows.filter("id % 100 = 0 or id > 1518").select(F.col("id").alias("query_id"), "vector")
    for refine in (1, 9, 60):
        strategy = registry.create("ivf_pq", metric, {"nlist": 6, "nprobe": 3, "m": 4, "nbits": 3, "refine": refine})
        strategy.fit(rows)
        with monkeypatch.context() as m:
            m.setattr(search, "BROADCAST_QUERIES", 10)
            got, pairs = batch_and_rows(strategy, asked, 5, monkeypatch)
        assert got == singly(strategy, asked, 5) and pairs > 0


def test_vectors_that_are_not_finite_hide_no_others(spark):
    nan, inf = float("nan"), float("inf")
    x = [[float(i), 1.0] for i in range(30)] + [[nan, 0.0], [inf, 0.0], [3.0, nan]]
    rows = plain_collection(spark, x)
    asked = spark.createDataFrame([(0, [3.0, 1.0]), (1, [20.0, 1.0]), (2, None)], "query_id long, vector array<float>")
    for name, metric in (("flat", L2), ("ivf_flat", L2), ("flat", IP), ("flat", COSINE)):
        strategy = registry.create(name, metric, {"nlist": 1} if name != "flat" else {})
        strategy.fit(rows, np.asarray(x[:30]))
        got = [(r.query_id, r.rank, r.id) for r in strategy.query_batch(asked, SearchParams(k=4)).orderBy("query_id", "rank").collect()]
        assert got == [r[:3] for r in singly(strategy, asked.filter("query_id < 2"), 4)] and len(got) == 8


def test_pairs_of_buckets_are_no_rows(spark, monkeypatch):
    """A batch equals exact search where all rows share a bucket, and at most ``k`` rows of a query leave each task."""
    rows = plain_collection(spark, np.random.default_rng(7).integers(-3, 4, (4000, 8)).astype(float).tolist())
    strategy, exact = registry.create("lsh", L2, {"width": 1e6}), registry.create("flat", L2)
    strategy.fit(rows)
    exact.fit(rows)
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    got, _ = batch_and_rows(strategy, asked, 2, monkeypatch)
    assert got == batch_and_rows(exact, asked, 2, monkeypatch)[0] and len(got) == 400
    plan = strategy.query_batch(asked, SearchParams(k=2, include_metadata=False))._jdf.queryExecution().toString()
    assert "Join" not in plan and "Generate" not in plan


@pytest.mark.parametrize("metric", [L2, COSINE])
def test_batches_by_buckets_of_all_sizes_are_loops_of_singles(spark, monkeypatch, metric):
    """Large and small buckets, each pair once, copies of vectors, several blocks of queries and pieces of pairs."""
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.standard_normal((700, 6)) * 3, np.repeat(rng.standard_normal((3, 6)), 150, 0)]).astype("float32").tolist()
    rows = plain_collection(spark, x)
    asked = rows.filter("id % 25 = 0").select(F.col("id").alias("query_id"), "vector")
    for tables, bits, width in ((6, 1, 1.0), (3, 4, 0.5), (5, 2, 4.0)):
        strategy = registry.create("lsh", metric, {"tables": tables, "bits": bits, "width": width})
        strategy.fit(rows)
        with monkeypatch.context() as m:
            m.setattr(search, "BROADCAST_QUERIES", 30)
            got, _ = batch_and_rows(strategy, asked, 5, monkeypatch)
        assert got == singly(strategy, asked, 5)


def test_pairs_of_buckets_are_complete():
    """Large and small buckets together give each pair that shares one, once."""
    from quiverine.operators import index

    rng = np.random.default_rng(17)
    mine, theirs = rng.integers(0, 60, 300) ** 2 // 40, rng.integers(5, 70, 2000) ** 2 // 40
    order = np.argsort(mine, kind="stable")
    large = [(i, j) for own, at in index.large_buckets(mine[order], order, theirs) for i in own for j in at]
    small = [(i, j) for own, at in index.small_buckets(mine[order], order, theirs) for i, j in zip(own, at, strict=True)]
    want = {(i, j) for i, j in zip(*np.nonzero(mine[:, None] == theirs[None, :]), strict=True)}
    assert large and small and len(large) + len(small) == len(want) and {*large, *small} == want
