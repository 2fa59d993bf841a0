"""One named query for each operator, over whole tables.

Results hold scalars only; scores are rounded at the very end to 6 places, as sums of
floats depend on the order in which an engine adds them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quiverine.collection import VectorDatabase
from quiverine.config import DatabaseConfig, DistanceMetric, Fusion, FusionParams, Modality, SearchParams
from quiverine.functions import vectors as V
from quiverine.operators import metadata as M
from quiverine.operators import mutate, search
from quiverine.operators.fusion import FusionEngine, bilinear
from quiverine.operators.index import registry
from quiverine.operators.processors import tabular, text, timeseries
from quiverine.sources import shared

L2, IP, COSINE = DistanceMetric.L2, DistanceMetric.INNER_PRODUCT, DistanceMetric.COSINE
DIM = 64
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a collection, with metadata made of their labels and ids."""
    label = F.col("label")
    fields = F.create_map(
        F.lit("label"), label.cast("string"),
        F.lit("parity"), F.when(label % 2 == 0, "even").otherwise("odd"),
        F.lit("name"), F.concat(F.lit("item_"), F.col("vec_id").cast("string")),
    )
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), fields.alias("metadata"))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    found = table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").limit(1).collect()
    return list(found[0].embedding) if found else [0.0] * DIM


def ten_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch: the vectors with ids under 10 are its queries; it searches all rows."""
    return table(spark, sf_dir, "embeddings").filter("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def every_twentieth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of the whole job: the vectors with ids divisible by 20 are its queries; it searches all rows."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


#: Batches by the ending of a query's name; the first is what the SQL of the plain names says.
BATCHES = {"": ten_queries, "_every20": every_twentieth}


def shown(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def shown_batch(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def components(rows: DataFrame, key: str, v: str) -> DataFrame:
    """A row for each component of a vector column."""
    return rows.select(key, F.posexplode(v).alias("pos", "val")).select(key, F.col("pos").cast("int").alias("pos"), F.round("val", 6).alias("val"))


# Search

for _name, _metric in (("l2", L2), ("ip", IP), ("cosine", COSINE)):
    QUERIES[f"knn_{_name}"] = lambda s, d, m=_metric: shown(search.knn(collection(s, d), first_vector(s, d), 10, m))
    for _end, _batch in BATCHES.items():
        QUERIES[f"batch_knn_{_name}{_end}"] = lambda s, d, m=_metric, asked=_batch: shown_batch(search.knn_batch(collection(s, d), asked(s, d), 10, m, DIM))
    QUERIES[f"range_{_name}"] = lambda s, d, m=_metric: shown(search.range_search(collection(s, d), first_vector(s, d), {L2: 1.3, IP: 0.05, COSINE: 0.9}[m], m))


@query("range_nonpositive_radius")
def _(s: SparkSession, d: str) -> DataFrame:
    return shown(search.range_search(collection(s, d), first_vector(s, d), -0.1, IP))


@query("range_ip_metric_aware")
def _(s: SparkSession, d: str) -> DataFrame:
    return shown(search.range_search(collection(s, d), first_vector(s, d), 0.2, IP, metric_aware=True))


@query("filtered_knn_compat")
def _(s: SparkSession, d: str) -> DataFrame:
    return shown(search.filtered(collection(s, d), first_vector(s, d), F.element_at("metadata", "label") == "3", 10, L2))


@query("filtered_knn_exact")
def _(s: SparkSession, d: str) -> DataFrame:
    return shown(search.filtered(collection(s, d), first_vector(s, d), F.element_at("metadata", "label") == "3", 10, L2, "exact"))


@query("knn_by_metadata")
def _(s: SparkSession, d: str) -> DataFrame:
    return shown(search.by_metadata(collection(s, d), first_vector(s, d), "parity", "odd", 10, COSINE))


for _mode in ("compat", "exact"):
    for _end, _batch in BATCHES.items():
        QUERIES[f"batch_filtered_knn_{_mode}{_end}"] = lambda s, d, mode=_mode, asked=_batch: shown_batch(
            search.filtered_batch(collection(s, d), asked(s, d), F.element_at("metadata", "parity") == "even", 5, L2, mode, DIM)
        )


@query("hybrid_text")
def _(s: SparkSession, d: str) -> DataFrame:
    return shown(search.hybrid(collection(s, d), first_vector(s, d), 10, "odd", metric=L2))


@query("hybrid_empty_text")
def _(s: SparkSession, d: str) -> DataFrame:
    return shown(search.hybrid(collection(s, d), first_vector(s, d), 10, "", metric=L2))


@query("hybrid_ip_compat")
def _(s: SparkSession, d: str) -> DataFrame:
    return shown(search.hybrid(collection(s, d), first_vector(s, d), 10, "odd", metric=IP))


@query("hybrid_ip_metric_aware")
def _(s: SparkSession, d: str) -> DataFrame:
    return shown(search.hybrid(collection(s, d), first_vector(s, d), 10, "odd", metric=IP, metric_aware=True))


def _by_label(metadata: Column) -> Column:
    return F.element_at(metadata, "label").cast("double") / 10


@query("rerank_knn")
def _(s: SparkSession, d: str) -> DataFrame:
    return shown(search.reranked(collection(s, d), first_vector(s, d), _by_label, 10, 100, L2))


@query("search_stats")
def _(s: SparkSession, d: str) -> DataFrame:
    """Counts of a filtered search: what it started from, what the filter left, and its results."""
    db = VectorDatabase.from_dataframe(collection(s, d), DatabaseConfig(dimension=DIM), metadata=F.col("metadata"))
    db.filtered_search(first_vector(s, d), F.element_at("metadata", "label") == "3", SearchParams(k=10))
    told = db.get_last_search_stats()
    counts = [(told.total_candidates, told.filtered_candidates, told.final_results)]
    return s.createDataFrame(counts, "total_candidates long, filtered_candidates long, final_results long")


# Metadata


@query("find_eq")
def _(s: SparkSession, d: str) -> DataFrame:
    return M.find(collection(s, d), "label", "3").withColumnRenamed("id", "vec_id")


@query("find_prefix")
def _(s: SparkSession, d: str) -> DataFrame:
    return M.find_prefix(collection(s, d), "name", "item_1").withColumnRenamed("id", "vec_id")


@query("find_prefix_empty")
def _(s: SparkSession, d: str) -> DataFrame:
    return M.find_prefix(collection(s, d), "name", "").withColumnRenamed("id", "vec_id")


def _asked(s: SparkSession, d: str) -> DataFrame:
    """Ids with repeats and unknown ones: 3, 1, 3, and every row's own id moved by 5."""
    moved = table(s, d, "embeddings").select((F.col("vec_id") + 3).cast("int").alias("position"), (F.col("vec_id") + 5).alias("id"))
    return s.createDataFrame([(0, 3), (1, 1), (2, 3)], "position int, id long").unionByName(moved)


@query("batch_get_metadata")
def _(s: SparkSession, d: str) -> DataFrame:
    found = M.get_batch(collection(s, d), _asked(s, d))
    return found.select("position", F.col("id").alias("vec_id"), F.size("metadata").alias("fields"), F.element_at("metadata", "name").alias("name"))


@query("filter_ids")
def _(s: SparkSession, d: str) -> DataFrame:
    return M.filter_ids(collection(s, d), _asked(s, d), F.element_at("metadata", "parity") == "odd").withColumnRenamed("id", "vec_id")


@query("all_keys")
def _(s: SparkSession, d: str) -> DataFrame:
    return M.all_keys(collection(s, d))


@query("metadata_scan_limit")
def _(s: SparkSession, d: str) -> DataFrame:
    found = M.scan(collection(s, d), {"parity": "odd", "absent": None}, 10)
    return found.select(F.col("id").alias("vec_id"), F.element_at("metadata", "label").alias("label"))


@query("metadata_size")
def _(s: SparkSession, d: str) -> DataFrame:
    return M.with_metadata(collection(s, d)).agg(F.count(F.lit(1)).alias("n"))


@query("valid_metadata")
def _(s: SparkSession, d: str) -> DataFrame:
    """Documents as metadata: texts over the limit aren't valid values."""
    docs = table(s, d, "documents").select("doc_id", F.create_map(F.lit("lang"), F.col("lang"), F.lit("text"), F.col("text")).alias("metadata"))
    return docs.select("doc_id", M.is_valid(F.col("metadata")).alias("valid"))


@query("get_metadata")
def _(s: SparkSession, d: str) -> DataFrame:
    return M.get(collection(s, d), 7).select(F.col("id").alias("vec_id"), F.explode("metadata").alias("key", "value"))


# Changes


def _rows_shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("vec_id"), F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"), F.element_at("metadata", "name").alias("name"))


@query("add_batch_ids")
def _(s: SparkSession, d: str) -> DataFrame:
    """All rows appended once more, in order of their labels and ids."""
    rows = collection(s, d)
    start = rows.agg(F.max("id")).first()[0] + 1
    new = rows.withColumn("order_", F.element_at("metadata", "label").cast("long") * 1_000_000_000 + F.col("id")).withColumnRenamed("id", "old_id")
    numbered = mutate.number(new, "order_", start)
    return _rows_shown(mutate.append(rows, numbered.select("id", "vector", "metadata")))


@query("delete")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = collection(s, d)
    return _rows_shown(mutate.remove(rows, rows.filter(F.element_at("metadata", "label") == "3").select("id")))


@query("upsert")
def _(s: SparkSession, d: str) -> DataFrame:
    """Rows of label 1 get the negative vector, those of label 2 new names, and unknown ids metadata."""
    rows = collection(s, d)
    label = F.element_at("metadata", "label")
    named = F.create_map(F.lit("name"), F.concat(F.lit("new_"), F.col("id").cast("string")))
    none_v, none_m = F.lit(None).cast("array<float>"), F.lit(None).cast("map<string,string>")
    negative = rows.filter(label == "1").select("id", F.transform("vector", lambda x: -x).alias("vector"), none_m.alias("metadata"))
    renamed = rows.filter(label == "2").select("id", none_v.alias("vector"), named.alias("metadata"))
    unknown = rows.filter(label == "3").select((F.col("id") + 10_000_000).alias("id"), none_v.alias("vector"), named.alias("metadata"))
    return _rows_shown(mutate.update(rows, negative.unionByName(renamed).unionByName(unknown)))


@query("set_metadata")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = collection(s, d)
    entries = rows.filter("id % 3 = 0").select((F.col("id") * 2).alias("id"), F.create_map(F.lit("name"), F.lit("set")).alias("metadata"))
    return _rows_shown(mutate.set_metadata(rows, entries))


@query("remove_metadata")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = collection(s, d)
    return _rows_shown(mutate.remove_metadata(rows, rows.filter(F.element_at("metadata", "parity") == "odd").select("id")))


@query("save_load")
def _(s: SparkSession, d: str) -> DataFrame:
    """The collection saved and loaded again, then searched."""
    path = f"{shared.new_folder(s, 'collection')}/saved"
    config = DatabaseConfig(dimension=DIM, metric=COSINE)
    VectorDatabase.from_dataframe(collection(s, d), config, metadata=F.col("metadata")).save(path)
    again = VectorDatabase(s, DatabaseConfig(dimension=4))
    again.load(path)
    return shown(again.search(first_vector(s, d), 10))


# Vector functions and fusion


@query("normalize")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").select("vec_id", V.normalized(F.transform("embedding", lambda x: x * 3)).alias("v"))
    return components(rows, "vec_id", "v")


@query("align_shrink")
def _(s: SparkSession, d: str) -> DataFrame:
    return components(table(s, d, "embeddings").select("vec_id", V.aligned(F.col("embedding"), 16).alias("v")), "vec_id", "v")


@query("align_pad")
def _(s: SparkSession, d: str) -> DataFrame:
    return components(table(s, d, "embeddings").select("vec_id", V.aligned(F.col("embedding"), 80, DIM).alias("v")), "vec_id", "v")


@query("resize_cut")
def _(s: SparkSession, d: str) -> DataFrame:
    return components(table(s, d, "embeddings").select("vec_id", V.resized(F.col("embedding"), 20).alias("v")), "vec_id", "v")


@query("avg_pool_by_label")
def _(s: SparkSession, d: str) -> DataFrame:
    """The mean vector of each label, component by component: no task holds a label's vectors."""
    long = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "val"))
    return long.groupBy("label", F.col("pos").cast("int").alias("pos")).agg(F.round(F.avg(F.col("val").cast("double")), 6).alias("val"))


def _half(a: int) -> Column:
    return F.slice("embedding", a, 32)


@query("vector_pairs")
def _(s: SparkSession, d: str) -> DataFrame:
    """Cosine similarity and Euclidean distance of each vector's halves, and of unlike lengths."""
    return table(s, d, "embeddings").select(
        "vec_id",
        F.round(V.cosine_similarity(_half(1), _half(33)), 6).alias("cosine"),
        F.round(V.euclidean(_half(1), _half(33)), 6).alias("euclidean"),
        V.cosine_similarity(_half(1), F.col("embedding")).alias("unlike"),
    )


HALVES = {Modality.TEXT: "text_half", Modality.IMAGE: "image_half"}


def _fused(s: SparkSession, d: str, params: FusionParams, engine: FusionEngine | None = None) -> DataFrame:
    rows = table(s, d, "embeddings").select("vec_id", _half(1).alias("text_half"), _half(33).alias("image_half"))
    lengths = {Modality.TEXT: 32, Modality.IMAGE: 32}
    return components((engine or FusionEngine()).batch_fuse(rows, HALVES, params, lengths), "vec_id", "fused")


@query("fuse_concat")
def _(s: SparkSession, d: str) -> DataFrame:
    return _fused(s, d, FusionParams(Fusion.CONCATENATION, {}, 16))


@query("fuse_weighted")
def _(s: SparkSession, d: str) -> DataFrame:
    return _fused(s, d, FusionParams())


@query("fuse_attention")
def _(s: SparkSession, d: str) -> DataFrame:
    return _fused(s, d, FusionParams(Fusion.ATTENTION_BASED))


@query("fuse_bilinear")
def _(s: SparkSession, d: str) -> DataFrame:
    engine = FusionEngine()
    engine.register(Fusion.BILINEAR_POOLING, bilinear)
    return _fused(s, d, FusionParams(Fusion.BILINEAR_POOLING, {}, 40), engine)


@query("fuse_tensor_small")
def _(s: SparkSession, d: str) -> DataFrame:
    """The first two eighths of vectors, whose outer product is no longer than the target."""
    rows = table(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("text_half"), F.slice("embedding", 9, 8).alias("image_half"))
    fused = FusionEngine().batch_fuse(rows, HALVES, FusionParams(Fusion.TENSOR_FUSION), {Modality.TEXT: 8, Modality.IMAGE: 8})
    return components(fused, "vec_id", "fused")


@query("fuse_tensor_projected")
def _(s: SparkSession, d: str) -> DataFrame:
    return _fused(s, d, FusionParams(Fusion.TENSOR_FUSION, {}, 32))


@query("multimodal_search")
def _(s: SparkSession, d: str) -> DataFrame:
    """Fused halves as a collection, searched with the fused halves of the first vector."""
    rows = table(s, d, "embeddings").select("vec_id", _half(1).alias("text_half"), _half(33).alias("image_half"))
    fused = FusionEngine().batch_fuse(rows, HALVES, FusionParams(), {Modality.TEXT: 32, Modality.IMAGE: 32})
    own = fused.select(F.col("vec_id").alias("id"), F.col("fused").alias("vector"), F.lit(None).cast("map<string,string>").alias("metadata"))
    first = fused.filter("vec_id = 0").select("fused").limit(1).collect()
    return shown(search.knn(own, list(first[0].fused) if first else [0.0] * 32, 10, L2))


# Processors


@query("text_tokens")
def _(s: SparkSession, d: str) -> DataFrame:
    token = table(s, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("token"))
    return token.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("text_token_counts")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.size(text.tokens(F.coalesce("text", F.lit("")))).cast("long").alias("n_tokens"))


@query("text_embedding")
def _(s: SparkSession, d: str) -> DataFrame:
    found = text.weighted_buckets(table(s, d, "documents"), "doc_id", "text")
    return found.select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query("text_validate")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.is_valid(F.col("text").cast("binary")).alias("valid"))


@query("tabular_numeric_stats")
def _(s: SparkSession, d: str) -> DataFrame:
    found = tabular.numeric_stats(table(s, d, "customer"), "c_acctbal")
    return found.select(*[F.round(c, 4).alias(c) for c in found.columns])


@query("categorical_freq")
def _(s: SparkSession, d: str) -> DataFrame:
    found = tabular.category_histogram(table(s, d, "customer"), "c_mktsegment")
    return found.select("bucket", F.round("share", 6).alias("share"))


@query("text_column_freq")
def _(s: SparkSession, d: str) -> DataFrame:
    found = tabular.token_histogram(table(s, d, "part"), "p_name")
    return found.select("bucket", F.round("share", 6).alias("share"))


@query("column_type")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "customer")
    kinds = [tabular.column_type(rows, c) for c in ("c_custkey", "c_name", "c_mktsegment", "c_acctbal")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3])


def series(s: SparkSession, d: str) -> DataFrame:
    """The values of each user's events in order of time."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    return table(s, d, "events").groupBy("user_id").agg(F.transform(ordered, lambda x: x["value"]).alias("s"))


@query("ts_stats")
def _(s: SparkSession, d: str) -> DataFrame:
    found = series(s, d).select("user_id", timeseries.stats(F.col("s")).alias("x"))
    return found.select("user_id", *[F.round(f"x.{c}", 5).alias(c) for c in ("mean", "std", "min", "max")])


@query("ts_znorm")
def _(s: SparkSession, d: str) -> DataFrame:
    found = series(s, d).select("user_id", F.posexplode(timeseries.z_normalized(F.col("s"))).alias("pos", "val"))
    return found.select("user_id", F.col("pos").cast("int").alias("pos"), F.round("val", 5).alias("val"))


@query("ts_trend")
def _(s: SparkSession, d: str) -> DataFrame:
    return series(s, d).select("user_id", F.round(timeseries.trend(F.col("s")), 6).alias("slope"))


@query("ts_window_means")
def _(s: SparkSession, d: str) -> DataFrame:
    found = series(s, d).select("user_id", F.posexplode(timeseries.window_means(F.col("s"), 5, 3)).alias("pos", "val"))
    return found.select("user_id", F.col("pos").cast("int").alias("pos"), F.round("val", 5).alias("val"))


@query("ts_dft")
def _(s: SparkSession, d: str) -> DataFrame:
    found = series(s, d).select("user_id", F.posexplode(timeseries.frequencies(F.col("s"))).alias("pos", "val"))
    return found.select("user_id", F.col("pos").cast("int").alias("pos"), F.round("val", 4).alias("val"))


@query("ts_embedding")
def _(s: SparkSession, d: str) -> DataFrame:
    """The whole processor, over series written as text."""
    raw = series(s, d).select("user_id", F.encode(F.array_join(F.transform("s", lambda x: x.cast("string")), ","), "UTF-8").alias("raw"))
    found = raw.select("user_id", F.posexplode(timeseries.process(F.col("raw"))).alias("pos", "val"))
    return found.select("user_id", F.col("pos").cast("int").alias("pos"), F.round("val", 4).alias("val"))


# Indexes


def _strategy(s: SparkSession, d: str, name: str, **params: object):  # noqa: ANN202
    strategy = registry.create(name, L2, params)
    strategy.fit(collection(s, d))
    return strategy


def _all_lists(s: SparkSession, d: str, asked: Query) -> DataFrame:
    strategy = _strategy(s, d, "ivf_flat", nlist=16)
    return shown_batch(strategy.query_batch(asked(s, d), SearchParams(k=10, nprobe=16), DIM))


for _end, _batch in BATCHES.items():
    QUERIES[f"ivf_all_lists{_end}"] = lambda s, d, asked=_batch: _all_lists(s, d, asked)


@query("ivf_knn")
def _(s: SparkSession, d: str) -> DataFrame:
    return shown(_strategy(s, d, "ivf_flat", nlist=16).query(first_vector(s, d), SearchParams(k=10)))


@query("pq_knn")
def _(s: SparkSession, d: str) -> DataFrame:
    return shown(_strategy(s, d, "ivf_pq", nlist=16, m=16, nbits=6).query(first_vector(s, d), SearchParams(k=10, nprobe=16)))


@query("lsh_knn")
def _(s: SparkSession, d: str) -> DataFrame:
    return shown(_strategy(s, d, "lsh").query(first_vector(s, d), SearchParams(k=10)))


@query("hnsw_all_lists")
def _(s: SparkSession, d: str) -> DataFrame:
    return shown_batch(_strategy(s, d, "hnsw", nlist=16).query_batch(every_twentieth(s, d), SearchParams(k=10, nprobe=16), DIM))


@query("pq_all_refined")
def _(s: SparkSession, d: str) -> DataFrame:
    """All lists, and as many codes refined as there can be rows: what codes cut off then is nothing."""
    strategy = _strategy(s, d, "ivf_pq", nlist=16, m=16, nbits=4, refine=1_000_000)
    return shown_batch(strategy.query_batch(every_twentieth(s, d), SearchParams(k=10, nprobe=16), DIM))


@query("lsh_one_bucket")
def _(s: SparkSession, d: str) -> DataFrame:
    """Buckets so wide that all vectors share those of some table."""
    return shown_batch(_strategy(s, d, "lsh", width=1e6).query_batch(every_twentieth(s, d), SearchParams(k=10), DIM))


def _indexed(s: SparkSession, d: str, **query_params: object) -> VectorDatabase:
    config = DatabaseConfig(dimension=DIM, algorithm="ivf_flat", build_params={"nlist": 16}, query_params=query_params)
    return VectorDatabase.from_dataframe(collection(s, d), config, metadata=F.col("metadata"))


@query("ivf_range")
def _(s: SparkSession, d: str) -> DataFrame:
    """A range through the index: only lists that can't reach it are left out."""
    return shown(_indexed(s, d).range_search(first_vector(s, d), 1.3))


@query("ivf_filtered_all_lists")
def _(s: SparkSession, d: str) -> DataFrame:
    """A filtered search through the index, with all lists."""
    return shown(_indexed(s, d, nprobe=16).filtered_search(first_vector(s, d), F.element_at("metadata", "label") == "3", SearchParams(k=10)))


@query("ivf_save_load")
def _(s: SparkSession, d: str) -> DataFrame:
    """The index saved with its collection, loaded without fitting, and searched through all lists."""
    path = f"{shared.new_folder(s, 'collection')}/saved"
    own = _indexed(s, d, nprobe=16)
    own.build_index()
    own.save(path)
    again = VectorDatabase(s, DatabaseConfig(dimension=4))
    again.load(path)
    return shown(again.search(first_vector(s, d), 10))


@query("database_search")
def _(s: SparkSession, d: str) -> DataFrame:
    """The database API over the table, with the default strategy."""
    db = VectorDatabase.from_dataframe(collection(s, d), DatabaseConfig(dimension=DIM), metadata=F.col("metadata"))
    return shown(db.search(first_vector(s, d), 10))


@query("rank_within_label")
def _(s: SparkSession, d: str) -> DataFrame:
    """The three best rows of each label for the first vector."""
    found = search.scored(collection(s, d), first_vector(s, d), L2)
    label = F.element_at("metadata", "label")
    over = Window.partitionBy(label).orderBy("score", "id")
    ranked = found.select(label.alias("label"), F.row_number().over(over).alias("rank"), "id", "score").filter("rank <= 3")
    return ranked.select("label", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))
