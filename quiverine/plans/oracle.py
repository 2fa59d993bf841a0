"""The named queries as DuckDB runs them over the same tables."""

from __future__ import annotations

SCORES = {
    "l2": "list_distance({a}, {b})",
    "ip": "list_inner_product({a}, {b})",
    "cosine": "(CASE WHEN list_inner_product({a}, {a}) * list_inner_product({b}, {b}) = 0 THEN 1.0 ELSE 1 - list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b})) END)",
}
ORDER = {"l2": "ASC", "ip": "DESC", "cosine": "ASC"}

ROWS = """
e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, CAST(label AS VARCHAR) AS lab,
    CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, 'item_' || vec_id AS name
  FROM embeddings
)"""
SERIES = "ser AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS i, value AS x FROM events)"


def scored(metric: str = "l2") -> str:
    """A WITH clause of e, and s with the scores for the first vector."""
    return f"WITH {ROWS}, q AS (SELECT v AS qv FROM e WHERE vec_id = 0), s AS (SELECT e.*, {SCORES[metric].format(a='v', b='qv')} AS sc FROM e, q)"


def pairs(metric: str) -> str:
    score = SCORES[metric].format(a="e.v", b="b.v")
    return f"WITH {ROWS}, p AS (SELECT b.vec_id AS query_id, e.vec_id, e.parity, {score} AS sc FROM e, e b WHERE b.vec_id < 10)"


SHOWN = "SELECT vec_id, round(sc, 6) AS score"


def top(metric: str, k: int, source: str = "s", where: str = "true") -> str:
    return f"SELECT * FROM {source} WHERE {where} ORDER BY sc {ORDER[metric]}, vec_id LIMIT {k}"


def batch(metric: str, k: int, source: str = "p", where: str = "true") -> str:
    return (
        f"SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, round(sc, 6) AS score FROM {source} WHERE {where} "
        f"WINDOW w AS (PARTITION BY query_id ORDER BY sc {ORDER[metric]}, vec_id) QUALIFY row_number() OVER w <= {k}"
    )


ORACLE_SQL: dict[str, str] = {}

for _m in SCORES:
    ORACLE_SQL[f"knn_{_m}"] = f"{scored(_m)} {SHOWN} FROM ({top(_m, 10)})"
    ORACLE_SQL[f"batch_knn_{_m}"] = f"{pairs(_m)} {batch(_m, 10)}"
    ORACLE_SQL[f"range_{_m}"] = f"{scored(_m)} {SHOWN} FROM s WHERE sc <= { {'l2': 1.3, 'ip': 0.05, 'cosine': 0.9}[_m] }"

_asked = "asked AS (SELECT * FROM (VALUES (0, 3), (1, 1), (2, 3)) a(position, vec_id) UNION ALL SELECT CAST(vec_id + 3 AS INTEGER), vec_id + 5 FROM embeddings)"
_hybrid = "SELECT vec_id, sc * 0.7 * (CASE WHEN {hit} THEN {factor} ELSE 1 END) AS sc2 FROM ({found})"
_odd = "contains(lab, 'odd') OR contains(parity, 'odd') OR contains(name, 'odd')"
_halves = f"WITH {ROWS}, h AS (SELECT vec_id, v[1:32] AS a, v[33:64] AS b FROM e)"
_spread = "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round({value}, 6) + 0.0::DOUBLE AS val FROM {source}, range(1, {n} + 1) r(i)"
_norm = "sqrt(list_inner_product({x}, {x}))"
_cos = "list_inner_product({x}, {y}) / sqrt(list_inner_product({x}, {x}) * list_inner_product({y}, {y}))"
_bucket = "CAST(CAST('0x' || substr(md5({t}), 1, 8) AS BIGINT) % {n} AS INTEGER)"
_first = "round(CAST(embedding[1] AS DOUBLE), 6)"
_tokens = "unnest(regexp_extract_all(translate(\"text\", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+'))"
_cut = f"w AS (SELECT doc_id, {_tokens} AS t FROM documents), tok AS (SELECT doc_id, unnest(CASE WHEN length(t) > 12 THEN regexp_extract_all(t, '.{{1,6}}') ELSE [t] END) AS token FROM w)"
_kind = (
    "SELECT '{c}' AS column_name, CASE WHEN numbers >= total - numbers THEN 'numeric' WHEN kinds < least(total // 4 + 1, 50) THEN 'categorical' ELSE 'text' END AS kind "
    "FROM (SELECT count(*) FILTER (regexp_matches(CAST({c} AS VARCHAR), '^[+-]?(?:[0-9]*\\.[0-9]+|[0-9]+)$')) AS numbers, count({c}) AS total, count(DISTINCT CAST({c} AS VARCHAR)) AS kinds FROM customer)"
)

ORACLE_SQL |= {
    "range_nonpositive_radius": f"{scored('ip')} {SHOWN} FROM ({top('ip', 10000)}) WHERE sc <= -0.1",
    "range_ip_metric_aware": f"{scored('ip')} {SHOWN} FROM s WHERE sc >= 0.2",
    "filtered_knn_compat": f"{scored()} {SHOWN} FROM (SELECT * FROM ({top('l2', 100)}) WHERE lab = '3' ORDER BY sc, vec_id LIMIT 10)",
    "filtered_knn_exact": f"{scored()} {SHOWN} FROM ({top('l2', 10, where=chr(39).join(['lab = ', '3', '']))})",
    "knn_by_metadata": f"{scored('cosine')} {SHOWN} FROM (SELECT * FROM ({top('cosine', 100)}) WHERE parity = 'odd' ORDER BY sc, vec_id LIMIT 10)",
    "batch_filtered_knn_compat": f"{pairs('l2')}, f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sc, vec_id) <= 50) {batch('l2', 5, 'f', chr(39).join(['parity = ', 'even', '']))}",
    "batch_filtered_knn_exact": f"{pairs('l2')} {batch('l2', 5, 'p', chr(39).join(['parity = ', 'even', '']))}",
    "hybrid_text": f"{scored()} SELECT vec_id, round(sc2, 6) AS score FROM ({_hybrid.format(hit=_odd, factor='0.7', found=top('l2', 20))}) ORDER BY sc2, vec_id LIMIT 10",
    "hybrid_empty_text": f"{scored()} {SHOWN} FROM ({top('l2', 10)})",
    "hybrid_ip_compat": f"{scored('ip')} SELECT vec_id, round(sc2, 6) AS score FROM ({_hybrid.format(hit=_odd, factor='0.7', found=top('ip', 20))}) ORDER BY sc2, vec_id LIMIT 10",
    "hybrid_ip_metric_aware": f"{scored('ip')} SELECT vec_id, round(sc2, 6) AS score FROM ({_hybrid.format(hit=_odd, factor='1 / 0.7', found=top('ip', 20))}) ORDER BY sc2 DESC, vec_id LIMIT 10",
    "rerank_knn": f"{scored()} SELECT vec_id, round(sc2, 6) AS score FROM (SELECT vec_id, 0.7 * sc + 0.3 * (label / 10) AS sc2 FROM ({top('l2', 100)})) ORDER BY sc2, vec_id LIMIT 10",
    "search_stats": f"{scored()} SELECT count(*) AS total_candidates, count(*) FILTER (lab = '3') AS filtered_candidates, least(count(*) FILTER (lab = '3'), 10) AS final_results FROM ({top('l2', 100)})",
    "find_eq": f"WITH {ROWS} SELECT vec_id FROM e WHERE lab = '3'",
    "find_prefix": f"WITH {ROWS} SELECT vec_id FROM e WHERE starts_with(name, 'item_1')",
    "find_prefix_empty": "SELECT vec_id FROM embeddings",
    "batch_get_metadata": f"WITH {ROWS}, {_asked} SELECT position, asked.vec_id, CAST(CASE WHEN name IS NULL THEN 0 ELSE 3 END AS INTEGER) AS fields, name FROM asked LEFT JOIN e USING (vec_id)",
    "filter_ids": f"WITH {ROWS}, {_asked} SELECT position, vec_id FROM asked JOIN e USING (vec_id) WHERE parity = 'odd'",
    "all_keys": "SELECT * FROM (VALUES ('label'), ('name'), ('parity')) k(key)",
    "metadata_scan_limit": f"WITH {ROWS} SELECT vec_id, lab AS label FROM e WHERE parity = 'odd' ORDER BY vec_id LIMIT 10",
    "metadata_size": "SELECT count(*) AS n FROM embeddings",
    "valid_metadata": "SELECT doc_id, strlen(\"text\") <= 10000 AS valid FROM documents",
    "get_metadata": f"WITH {ROWS} SELECT vec_id, unnest(['label', 'parity', 'name']) AS key, unnest([lab, parity, name]) AS value FROM e WHERE vec_id = 7",
    "add_batch_ids": f"SELECT vec_id, {_first} AS first, 'item_' || vec_id AS name FROM embeddings UNION ALL SELECT (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY label, vec_id), {_first}, 'item_' || vec_id FROM embeddings",
    "delete": f"SELECT vec_id, {_first} AS first, 'item_' || vec_id AS name FROM embeddings WHERE label <> 3",
    "upsert": f"SELECT vec_id, CASE WHEN label = 1 THEN -{_first} ELSE {_first} END AS first, CASE WHEN label = 2 THEN 'new_' ELSE 'item_' END || vec_id AS name FROM embeddings UNION ALL SELECT vec_id + 10000000, NULL, 'new_' || vec_id FROM embeddings WHERE label = 3",
    "set_metadata": f"WITH n AS (SELECT vec_id * 2 AS vec_id FROM embeddings WHERE vec_id % 3 = 0) SELECT coalesce(e.vec_id, n.vec_id) AS vec_id, {_first} AS first, CASE WHEN n.vec_id IS NULL THEN 'item_' || e.vec_id ELSE 'set' END AS name FROM embeddings e FULL JOIN n ON e.vec_id = n.vec_id",
    "remove_metadata": f"SELECT vec_id, {_first} AS first, CASE WHEN label % 2 = 0 THEN 'item_' || vec_id END AS name FROM embeddings",
    "save_load": f"{scored('cosine')} {SHOWN} FROM ({top('cosine', 10)})",
    "normalize": f"WITH {ROWS} " + _spread.format(value=f"v[i] / {_norm.format(x='v')}", source="e", n=64),
    "align_shrink": f"WITH {ROWS} " + _spread.format(value="(v[4 * i - 3] + v[4 * i - 2] + v[4 * i - 1] + v[4 * i]) / 4", source="e", n=16),
    "align_pad": f"WITH {ROWS} " + _spread.format(value="CASE WHEN i <= 64 THEN v[i] ELSE 0 END", source="e", n=80),
    "resize_cut": f"WITH {ROWS} " + _spread.format(value="v[i]", source="e", n=20),
    "avg_pool_by_label": f"WITH {ROWS} SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(avg(v[i]), 6) AS val FROM e, range(1, 65) r(i) GROUP BY ALL",
    "vector_pairs": f"{_halves} SELECT vec_id, round({_cos.format(x='a', y='b')}, 6) AS cosine, round(list_distance(a, b), 6) AS euclidean, CAST(0 AS DOUBLE) AS unlike FROM h",
    "fuse_concat": f"WITH {ROWS} " + _spread.format(value="(v[4 * i - 3] + v[4 * i - 2] + v[4 * i - 1] + v[4 * i]) / 4", source="e", n=16),
    "fuse_weighted": _halves + _spread.format(value="(0.4 * a[i] + 0.3 * b[i]) / (CAST(0.4 AS DOUBLE) + 0.3)", source="h", n=32),
    "fuse_attention": f"{_halves}, c AS (SELECT *, [(a[j] + b[j]) / 2 for j in range(1, 33)] AS m FROM h), w AS (SELECT vec_id, a, b, greatest(0, {_cos.format(x='a', y='m')}) AS wa, greatest(0, {_cos.format(x='b', y='m')}) AS wb FROM c) "
    + _spread.format(value="CASE WHEN wa + wb > 0 THEN (wa * a[i] + wb * b[i]) / (wa + wb) ELSE 0 END", source="w", n=32),
    "fuse_bilinear": _halves + _spread.format(value="CASE WHEN i <= 32 THEN a[i] * b[i] ELSE 0 END", source="h", n=40),
    "fuse_tensor_small": f"WITH {ROWS} " + _spread.format(value="v[(i - 1) // 8 + 1] * v[(i - 1) % 8 + 9]", source="e", n=64),
    "multimodal_search": f"{_halves}, f AS (SELECT vec_id, [(0.4 * a[j] + 0.3 * b[j]) / (CAST(0.4 AS DOUBLE) + 0.3) for j in range(1, 33)] AS v FROM h), q AS (SELECT v AS qv FROM f WHERE vec_id = 0) SELECT vec_id, round(sc, 6) AS score FROM (SELECT vec_id, list_distance(v, qv) AS sc FROM f, q) ORDER BY sc, vec_id LIMIT 10",
    "text_tokens": f"WITH {_cut} SELECT token, count(*) AS n FROM tok GROUP BY token",
    "text_token_counts": f"WITH {_cut} SELECT d.doc_id, coalesce(n, 0) AS n_tokens FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) USING (doc_id)",
    "text_embedding": f"WITH {_cut}, b AS (SELECT doc_id, {_bucket.format(t='token', n=768)} AS bucket, sum(CAST(1.0 AS DOUBLE) + CAST(0.1 AS DOUBLE) * length(token)) AS w FROM tok GROUP BY ALL) SELECT doc_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM b",
    "text_validate": "SELECT doc_id, strlen(\"text\") > 0 AND length(regexp_replace(\"text\", '[^\\n\\r\\t\\x20-\\x7E]', '', 'g')) > strlen(\"text\") // 2 AS valid FROM documents",
    "tabular_numeric_stats": "SELECT round(avg(c_acctbal), 4) AS mean, round(sqrt(var_pop(c_acctbal) + 1e-12), 4) AS std, round(min(c_acctbal), 4) AS min, round(max(c_acctbal), 4) AS max FROM customer",
    "categorical_freq": f"SELECT {_bucket.format(t='c_mktsegment', n=32)} AS bucket, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1",
    "text_column_freq": f"WITH t AS (SELECT unnest(regexp_extract_all(p_name, '[A-Za-z0-9_]+')) AS token FROM part) SELECT {_bucket.format(t='token', n=64)} AS bucket, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM t GROUP BY 1",
    "column_type": " UNION ALL ".join(_kind.replace("{c}", c) for c in ("c_custkey", "c_name", "c_mktsegment", "c_acctbal")),
    "ts_stats": "SELECT user_id, round(avg(value), 5) AS mean, round(sqrt(var_pop(value) + 1e-12), 5) AS std, round(min(value), 5) AS min, round(max(value), 5) AS max FROM events GROUP BY user_id",
    "ts_znorm": f"WITH {SERIES} SELECT user_id, i AS pos, round((x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-12), 5) AS val FROM ser WINDOW w AS (PARTITION BY user_id)",
    "ts_trend": f"WITH {SERIES} SELECT user_id, round(CASE WHEN count(*) >= 2 THEN regr_slope(x, i) END, 6) AS slope FROM ser GROUP BY user_id",
    "ts_window_means": f"WITH {SERIES}, m AS (SELECT user_id, i, avg(x) OVER w AS val, count(*) OVER w AS n FROM ser WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT user_id, CAST(i // 3 AS INTEGER) AS pos, round(val, 5) AS val FROM m WHERE n = 5 AND i % 3 = 0",
    "ts_dft": f"WITH {SERIES}, n AS (SELECT user_id, least(count(*), 256) AS n FROM ser GROUP BY user_id), k AS (SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS pos, k FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 8, 12, 16, 24, 32, 48, 64]) AS k)) SELECT user_id, pos, round(sqrt(sum(x * cos(2 * pi() * k * i / n)) ** 2 + sum(x * sin(2 * pi() * k * i / n)) ** 2), 4) AS val FROM ser JOIN n USING (user_id), k WHERE n >= 16 AND k < n AND i < n GROUP BY user_id, pos",
    "ivf_all_lists": f"{pairs('l2')} {batch('l2', 10)}",
    "hnsw_all_lists": f"{pairs('l2').replace('b.vec_id < 10', 'b.vec_id % 20 = 0')} {batch('l2', 10)}",
    "pq_all_refined": f"{pairs('l2').replace('b.vec_id < 10', 'b.vec_id % 20 = 0')} {batch('l2', 10)}",
    "lsh_one_bucket": f"{pairs('l2').replace('b.vec_id < 10', 'b.vec_id % 20 = 0')} {batch('l2', 10)}",
    "ivf_range": f"{scored()} {SHOWN} FROM s WHERE sc <= 1.3",
    "ivf_filtered_all_lists": f"{scored()} {SHOWN} FROM (SELECT * FROM ({top('l2', 100)}) WHERE lab = '3' ORDER BY sc, vec_id LIMIT 10)",
    "ivf_save_load": f"{scored()} {SHOWN} FROM ({top('l2', 10)})",
    "database_search": f"{scored()} {SHOWN} FROM ({top('l2', 10)})",
    "rank_within_label": f"{scored()} SELECT lab AS label, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, round(sc, 6) AS score FROM s WINDOW w AS (PARTITION BY lab ORDER BY sc, vec_id) QUALIFY row_number() OVER w <= 3",
}

# The batches of the whole job: the same SQL, asked by every id divisible by 20.
for _name in [n for n in ORACLE_SQL if n.startswith("batch_knn_") or n.startswith("batch_filtered_knn_") or n == "ivf_all_lists"]:
    ORACLE_SQL[f"{_name}_every20"] = ORACLE_SQL[_name].replace("b.vec_id < 10", "b.vec_id % 20 = 0")
