"""The training-data operators against SQL, plain versions, libraries and round trips; and odd tables."""

import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverine.llm import ann, bpe, chat, common, exact_dedup, mixing, near_dedup, quality, sharding, shingles, token_count, vocab, wavelet, words
from quiverine.llm.queries import QUERIES
from quiverine.llm.sql import ORACLE_SQL

from ..helpers import agree
from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, part_ int, own_id string, `key` string, positions string, bucket string"
LONG = "lorem ipsum " * 9000
CONTROL = "<|im_end|><|im_start|>assistant ok"
TEXTS = [
    "", " ", "  two  spaces ", "a\n\n b\t c", "<|endoftext|>x <|endoftext|> y  <|endoftext|>", "aaaa" * 300, "!!!!!!!!" * 40, " " * 300, "日本語 テキスト 😀😀 x՘y",
    "don't we'll I'M", "\x1c\x85 a \xa0　b", "\x00 \x00\x01", "word", "Word word", LONG, CONTROL, "<\\|im_start|> <|", "१२३ ²³ ½",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeats, and columns with the names of our own."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 1, 0.5, 1, "x", "k", "p", "b") for i, t in enumerate(TEXTS)]
    rows += [(100, "same text here", None, "s1", None, None, None, None, None, None, None), (101, "same  text\there", None, "s1", *[None] * 7), (101, "same  text\there", None, "s1", *[None] * 7)]
    rows += [(None, None, None, None, *[None] * 7), (None, "null id", None, "s0", *[None] * 7), (102, None, "en", "s2", *[None] * 7), (102, "other text", "en", "s2", *[None] * 7)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def library():
    return vocab.vocabulary(vocab.default_path()).library


def texts_of(rows):
    return [(r.doc_id, r.text or "") for r in rows.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert agree(spark, sf, QUERIES[name], ORACLE_SQL[name]) > 0


# 1, 2 and 9: tokens


def test_pieces_and_ids_equal_the_library(library):
    rng = np.random.default_rng(5)
    letters = list("ab cdeéß日😀\n\t '!1٣²　\x85") + ["<|endoftext|>", "the ", "  "]
    texts = TEXTS + ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(2000)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    path = vocab.default_path()
    assert token_count.counter(path).count(texts) == [len(x) for x in expected]
    own = bpe.codec(path)
    ids = own.encode(texts)
    assert [i.tolist() for i in ids] == expected
    assert [own.decode(i) for i in ids] == [library.decode(x, skip_special_tokens=False) for x in expected] == texts
    assert [own.listed(i).decode() for i in ids] == [",".join(map(str, x)) for x in expected]
    assert [np.frombuffer(x, "<u2").tolist() for x in wavelet.ids_of(path).encode(texts)] == expected


def thue_morse(n):
    """Two words of ``a`` and ``b`` that polynomials of their bytes modulo a power of two can't tell apart."""
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 64, 1024, 4096])
def test_words_that_collide_under_polynomials(library, n):
    t, u = thue_morse(n)
    texts = [f"x {t}", f"x {u}", t, u, f"{u} {t} {u}"]
    assert [np.frombuffer(x, "<u2").tolist() for x in wavelet.ids_of(vocab.default_path()).encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_words_with_one_hash_are_told_apart_by_bytes(library, monkeypatch):
    """With hashes of four values nearly all words collide; the table is also begun anew in between."""
    monkeypatch.setattr(words, "word_hashes", lambda data, start, size, salt: (size % 4).astype(np.uint64))
    monkeypatch.setattr(words, "MOST_WORDS", 3)
    monkeypatch.setattr(words, "AT_ONCE", 50)
    own = wavelet.Ids(vocab.default_path())
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in own.encode(TEXTS)] == [e.ids for e in library.encode_batch(TEXTS, add_special_tokens=False)]


def test_one_text_of_many_words(library, monkeypatch):
    """Slices of a text give what the whole gives; a text without spaces is one word."""
    rng = np.random.default_rng(3)
    text = " ".join("".join(rng.choice(list("abcdeé\n"), rng.integers(1, 20))) for _ in range(3000))
    plain = [shingles.Words([text.encode()]).hash.tolist(), quality.statistics([text.encode()]).tolist()]
    for module in (shingles, words, quality):
        monkeypatch.setattr(module, "AT_ONCE", 100)
    assert [shingles.Words([text.encode()]).hash.tolist(), quality.statistics([text.encode()]).tolist()] == plain
    own, solid = wavelet.Ids(vocab.default_path()), "ab" * 30_000
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode([text, solid])] == [e.ids for e in library.encode_batch([text, solid], add_special_tokens=False)]


def test_pairs_fit_as_merging_leaves_them(library):
    """The pair table against merging itself, over random pairs of tokens."""
    own = bpe.codec(vocab.default_path())
    rng = np.random.default_rng(2)
    merger = token_count.Merger(own.vocab)
    for a, b in rng.integers(0, 50_000, (3000, 2)).tolist():
        whole = own.vocab.token_bytes[a] + own.vocab.token_bytes[b]
        assert own.encoder.fits(a, b) == (own.encoder.encode(whole) == [a, b])
        assert len(own.encoder.encode(whole)) == merger.counts([whole])[0]


def test_decoding_parts_of_characters():
    own = bpe.codec()
    ids = own.encode(["日"])[0]
    assert len(ids) > 1 and own.decode(ids[:1]) == "�"


def test_token_counts(docs, pairs, odd, empty, library):
    for table in (docs, odd):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(table).collect())
        sizes = [(i, t, len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts_of(table)]
        assert got == sorted((str(i), len(t.encode()), n, n > 512) for i, t, n in sizes)
    assert token_count.token_counts(empty).count() == 0


def test_round_trip(docs, odd, empty, library):
    for table in (docs, odd):
        got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(table).collect())
        want = []
        for i, t in texts_of(table):
            ids = library.encode(t, add_special_tokens=False).ids
            want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
        assert got == sorted(want)
    assert bpe.round_trip(empty).count() == 0
    for r in bpe.encoded(odd).collect():
        assert r.exact and [r.decoded_sha256, library.decode(np.frombuffer(r.ids, "<u2").tolist(), skip_special_tokens=False)] in [[hashlib.sha256(t.encode()).hexdigest(), t] for _, t in texts_of(odd)]
    assert bpe.encoded(empty).count() == 0
    row = bpe.round_trip(odd.filter("doc_id = 12"), with_ids=True).first()
    assert row.ids == library.encode("word").ids and row.decoded == "word"


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 3000, 9000):
        ids = (rng.zipf(1.5, n) % 60).astype("<u2")
        m = wavelet.from_bytes(wavelet.to_bytes([1], [n], wavelet.WaveletMatrix.build(ids)))[2]
        assert m.decode().tolist() == ids.tolist()
        for at in range(0, n, 97):
            assert m.access(at) == ids[at]
        for v in (0, 1, 5, 59, 1000):
            where = np.flatnonzero(ids == v)
            assert m.rank(v) == len(where) and m.rank(v, n // 2) == (ids[: n // 2] == v).sum()
            assert [m.select(v, i) for i in range(min(len(where), 50))] == where[:50].tolist()


@pytest.mark.parametrize("shard_tokens", [64, 1 << 21])
def test_wavelet_files(docs, odd, empty, library, shard_tokens):
    for table in (docs, odd):
        got = wavelet.write_and_read(table, shard_tokens=shard_tokens).orderBy("start").collect()
        start, want = 0, {}
        assert [r.doc_id for r in got] == sorted((i for i, _ in texts_of(table)), key=lambda i: (i is not None, i))
        for i, t in texts_of(table):
            ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
            want.setdefault(i, set()).add((len(ids), zlib.crc32(ids.tobytes())))
        for r in got:
            assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
            start += r.n_tokens
    assert wavelet.write_and_read(empty).count() == 0


def test_a_file_is_used_part_by_part(spark, docs, tmp_path):
    """A folder without a scheme; an access unpacks a frame of each plane, not the planes."""
    scratch = common.Scratch(spark, "test-wavelet")
    manifest = wavelet.write_shards(docs, str(tmp_path / "shards"), scratch)
    name = manifest.orderBy("part", "seq").first().name
    assert (tmp_path / "shards" / name).exists() and wavelet.read_shards(spark, str(tmp_path / "shards"), manifest).count() == docs.count()
    ids = (np.random.default_rng(0).zipf(1.3, 2_000_000) % 5000).astype("<u2")
    wavelet.put(wavelet.qualified(spark, str(tmp_path)), "big.wm", wavelet.to_bytes([1], [len(ids)], wavelet.WaveletMatrix.build(ids)))
    shard = wavelet.open_shard(f"file:{tmp_path}", "big.wm")
    assert shard.matrix.access(1_234_567) == ids[1_234_567] and all(p.unpacked <= 2 < len(p.frames) for p in shard.matrix.planes)
    assert shard.matrix.rank(7, 1_000_000) == (ids[:1_000_000] == 7).sum() and shard.matrix.select(7, 1000) == np.flatnonzero(ids == 7)[1000]
    assert (shard.matrix.decode() == ids).all()
    for bare in ("/tmp/x", "viewfs://a/b"):
        with pytest.raises(ValueError, match="token files"):
            wavelet.open_folder(bare)


# 3: quality


def test_quality_on_held_out_rows(spark, docs):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op3_quality"](spark, sf).toPandas()
    assert [x.held_out for x in rows.itertuples()] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.7) == (rows.predicted == 1)).all() and len(rows) == 1000
    held = rows[rows.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.97


def test_quality_statistics_equal_plain_ones(pairs):
    texts = [t or "" for _, t in pairs] + TEXTS
    assert quality.statistics([t.encode() for t in texts]).tolist() == [brute.statistics(t) for t in texts]


def test_quality_statistics_and_density():
    counts = quality.statistics([b"", b"Aa bb bb 1!\n", "é|".encode()])
    assert counts[1].tolist() == [12, 4, 3, 1, 8, 1, 1, 0, 1, 0, 1, 0, 5, 0] and not counts[0].any() and counts[2][-1] == 2
    rng = np.random.default_rng(0)
    many = quality.statistics([bytes(rng.choice(list(b"ab AB!|\n"), 60)) for _ in range(60)] + [b"the quick brown fox jumps " * 3] * 3)
    labels = np.array([0, 1] * 30 + [1] * 3)
    model = quality.Discriminant.fit(many, labels)
    x = model.features(many)
    density = []
    for k in (0, 1):
        s = model.factors[k] @ model.factors[k].T
        d = x - model.means[k]
        density.append(np.log(model.priors[k]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(s), d))
    assert np.allclose(model.score(many), 1 / (1 + np.exp(density[0] - density[1])))


def test_quality_of_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(3, None, 0), (None, 1, 0), (5, 7, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.score_documents(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], labels.schema)
    assert {r.score for r in quality.score_documents(odd, none).collect()} == {0.5}
    assert quality.score_documents(empty, labels).count() == 0
    kept = quality.keep_good(odd, labels, threshold=0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()


# 4: mixing


def test_targets():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    got = mixing.targets([1, 100, 100], [50, 1, 1])
    assert got == [3, 99, 99] and mixing.targets([0, 4], [1, 1]) == [0, 4] and mixing.targets([], []) == []
    with np.errstate(all="raise"):
        assert mixing.targets([5], [1]) == [5]


def test_schedules_invert():
    share = np.linspace(0, 1, 101)
    for schedule in (*mixing.CURRICULUM, mixing.Schedule((0, 0.3, 0.6, 1), (0, 2, 0, 1))):
        t = schedule.time_of(share)
        assert (np.diff(t) >= 0).all() and t[0] == 0 and abs(t[-1] - 1) < 1e-9
        grid = np.linspace(0, 1, 200_001)
        due = np.concatenate([[0], np.cumsum(np.interp((grid[1:] + grid[:-1]) / 2, schedule.times, schedule.weights) * np.diff(grid))])
        assert np.allclose(np.interp(t, grid, due) / due[-1], share, atol=1e-5)


def test_mix(spark, docs, odd, empty):
    rows = mixing.mix(docs).toPandas()
    again = mixing.mix(docs).toPandas()
    assert rows.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    own = rows.merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    assert (own.taken <= 3 * own["size"]).all() and len(own) == docs.count()
    for _, g in own.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.5 * g["size"].max()
    first = [p[0] for p in rows.positions if len(p)]
    assert first == sorted(first) and all(0 <= x <= 1 for p in rows.positions for x in p)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = {int(r.doc_id): len(r.positions) for r in rows.itertuples() if len(r.positions)}
    assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == want
    kept = mixing.mixed(odd)
    assert kept.columns == odd.columns and kept.count() == sum(len(r.positions) for r in mixing.mix(odd).collect())
    assert mixing.mixed(empty).count() == 0


def test_mix_of_repeated_ids_agrees_between_runs(spark):
    rows = [(i % 4 if i % 5 else None, f"word {'more ' * (i % 7)}", f"s{i % 2}", f"extra {i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, print string")
    runs = [sorted((str(r.doc_id), r.text, r.source, r["print"]) for r in mixing.mixed(d, fill=True).collect()) for d in (docs, docs.repartition(5), docs.orderBy(F.desc("print")))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == mixing.mix(docs, fill=True).agg(F.sum(F.size("positions"))).first()[0]


@pytest.mark.parametrize("few", [mixing.FEW_LEFT, 0])
def test_mix_reaches_targets_beside_long_documents(spark, few, monkeypatch):
    """Every source has one document that is a third of it; some of them straddle their targets."""
    import corpus_pipeline

    monkeypatch.setattr(mixing, "FEW_LEFT", few)
    rows = [(1000 * s + i, "w " * (4000 if i == 0 else 5 + i % 40), f"s{s}" if s else None) for s in range(9) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    own = mixing.mix(docs, fill=True).toPandas()
    assert (own.taken <= 3 * own["size"]).all() and all(len(p) * n == t for p, n, t in zip(own.positions, own["size"], own.taken, strict=True))
    assert all(0 <= x <= 1 for p in own.positions for x in p)
    for _, g in own.groupby(own.doc_id // 1000):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.001 * g.target.iloc[0]
    want = {r.doc_id: len(r.positions) for r in own.itertuples() if len(r.positions)}
    stage = corpus_pipeline.mixed_sources(spark, docs, "")
    assert {r.doc_id: r.n for r in stage.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == want


def test_mix_filled_takes_odd_tables(spark, docs, odd, empty):
    for table in (docs, odd):
        own = mixing.mix(table, fill=True).toPandas()
        assert len(own) == table.count() and (own.taken <= 3 * own["size"]).all()
        assert mixing.mixed(table, fill=True).count() == own.positions.map(len).sum()
    assert mixing.mix(empty, fill=True).count() == 0 and mixing.mixed(empty, fill=True).count() == 0


# 5: chat


def test_chat_round_trip(spark):
    said = [CONTROL, "a <|im_start|> b", "<\\|", "<\\\\|x", "", None, "<|", "|><", "\n", LONG, "<<||"]
    rows = [(1, i, ("user", "assistant", "odd role\n<|im_end|>", None)[i % 4], t) for i, t in enumerate(said)]
    rows += [(2, None, "assistant", "late"), (2, 0, "assistant", "early"), (None, 1, "user", "no id"), (3, 1, "user", "tie b"), (3, 1, "user", "tie a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(chat.records_of_rows(table), "conv_id")
    back = out.select("conv_id", "formatted", chat.parsed(F.col("formatted")).alias("t"), chat.learned_texts(F.col("formatted"), F.col("loss_spans")).alias("l"), "loss_spans")
    got = {r.conv_id: r for r in back.collect()}
    assert [(t.role, t.text) for t in got[1].t] == [(r or "", t or "") for _, _, r, t in rows[:11]]
    assert got[1].l == "".join(t or "" for _, _, r, t in rows[:11] if r == "assistant")
    assert got[1].formatted.count("<|im_start|>") == 11 and [t.text for t in got[2].t] == ["early", "late"] and [t.text for t in got[3].t] == ["tie a", "tie b"]
    for s in got[1].loss_spans:
        assert got[1].formatted[: s.start].endswith("<|im_start|>assistant\n") and got[1].formatted[s.start + s.size :].startswith("<|im_end|>\n")
    assert chat.digests(table.filter("false")).count() == 0
    row = {r.conv_id: r for r in chat.digests(table).collect()}[2]
    assert row.turns_sha256 == hashlib.sha256(b"assistant\nearly\nassistant\nlate\n").hexdigest() and row.loss_chars == 9


def test_layouts_are_chosen_by_fingerprint(spark):
    records = [
        {"id": 1, "prompt": "p", "response": "r"}, {"id": 2, "instruction": "i", "output": "o"}, {"id": 3, "instruction": "i", "input": "x", "output": "o"},
        {"id": 4, "messages": [{"role": "user", "content": "m"}, {"role": "assistant", "content": None}]}, {"id": 5, "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
        {"id": 6, "prompt": "p"}, {"id": 7, "system": "s", "prompt": "p", "response": "r"}, {"id": 8, "messages": []}, {"id": 9, "question": "q", "answer": "a", "layout": "mine"},
    ]
    schema = (
        "id long, prompt string, response string, instruction string, input string, output string, system string, question string, answer string, layout string, "
        "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>"
    )
    table = spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in records]))
    got = {r.id: r for r in chat.canonical(table).collect()}
    assert [got[i].layout_ for i in range(1, 10)] == ["prompt", "instruction", "instruction", "messages", "conversations", None, "prompt", "messages", "question"]
    turns = lambda i: got[i].turns and [tuple(t) for t in got[i].turns]
    assert turns(3) == [("user", "i"), ("user", "x"), ("assistant", "o")] and turns(5) == [("user", "h"), ("assistant", "g")] and turns(7)[0] == ("system", "s")
    assert turns(4) == [("user", "m"), ("assistant", "")] and got[6].turns is None and got[8].turns == [] and got[9].layout == "mine"


# 6: exact dedup


@pytest.mark.parametrize("bits", [60, 3])
def test_exact_dedup_of_odd_rows(odd, empty, bits):
    """With three bits, keys collide all the time, and chains tell the texts apart."""
    got = exact_dedup.exact_dedup(odd, capacity=2, bits=bits).collect()
    groups = {}
    for i, t in texts_of(odd):
        groups.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()).hexdigest(), []).append(i)
    assert len(got) == odd.count() and sum(r.kept for r in got) == len(groups)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None) and r.doc_id in ids
        assert not r.kept or r.doc_id == r.keep_id
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_first(empty).count() == 0


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(4000).select(exact_dedup.key_of(F.sha2(F.col("id").cast("string"), 256)).alias("key"))
    found = exact_dedup.directory(keys, 64)
    sizes = keys.withColumn("prefix", exact_dedup.prefix_of(F.col("key"))).join(found, "prefix").groupBy("bucket", "depth").count().collect()
    assert sum(r["count"] for r in sizes) == 4000 and max(r["count"] for r in sizes) <= 64 and len({r.depth for r in sizes}) > 1
    assert all(r.bucket % (1 << (16 - r.depth)) == 0 for r in sizes) and len({r.bucket for r in sizes}) == len(sizes)


def test_index_on_files(spark, docs):
    scratch = common.Scratch(spark, "test-index")
    exact_dedup.build(docs, scratch, capacity=50)
    spark.read.parquet(scratch.path("entries")).write.parquet(scratch.path("saved/entries"))
    spark.read.parquet(scratch.path("directory")).write.parquet(scratch.path("saved/directory"))
    index = exact_dedup.ExtendibleIndex.load(spark, scratch.path("saved"))
    asked = docs.filter("doc_id = 0").unionByName(docs.filter("doc_id = 1").withColumn("text", F.lit("never seen")))
    assert [(r.doc_id, r.keep_id) for r in index.lookup(asked).orderBy("doc_id").collect()] == [(0, 0), (1, None)]


# 7: near dedup


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_components(docs, pairs, width, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.components(docs, near_dedup.Near(width, percent)).collect()}
    assert got == brute.near(pairs, width, percent)


def test_near_families(spark, monkeypatch):
    """Copies of texts with changes of their own, and texts at the edge of the threshold; also with comparisons dealt to many cells, and by bands of sketches."""
    rng = np.random.default_rng(4)
    word = lambda: "w" + str(rng.integers(0, 5000))
    rows = []
    for _ in range(4):
        base = [word() for _ in range(120)]
        for _ in range(25):
            own = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 9)):
                own[at] = word()
            rows.append(" ".join(own))
    rows += ["a b c d e f g h i", "a b c d e f g h j", "a b", "A  b", "a", "", None]
    table = [(i, t) for i, t in enumerate(rng.permutation(np.array(rows, object)).tolist())]
    frame = spark.createDataFrame(table, "doc_id long, text string")
    want = brute.near(table, 3, 85)
    for pairs_, cell in ((near_dedup.REST_PAIRS, near_dedup.CELL), (near_dedup.REST_PAIRS, 3), (0, 3)):
        monkeypatch.setattr(near_dedup, "REST_PAIRS", pairs_)
        monkeypatch.setattr(near_dedup, "CELL", cell)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.components(frame, near_dedup.Near(3, 85)).collect()}
        assert got == want
    assert len({c for _, c in want.values()}) > 8


def test_a_bucket_of_many_unlinked_classes(spark):
    """20,000 texts that share half of their words meet in one bucket; ten pairs of them are linked."""
    rng = np.random.default_rng(6)
    passage = " ".join(f"p{i}" for i in range(20))
    texts = [f"{passage} " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 25)) for _ in range(20_000)]
    for i in range(10):
        texts[2 * i + 1] = texts[2 * i] + f" end{i}"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    classes = docs.select(F.col("doc_id").alias("rep"), F.array(F.lit(7).cast("long")).alias("bands"), F.lit(43).cast("long").alias("n_shingles"))
    scratch = common.Scratch(spark, "test-bucket")
    label, between = near_dedup.links(classes, docs, near_dedup.Near(3, 85), scratch)
    linked = {(r.component, r.node) for r in label.collect()} | {(r.hub, r.member) for r in between.collect()}
    assert linked == {(2 * i, 2 * i + 1) for i in range(10)}


def test_bands_of_sketches_miss_few():
    for own in (near_dedup.Near(3, 85), near_dedup.Near(5, 80)):
        r = own.sketch_rows
        assert (1 - (own.percent / 100) ** r) ** (near_dedup.SKETCH // r) <= 1e-6


def test_near_of_odd_rows(odd, empty):
    rows = near_dedup.components(odd).collect()
    assert len(rows) == odd.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for i in (100, 101) for r in by_id[i]} == {100} and all(r.component_id is None and r.kept for r in by_id[None])
    assert by_id[0][0].n_shingles == 0 and by_id[0][0].component_id == 0 and by_id[12][0].component_id == 12
    kept = near_dedup.keep_first(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 101").count() == 0 and near_dedup.components(empty).count() == 0


def test_repeated_ids_join_their_texts(spark):
    a, b = "one two three four five six seven", "ten eleven twelve thirteen fourteen fifteen"
    rows = spark.createDataFrame([(5, a), (5, b), (7, a), (2, b), (9, "x y z")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.components(rows).collect()} == {(5, 2), (7, 2), (2, 2), (9, 9)}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    whole = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    for shared in (0.3, 0.85):
        n = int(len(whole) * (1 + shared) / 2)
        a, b = whole[:n], whole[len(whole) - n :]
        true = len(np.intersect1d(a, b)) / len(whole)
        s = near_dedup.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)]), 2048)
        assert abs((s[0] == s[1]).mean() - true) < 0.06
    tiny = near_dedup.signatures(np.array([7], np.uint64), np.array([1]), 64)
    assert (tiny == 7).all() and near_dedup.Near(3, 85).least == 6 and near_dedup.Near().least == 4


def test_shingles_equal_plain_ones():
    texts = ["", "a", "A b", "a b c d", "x  y\tx y x y x", "é É z ß"]
    for width in (1, 3, 5):
        _, sizes = shingles.shingle_sets([t.encode() for t in texts], width)
        assert sizes.tolist() == [len(brute.shingles(t, width)) for t in texts]


@pytest.mark.parametrize("n", [1024])
def test_near_texts_of_words_that_collide_under_polynomials(spark, n):
    t, u = thue_morse(n)
    rows = [(i, " ".join(f"{w} {x}" for x in "pqrs") + f" {w}") for i, w in enumerate((t, u))]
    got = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), near_dedup.Near(3, 85)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(0, 0), (1, 1)}


# 8: nearest neighbours


def test_nearest_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    got = QUERIES["op8_nearest"](spark, sf).toPandas()
    place = {v: i for i, v in enumerate(ids)}
    exact = sum((x[[place[v] for v in got.query_id], d] * x[[place[v] for v in got.vec_id], d] for d in range(x.shape[1])), np.zeros(len(got)))
    assert np.allclose(exact, got.score, rtol=0, atol=1e-12)
    hits = 0
    asked = [v for v in ids if v % 20 == 0]
    for q in asked:
        s = x @ x[place[q]]
        s[place[q]] = -np.inf
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and (np.diff(own.score) <= 0).all()
        hits += len(set(own.vec_id) & set(ids[np.argsort(-s, kind="stable")[:20]]))
    assert hits / (20 * len(asked)) >= 0.9


def test_nearest_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [2.0, 2.0]), (9, [2.0, 3.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, part string, rank int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(table, k=20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 9, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 20, 0.0), (20, 1, 9, 2.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    assert ann.search(table.filter("false")).count() == 0 and ann.search(table.filter("vec_id = 0")).count() == 0


def test_parts_follow_the_data():
    """Clusters are found in few parts; of ten times the rows a query visits less than ten times as many."""
    rng, visited = np.random.default_rng(1), []
    for n in (4000, 40_000):
        middle = rng.standard_normal((100, 32))
        x = middle[rng.integers(0, 100, n)] + 0.3 * rng.standard_normal((n, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        parts = ann.parts_for(n)
        router, share = ann.Router.measured(x[rng.permutation(n)[: ann.FIT_ROWS]], parts, 20)
        part = router.probabilities(x).argmax(1)
        held = np.bincount(part, minlength=parts)
        asked = np.arange(0, n, n // 100)
        visits = router.visits(x[asked], share, held, 21)
        near = np.argsort(-(x[asked] @ x.T), axis=1)[:, 1:21]
        assert np.mean([np.isin(part[near[i]], v).mean() for i, v in enumerate(visits)]) >= 0.9
        visited.append(np.mean([held[v].sum() for v in visits]))
    assert visited[0] < 0.15 * 4000 and visited[1] < 7 * visited[0]
    assert [ann.parts_for(n) for n in (0, 10, 500, 50_000, 10**12)] == [1, 1, 4, 64, ann.MOST_PARTS]


def test_nearest_keeps_ties_to_smaller_ids():
    rows, ids = np.tile([[1.0, 2.0]], (50, 1)), np.arange(100, 50, -1)
    _, got, score = ann.nearest(np.array([[3.0, 1.0]]), np.array([55]), rows, ids, 4)
    assert got.tolist() == [51, 52, 53, 54] and set(score) == {5.0}


def test_balanced_parts():
    rng = np.random.default_rng(0)
    x = np.repeat(rng.standard_normal((4, 8)) * 3, 40, 0) + rng.standard_normal((160, 8)) * 0.2
    graph = ann.neighbour_graph(x, 8)
    part = ann.balanced_parts(graph, 4, rng)
    assert np.bincount(part).tolist() == [40] * 4 and (part[graph] == part[:, None]).mean() > 0.95


# 10: sharding


def test_jump_equals_the_published_loop():
    keys = sharding.stable_key(np.arange(-50, 3000))
    for n in (1, 2, 40, 41):
        assert sharding.jump(keys, n).tolist() == [brute.jump(int(k), n) for k in keys]


def test_shards(docs, odd, empty, tmp_path):
    for table in (docs, odd):
        rows = sharding.assign(table, 40).toPandas()
        assert len(rows) == table.count() and set(rows.law) == {"key"}
        assert ((rows.grown_shard == rows.shard) | (rows.grown_shard == 40)).all()
        for _, g in rows.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
        assert sorted(zip(rows["size"], rows.text_crc32, strict=True)) == sorted((len(t.encode()) + 16, zlib.crc32(t.encode())) for _, t in texts_of(table))
        key = lambda i: int(sharding.stable_key(np.array([-(1 << 62) if i is None else i]))[0])
        plain = sorted((brute.jump(key(i), 40), i is not None, i or 0, zlib.crc32(t.encode()), len(t.encode()) + 16, brute.jump(key(i), 41)) for i, t in texts_of(table))
        slots, want = {}, []
        for shard, known, i, crc, size, grown in plain:
            slots[shard] = slots.get(shard, -1) + 1
            want.append((shard, slots[shard], known, i, crc, size, grown))
        got = [(r.shard, r.slot, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"], r.grown_shard) for r in sharding.assign(table, 40).select("shard", "slot", "doc_id", "text_crc32", F.col("size").alias("size"), "grown_shard").collect()]
        assert sorted(got) == want
    assert sharding.assign(empty, 40).count() == 0
    far = docs.sparkSession.createDataFrame([(2**60 + 1, "a"), (2**60 + 2, "a"), (None, "a")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.shard for r in sharding.assign(far, 1000).collect()}
    assert [got[i] for i in (2**60 + 1, 2**60 + 2)] == sharding.jump(sharding.stable_key(np.array([2**60 + 1, 2**60 + 2])), 1000).tolist()
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    assert docs.sparkSession.read.parquet(str(tmp_path / "s")).count() == docs.count()


# The pipeline


def test_pipeline_against_plain_stages(spark, library):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, source, sf)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == source.columns and sum((i in kept) == (q == 1) for i, q in labels.items()) / len(labels) > 0.9
    single = stages[1](spark, good, sf)
    by_text = {}
    for i, t in texts_of(good):
        by_text.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    assert sorted(r.doc_id for r in single.collect()) == sorted(min(x) for x in by_text.values()) and single.columns == source.columns
    apart = stages[2](spark, single, sf)
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i, (_, c) in brute.near(texts_of(single), 5, 80).items() if i == c) and apart.columns == source.columns
    mixed = stages[3](spark, apart, sf)
    assert mixed.columns == source.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in apart.collect()}
    want = sorted((i, len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts_of(mixed))
    assert sorted((r.doc_id, r.n_tokens) for r in stages[4](spark, mixed, sf).collect()) == want
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_pipeline_of_odd_tables(spark, odd, empty, library, tmp_path):
    """Nulls, repeats, long texts and clashing columns run through all stages; an empty table gives no rows."""
    import corpus_pipeline

    schema = "doc_id long, quality int, toxic int"
    for name, table, labels in (("odd", odd, [(i, 1, 0) for i in range(20)]), ("empty", empty, [])):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(labels, schema).write.parquet(str(tmp_path / name / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    known = {t for _, t in texts_of(odd)}
    assert out and all(r.exact and library.decode(np.frombuffer(r.ids, "<u2").tolist(), skip_special_tokens=False) in known for r in out)
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
