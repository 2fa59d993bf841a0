"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton finds all tokens that occur in a piece. The encoder takes
the longest token at each place, so long as the pair it forms with the token before
it is one that merging would leave side by side; else it tries the next shorter one,
and where none is left it goes a token back. Places that proved hopeless are marked,
so each is tried once, and the whole takes linear time. The tokens are exactly those
that merging by rank gives.

Defined results: a null text counts as empty (no tokens, empty decoded text); repeated
rows and ids give a row each; an empty table gives no rows; texts of any length are
encoded whole; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, ship, text_of
from .vocab import Chunks, Vocabulary, default_path, packed, vocabulary

#: Entries that the pair table keeps at most; it is filled anew beyond that.
PAIRS_KEPT = 1_000_000


class Encoder:
    """The encoder of one vocabulary."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        made = {int(i): (None, None, -1) for i in vocab.byte_id}
        for rank, (a, b, whole) in enumerate(vocab.merges):
            made.setdefault(whole, (a, b, rank))
        self.made = made
        self.length = {i: len(vocab.token_bytes[i]) for i in made}
        self.automaton = ahocorasick.Automaton()
        for i in made:
            self.automaton.add_word(vocab.token_bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.whole = {vocab.token_bytes[i]: i for i in made}
        self._edges: tuple[dict[int, list[tuple[int, int]]], dict[int, list[tuple[int, int]]]] = ({}, {})
        self._fits: dict[tuple[int, int], bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts that stand at an end of a token while it is being merged, and the rank that ends each.

        ``side`` 0: at its left end; 1: at its right end. The token itself has no end.
        """
        known = self._edges[side].get(token)
        if known is None:
            known, part, until = [], token, len(self.vocab.merges)
            while part is not None:
                known.append((part, until))
                *parts, until = self.made[part]
                part = parts[side]
            self._edges[side][token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens side by side.

        It doesn't if a merge across the border comes while both of its parts stand
        at the border. Merges of equal rank go from left to right, so that one inside
        the left token comes before, and one inside the right token after.
        """
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            rank_of, known = self.vocab.rank_of, True
            for a, a_until in self._edge(left, 1):
                for b, b_until in self._edge(right, 0):
                    rank = rank_of.get((a, b))
                    if rank is not None and rank < a_until and rank <= b_until:
                        known = False
                        break
                if not known:
                    break
            if len(self._fits) >= PAIRS_KEPT:
                self._fits.clear()
            self._fits[key] = known
        return known

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.whole:
            return [self.whole[piece]]
        n = len(piece)
        starting: list[list[int]] = [[] for _ in range(n)]  # the tokens at each place, the longest last
        length = self.length
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            starting[end + 1 - length[token]].append(token)
        hopeless = bytearray(n + 1)
        done: list[int] = []  # the tokens taken
        tried = [len(starting[0])] if n else []  # how many of the candidates are left at each token's place
        at = 0
        while at < n:
            candidates, left = starting[at], tried[-1]
            while left:
                left -= 1
                token = candidates[left]
                if not hopeless[at + length[token]] and (not done or self.fits(done[-1], token)):
                    tried[-1] = left
                    done.append(token)
                    at += length[token]
                    if at < n:
                        tried.append(len(starting[at]))
                    break
            else:
                hopeless[at] = 1
                tried.pop()
                at -= length[done.pop()]
        return done


class Decoder:
    """All tokens' bytes end to end, and where each begins."""

    def __init__(self, vocab: Vocabulary) -> None:
        sizes = np.array([len(t) for t in vocab.token_bytes], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.bytes = np.frombuffer(b"".join(vocab.token_bytes), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        begin = self.begin[ids]
        sizes = self.begin[ids + 1] - begin
        ends = np.cumsum(sizes)
        return self.bytes[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ids) else 0)].tobytes()


def decimals(size: int) -> np.ndarray:
    """A row for each id: its decimal digits and a comma, filled up with zero bytes."""
    rows = np.array([f"{i}," for i in range(size)], dtype="S")
    return rows.view(np.uint8).reshape(size, -1)


class Codec:
    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.encoder, self.decoder = Encoder(self.vocab), Decoder(self.vocab)
        self.decimals = decimals(self.vocab.size)
        self.kind = self.vocab.kind
        self.chunks = Chunks(self.whole, self.words)

    def _of_pieces(self, pieces: list[str | int]) -> list[list[int]]:
        encode = self.encoder.encode
        known = {p: [p] if isinstance(p, int) else encode(p.encode("utf-8", "surrogatepass")) for p in dict.fromkeys(pieces)}
        return [known[p] for p in pieces]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.fromiter(chain.from_iterable(self._of_pieces(self.vocab.pieces(t))), self.kind).tobytes() for t in texts]

    def words(self, words: list[str]) -> list[bytes]:
        pieces, starts = self.vocab.cut(words)
        return packed(self._of_pieces(pieces), starts, self.kind)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.chunks.values(texts) if self.vocab.chunkable else [None] * len(texts)
        raw = (self.whole([t])[0] if f is None else b"".join(f) for t, f in zip(texts, found, strict=True))
        return [np.frombuffer(r, self.kind).astype(np.int64) for r in raw]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return self.decoder.decode(np.asarray(ids, np.int64)).decode("utf-8", "replace")

    def listed(self, ids: np.ndarray) -> bytes:
        """The decimal ids joined by commas."""
        flat = self.decimals[ids].ravel()
        return flat[flat != 0].tobytes()[:-1]


_codecs: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    path = path or default_path()
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def round_trip(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` ids and decoded. Nothing is shuffled."""
    ship(docs.sparkSession)
    path = tokenizer or default_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches(rows, "text"):
            ids = own.encode(batch.column("text").to_pylist())
            texts = [own.decode(i) for i in ids]
            columns = [
                batch.column("doc_id"),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(own.listed(i)).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            ]
            if with_ids:
                columns += [pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(work, schema)


def encoded(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document to train on: doc_id, n_tokens, ids, ids_sha256, decoded_sha256, exact. Nothing is shuffled.

    ``ids`` holds the ids one after another as little-endian unsigned numbers of two bytes (of four, where a
    vocabulary has more than 65,536 ids); ``exact`` says whether decoding them gives the text again.
    """
    ship(docs.sparkSession)
    path = tokenizer or default_path()

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches(rows, "text"):
            given = batch.column("text").to_pylist()
            ids = own.encode(given)
            texts = [own.decode(i) for i in ids]
            columns = [
                batch.column("doc_id"),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([i.astype(own.vocab.kind).tobytes() for i in ids], pa.binary()),
                pa.array([hashlib.sha256(own.listed(i)).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                pa.array([t == g for t, g in zip(texts, given, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "exact"])

    given_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return given_.mapInArrow(work, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string, exact boolean")
