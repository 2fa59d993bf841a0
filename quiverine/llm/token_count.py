"""Token counts by rank-synchronous array merging.

The pieces of many texts lie end to end in one array of symbols with the starts of
the sequences beside it. In each round, every sequence finds its pair of lowest rank
and applies it wherever it occurs, all sequences at once; sequences without a pair
are done, and their symbols are counted.

Defined results: a null text counts as empty (0 tokens); repeated rows and ids give a
row each; an empty table gives no rows; a text of any length is counted whole;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, ship, text_of
from .vocab import Chunks, Vocabulary, default_path, vocabulary

#: Pairs that no merge joins.
NEVER = np.iinfo(np.int64).max
#: Bytes of pieces that are merged together.
AT_ONCE = 4 << 20


class Merger:
    """The merges of a vocabulary as sorted arrays."""

    def __init__(self, vocab: Vocabulary) -> None:
        merges = np.array(vocab.merges, np.int64).reshape(-1, 3)
        self.byte_id, self.width = vocab.byte_id, np.int64(vocab.size)
        pairs = merges[:, 0] * self.width + merges[:, 1]
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks, self.whole = pairs[order], order.astype(np.int64), merges[:, 2]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(len(left), NEVER)
        pair = left * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at], NEVER)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols are left of each piece."""
        out = np.zeros(len(pieces), np.int64)
        start = 0
        while start < len(pieces):
            end, held = start, 0
            while end < len(pieces) and (held < AT_ONCE):
                held += len(pieces[end])
                end += 1
            out[start:end] = self._merge(pieces[start:end])
            start = end
        return out

    def _merge(self, pieces: list[bytes]) -> np.ndarray:
        left = np.array([len(p) for p in pieces], np.int64)
        owner = np.flatnonzero(left)  # the sequences still at work
        size = left[owner]
        symbols = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        starts = np.cumsum(size) - size
        rank = np.full(len(symbols), NEVER)  # of each symbol with the next of its sequence
        if len(symbols) > 1:
            rank[:-1] = self.rank(symbols[:-1], symbols[1:])
        rank[starts + size - 1] = NEVER
        while len(owner):
            lowest = np.minimum.reduceat(rank, starts)
            busy = lowest < NEVER
            if not busy.all():
                left[owner[~busy]] = size[~busy]
                keep = np.repeat(busy, size)
                symbols, rank = symbols[keep], rank[keep]
                owner, size, lowest = owner[busy], size[busy], lowest[busy]
                starts = np.cumsum(size) - size
                if not len(owner):
                    break
            hit = rank == np.repeat(lowest, size)
            at = np.flatnonzero(hit)
            # Where a pair overlaps itself, every other one of the run counts from its left end.
            run = np.concatenate([[True], np.diff(at) != 1])
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = self.whole[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            ends = np.zeros(len(symbols), bool)
            ends[starts + size - 1] = True
            ends[at] |= ends[at + 1]
            size = np.add.reduceat(stay.astype(np.int64), starts)
            moved = at - np.arange(len(at))  # where the merged symbols lie once the gaps are closed
            symbols, rank, ends = symbols[stay], rank[stay], ends[stay]
            starts = np.cumsum(size) - size
            anew = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            open_ = anew[~ends[anew]]
            rank[anew] = NEVER
            rank[open_] = self.rank(symbols[open_], symbols[open_ + 1])
        return left


class Counter:
    """Token counts of texts with one vocabulary; words are remembered within a bound."""

    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.merger = Merger(self.vocab)
        self.chunks = Chunks(self.whole, self.words)

    def _of_pieces(self, pieces: list[str | int]) -> np.ndarray:
        single = {p: i for i, p in enumerate(dict.fromkeys(p for p in pieces if isinstance(p, str)))}
        n = self.merger.counts([p.encode("utf-8", "surrogatepass") for p in single]).tolist()
        return np.array([1 if isinstance(p, int) else n[single[p]] for p in pieces], np.int64)

    def whole(self, texts: list[str]) -> list[int]:
        return [int(self._of_pieces(self.vocab.pieces(t)).sum()) for t in texts]

    def words(self, words: list[str]) -> list[int]:
        pieces, starts = self.vocab.cut(words)
        return np.add.reduceat(self._of_pieces(pieces), starts).tolist()

    def count(self, texts: list[str]) -> list[int]:
        if not self.vocab.chunkable:
            return self.whole(texts)
        found = self.chunks.values(texts)
        odd = iter(self.whole([t for t, f in zip(texts, found, strict=True) if f is None]))
        return [next(odd) if f is None else sum(f) for f in found]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, limit: int = 512, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. Nothing is shuffled."""
    ship(docs.sparkSession)
    path = tokenizer or default_path()

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches(rows, "text"):
            n = own.count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = text_of(text_col)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return given.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
