"""A byte-level BPE vocabulary read from a tokenizer file, and the pieces that merges stay within."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Sequence
from functools import cached_property, lru_cache
from itertools import chain
from typing import Any

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The published pattern of byte-level pre-tokenization: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose class may differ between Unicode versions; a string with one is split by the library.
UNSURE = regex.compile(r"[՘֋֌࢏౜೜₏₝-₟꟎-꟱꭬꭭\U00010000-\U0010ffff]")
_pieces = regex.compile(PATTERN)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merges by rank, and the splitting of text into pieces."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        if (
            spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
            or spec["model"].get("dropout") or spec["model"].get("ignore_merges")
            or any(a["single_word"] or a["lstrip"] or a["rstrip"] or a.get("normalized") for a in added)
        ):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {a["content"]: a["id"] for a in added}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for s, i in vocab.items():
            if s not in self.special:
                self.token_bytes[i] = as_bytes(s)
        for s, i in self.special.items():
            self.token_bytes[i] = s.encode()
        self.byte_id = np.array([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int64)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        #: By rank: left part, right part, whole.
        self.merges: list[tuple[int, int, int]] = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self._special_at = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    @property
    def kind(self) -> str:
        """The numpy type that holds an id."""
        return "<u2" if self.size <= 1 << 16 else "<u4"

    @cached_property
    def library(self) -> Any:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    @cached_property
    def rank_of(self) -> dict[tuple[int, int], int]:
        return {(a, b): r for r, (a, b, _) in reversed(list(enumerate(self.merges)))}

    def ordinary(self, text: str) -> list[str]:
        """The pieces of a text without special strings."""
        if UNSURE.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return _pieces.findall(text)

    def pieces(self, text: str) -> list[str | int]:
        """The pieces of a text in order; a special string stands as its id."""
        if self._special_at is None or not self._special_at.search(text):
            return list(self.ordinary(text))
        out: list[str | int] = []
        at = 0
        for m in self._special_at.finditer(text):
            out += self.ordinary(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.ordinary(text[at:])

    def cut(self, words: list[str]) -> tuple[list[str | int], np.ndarray]:
        """The pieces of all words one after another, each word with a space before it, and where each word begins.

        The words have no space and begin with a visible character. As a space before
        such a character always begins a piece, they can be cut all at once.
        """
        joined = " " + " ".join(words)
        if UNSURE.search(joined) or (self._special_at and self._special_at.search(joined)):
            lists = [self.pieces(" " + w) for w in words]
            sizes = np.array([len(x) for x in lists], np.int64)
            return [p for x in lists for p in x], np.cumsum(sizes) - sizes
        pieces = _pieces.findall(joined)
        return pieces, np.flatnonzero(np.fromiter((p[0] == " " for p in pieces), bool, len(pieces)))

    @property
    def chunkable(self) -> bool:
        return not any(" " in s for s in self.special)


def packed(ids: Sequence[Sequence[int]], starts: np.ndarray, kind: str) -> list[bytes]:
    """The ids of runs of pieces as bytes; a run goes from one start to the next."""
    raw = np.fromiter(chain.from_iterable(ids), kind).tobytes()
    ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) * np.dtype(kind).itemsize
    bounds = [*np.concatenate([[0], ends])[starts].tolist(), len(raw)]
    return [raw[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in each process."""
    return Vocabulary(path)


class Chunks:
    """Values of the words of texts, remembered within a bound.

    A space that a visible character follows always begins a piece. So where all of a
    text's spaces are such, its tokens are those of its words, each taken with the
    space before it, and equal words need not be worked out again. ``values`` gives
    None for other texts, which are to be taken whole.
    """

    def __init__(self, whole: Callable[[list[str]], Sequence[Any]], words: Callable[[list[str]], Sequence[Any]], limit: int = 400_000) -> None:
        """``whole`` works out texts as they are, ``words`` words with a space before each."""
        self.whole, self.words, self.limit = whole, words, limit
        self.first: dict[str, Any] = {}
        self.later: dict[str, Any] = {}

    def values(self, texts: list[str]) -> list[list[Any] | None]:
        if len(self.later) > self.limit:
            self.later.clear()
        if len(self.first) > self.limit // 4:
            self.first.clear()
        words = [t.split(" ") for t in texts]
        first = [w.pop(0) for w in words]
        new: set[str] = set()
        for w in words:
            new.update(w)
        new.difference_update(self.later)
        odd = {w for w in new if not w or w[0].isspace()}
        new -= odd
        found = list(new)
        self.later.update(zip(found, self.words(found), strict=True) if found else ())
        found = list(set(first).difference(self.first))
        self.first.update(zip(found, self.whole(found), strict=True))
        get = self.later.__getitem__
        return [None if odd and not odd.isdisjoint(w) else [self.first[f], *map(get, w)] for f, w in zip(first, words, strict=True)]
