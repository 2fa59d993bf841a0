"""Words and word shingles of many texts at once, as arrays of 64-bit hashes."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: White space that parts words: space and the bytes 9 to 13.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A to Z in lower case, other bytes as they are.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one.
SHORT = 64
#: The lowest bytes of a block of 8, by how many of them a word has.
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes that are looked at, and words that are hashed, at once: what a long text needs besides its words is bounded.
AT_ONCE = 1 << 22


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; ``data`` must go on for eight bytes after its last word."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def block(view: np.ndarray, start: np.ndarray, size: np.ndarray, j: int) -> np.ndarray:
    """The ``j``-th eight bytes of words, zeros after their ends."""
    return view[start + 8 * j] & _KEPT[np.minimum(size - 8 * j, 8)]


def word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    """A hash of each word's bytes and size: each block of 8 bytes is mixed into what came before it.

    Mixing isn't linear in the bytes, so no pattern of letters makes words collide, as it does with polynomials.
    """
    view = eights(data)
    out = mixed(size.astype(np.uint64) * _ODD + np.asarray(salt, np.uint64))
    out = mixed((out ^ block(view, start, size, 0)) + _ODD)
    more = np.flatnonzero((size > 8) & (size <= SHORT))
    j = 1
    while len(more):
        out[more] = mixed((out[more] ^ block(view, start[more], size[more], j)) * _ODD + np.uint64(j))
        j += 1
        more = more[size[more] > 8 * j]
    for i in np.flatnonzero(size > SHORT).tolist():
        whole = data[start[i] : start[i] + size[i]]
        out[i] ^= np.uint64(int.from_bytes(blake2b(whole.tobytes(), digest_size=8).digest(), "little"))
    return out


class Words:
    """The words of a list of texts: ``doc`` (index of the text), ``hash``, ``start`` and ``size`` (in bytes)."""

    def __init__(self, texts: list[bytes]) -> None:
        self.count = len(texts)
        self.data = np.frombuffer(b" ".join([*texts, bytes(8)]) if texts else b" " + bytes(8), np.uint8)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.lengths + 1) - self.lengths - 1
        end = len(self.data) - 8
        starts, ends, before = [], [], True
        for at in range(0, end, AT_ONCE):
            space = _SPACE[self.data[at : min(at + AT_ONCE, end)]]
            was = np.concatenate([[before], space[:-1]])
            starts.append(np.flatnonzero(was & ~space) + at)
            ends.append(np.flatnonzero(space & ~was) + at)
            before = bool(space[-1])
        self.start = np.concatenate(starts)
        if not len(self.start):
            self.doc = self.size = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        # Every text has a space after it, so every word ends.
        self.size = np.concatenate(ends) - self.start
        self.doc = np.searchsorted(self.begin, self.start, "right") - 1
        low = _LOWER[self.data]
        self.hash = np.concatenate([word_hashes(low, self.start[i : i + AT_ONCE], self.size[i : i + AT_ONCE]) for i in range(0, len(self.start), AT_ONCE)])

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.count)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of all texts one after another, and how many each text has.

    A text of fewer words has one shingle of all of them; one without words has none.
    """
    words = Words(texts)
    n = words.per_doc()
    first = np.cumsum(n) - n
    hashes, docs = words.hash, words.doc
    made = max(len(hashes) - width + 1, 0)
    whole = hashes[:made].copy()
    for j in range(1, width):
        whole = mixed(whole * np.uint64(3) + hashes[j : j + made])
    keep = docs[:made] == docs[width - 1 : width - 1 + made] if made else np.zeros(0, bool)
    values, owner = [whole[keep]], [docs[:made][keep]]
    for d in np.flatnonzero((n > 0) & (n < width)).tolist():
        acc = hashes[first[d] : first[d] + 1].copy()
        for j in range(1, int(n[d])):
            acc = mixed(acc * np.uint64(3) + hashes[first[d] + j])
        values.append(acc)
        owner.append(np.array([d]))
    value, own = np.concatenate(values), np.concatenate(owner).astype(np.int64)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    if len(value):
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (own[1:] != own[:-1])])
        value, own = value[new], own[new]
    return value, np.bincount(own, minlength=words.count)
