"""Token ids of texts, word by word, from a table of words that were met before.

All words of a batch are hashed at once and looked up in a hash table of arrays. A word
counts as known only if its bytes equal those in the table; the ids of new words are
worked out and added. Words whose hash another word has already, and very long ones,
are worked out each time. A document's ids are then gathered from the table's pool,
without a step for each word.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .shingles import SHORT, block, eights, word_hashes

#: Words that a table holds at most before it is begun anew.
MOST_WORDS = 1_200_000
#: Words that are looked up at once.
AT_ONCE = 1 << 19
#: Bytes that may begin a white-space character: such words are looked at one by one.
_MAY_BE_SPACE = np.zeros(256, bool)
_MAY_BE_SPACE[[*range(9, 14), *range(28, 32), 0xC2, 0xE1, 0xE2, 0xE3]] = True


class Growing:
    """An array that is appended to; room doubles, so that each item is copied about once."""

    def __init__(self, kind: np.dtype | type) -> None:
        self.room, self.size = np.zeros(1024, kind), 0

    def append(self, items: np.ndarray) -> None:
        if (need := self.size + len(items)) > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.zeros(max(need, 2 * len(self.room)) - self.size, self.room.dtype)])
        self.room[self.size : need] = items
        self.size = need


class WordTable:
    """``words`` gives the ids (as bytes) of words, each taken with a space before it; ``whole`` those of texts."""

    def __init__(self, words: Callable[[list[str]], list[bytes]], whole: Callable[[list[str]], list[bytes]], kind: str) -> None:
        self.words, self.whole, self.kind = words, whole, np.dtype(kind)
        self._clear()

    def _clear(self) -> None:
        """Entries are numbered; ``slots`` has their numbers, or -1, at their hashes or after."""
        self.slots = np.full(1 << 21, -1, np.int32)
        self.keys, self.shapes, self.lead, self.rest, self.more = Growing(np.uint64), Growing(np.int64), Growing(np.uint64), Growing(np.int64), Growing(np.uint64)
        self.offsets, self.counts, self.pool = Growing(np.int64), Growing(np.int32), Growing(self.kind)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        last = len(self.slots) - 1
        at = (keys & np.uint64(last)).astype(np.int64)
        found = self.slots[at]
        open_ = np.flatnonzero((found >= 0) & (self.keys.room[found] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & last
            found[open_] = self.slots[at[open_]]
            own = found[open_]
            open_ = open_[(own >= 0) & (self.keys.room[own] != keys[open_])]
        return found

    def _add(self, keys: np.ndarray, shapes: np.ndarray, starts: np.ndarray, view: np.ndarray, ids: list[bytes]) -> None:
        """New entries with different hashes, none of which is there."""
        number = np.arange(self.keys.size, self.keys.size + len(keys), dtype=np.int32)
        sizes = shapes >> 1
        self.keys.append(keys)
        self.shapes.append(shapes)
        self.lead.append(block(view, starts, sizes, 0))
        beyond = np.maximum(-(-sizes // 8) - 1, 0)
        ends = np.cumsum(beyond)
        self.rest.append(self.more.size + ends - beyond)
        more = np.repeat(starts, beyond) + 8 * (np.arange(int(beyond.sum())) - np.repeat(ends - beyond, beyond) + 1)
        self.more.append(block(view, more, np.repeat(starts + sizes, beyond) - more, 0))
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        self.offsets.append(self.pool.size + np.cumsum(counts) - counts)
        self.counts.append(counts)
        self.pool.append(np.frombuffer(b"".join(ids), self.kind))
        last = len(self.slots) - 1
        at = (keys & np.uint64(last)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.slots[at[todo]] < 0]
            self.slots[at[free]] = number[free]
            todo = todo[self.slots[at[todo]] != number[todo]]
            at[todo] = (at[todo] + 1) & last

    def _same(self, found: np.ndarray, shapes: np.ndarray, starts: np.ndarray, view: np.ndarray) -> np.ndarray:
        """Whether words have the bytes of the entries found for them."""
        sizes = shapes >> 1
        same = (found >= 0) & (self.shapes.room[found] == shapes)
        same &= self.lead.room[found] == block(view, starts, sizes, 0)
        more, j = np.flatnonzero(same & (sizes > 8)), 1
        while len(more):
            same[more] = self.more.room[self.rest.room[found[more]] + j - 1] == block(view, starts[more], sizes[more], j)
            j += 1
            more = more[sizes[more] > 8 * j]
        return same

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes; texts in which spaces don't part words are taken whole."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        # Every text gets a space before it and one after the last; so each space begins a word.
        data = np.frombuffer(b" ".join([b"", *raw, bytes(8)]), np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        begin = np.cumsum(lengths + 1) - lengths  # of each text
        space = np.flatnonzero(data[:-8] == 32)
        start, size = space[:-1] + 1, np.diff(space) - 1
        doc = np.searchsorted(begin, start, "right") - 1
        first = start == begin[doc]  # begins a text, so there is no space of the text before it
        odd = np.zeros(len(texts), bool)
        odd[doc[(size == 0) & (~first | (lengths[doc] > 0))]] = True
        lead = np.where(size > 0, data[np.minimum(start, len(data) - 1)], 65)
        for i in np.flatnonzero(_MAY_BE_SPACE[lead] & ~first).tolist():
            if bytes(data[start[i] : start[i] + 4]).decode("utf-8", "ignore")[:1].isspace():
                odd[doc[i]] = True
        keep = ~odd[doc] & (size > 0)
        start, size, doc, first = start[keep], size[keep], doc[keep], first[keep]
        pieces: dict[int, bytes] = dict(zip(np.flatnonzero(odd).tolist(), self.whole([t for t, o in zip(texts, odd.tolist(), strict=True) if o]), strict=True))
        if len(start):
            parts = [self._ids(data, start[i : i + AT_ONCE], size[i : i + AT_ONCE], first[i : i + AT_ONCE]) for i in range(0, len(start), AT_ONCE)]
            counts = np.concatenate([c for _, c in parts])
            ends = np.cumsum(np.bincount(doc, counts, len(texts)).astype(np.int64)) * self.kind.itemsize
            flat = b"".join([t.tobytes() for t, _ in parts])
            bounds = [0, *ends.tolist()]
            found = [flat[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
        else:
            found = [b""] * len(texts)
        return [pieces.get(i, x) for i, x in enumerate(found)]

    def _worked_out(self, data: np.ndarray, starts: np.ndarray, shapes: np.ndarray) -> list[bytes]:
        """The ids of words, each with a space before it but those that begin a text."""
        base = int(starts.min())
        raw = data[base : int((starts + (shapes >> 1)).max())].tobytes()
        spelled = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip((starts - base).tolist(), (starts - base + (shapes >> 1)).tolist(), strict=True)]
        plainly = (shapes & 1).astype(bool).tolist()
        of = {True: self.whole, False: self.words}
        ids = {k: iter(of[k]([w for w, p in zip(spelled, plainly, strict=True) if p is k])) for k in (True, False)}
        return [next(ids[p]) for p in plainly]

    def _ids(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each word has."""
        view = eights(data)
        shapes = size * 2 + first
        keys = word_hashes(data, start, size, first)
        found = self._find(keys)
        short = size <= SHORT
        new = np.flatnonzero((found < 0) & short)
        if len(new):
            new = new[np.unique(keys[new], return_index=True)[1]]
            if self.keys.size and self.keys.size + len(new) > MOST_WORDS:
                self._clear()
                new = np.flatnonzero(short)
                new = new[np.unique(keys[new], return_index=True)[1]]
            self._add(keys[new], shapes[new], start[new], view, self._worked_out(data, start[new], shapes[new]))
            found = self._find(keys)
        offset, counts, pool = self.offsets.room[found], self.counts.room[found].astype(np.int64), self.pool.room[: self.pool.size]
        alone = np.flatnonzero(~self._same(found, shapes, start, view))
        if len(alone):
            ids = self._worked_out(data, start[alone], shapes[alone])
            own = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
            offset[alone], counts[alone] = len(pool) + np.cumsum(own) - own, own
            pool = np.concatenate([pool, np.frombuffer(b"".join(ids), self.kind)])
        ends = np.cumsum(counts)
        return pool[np.repeat(offset - ends + counts, counts) + np.arange(int(ends[-1]))], counts
