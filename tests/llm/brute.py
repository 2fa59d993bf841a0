"""Plain versions of the operators, one row at a time."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < width else frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near(rows, width, percent):
    """{doc_id: (set size, smallest reachable id)} by comparing all documents that share a shingle."""
    sets, parent, where = {i: shingles(t, width) for i, t in rows}, {i: i for i, _ in rows}, collections.defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    shared = collections.Counter((a, b) for ids in where.values() for k, b in enumerate(ids) for a in ids[:k])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def jump(key, shards):
    """Jump consistent hashing as published, one key at a time."""
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % 2**64
        ahead = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def statistics(text):
    """What the quality classifier counts, letter by letter."""
    data = text.encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in data)
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", low) if w]
    kinds = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*@^~_=+<>\\{}[]`", "!", "|", "\n", ".,;:?'\"()-/", "abcdefghijklmnopqrstuvwxyz"]
    counts = [sum(chr(c) in k for c in data) for k in kinds] + [sum(c >= 128 for c in data)]
    return [len(data), len(words), len(set(words)), sum(a == b for a, b in zip(words, words[1:])), sum(map(len, words)), *counts]
