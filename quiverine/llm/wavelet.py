"""Token ids as wavelet matrices, one compressed file for each shard.

A wavelet matrix keeps a sequence of ids as bit-planes, the highest bit first; each
plane is ordered by the bits above it. Ranks on the planes give the id at a place, the
number of times that an id occurs before a place, and the places where it occurs. A
file holds the planes, a directory of ranks and the documents' ids and lengths, all
compressed with zstd. Planes are compressed in frames of FRAME bytes, and a frame is read
and unpacked when it is needed: one access, rank or select of a file takes a frame or a
few of each plane.

Defined results: a null text counts as empty and is its end id alone; documents are in
order of their ids, null ids first and repeated ids by a hash of their texts; an empty table
writes no shard and gives no rows; further columns are not read. A document is never
split, so that one longer than a shard gets a shard of its own.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batches, file_system, ship, split_count, text_of
from .vocab import byte_alphabet, default_path, vocabulary
from .words import WordTable

MAGIC = b"QWM1"
#: Ranks are kept for every so many bits of a plane.
BLOCK = 4096
#: Bytes of a plane that are compressed together: a multiple of what a block of ranks covers.
FRAME = 1 << 15
#: Tokens of a shard; the shard ends with the document that reaches it.
SHARD_TOKENS = 1 << 21


class Plane:
    """A plane in a file: its frames are read and unpacked on demand, and a few of them are remembered."""

    def __init__(self, read: Callable[[int, int], bytes], frames: list[tuple[int, int]], size: int) -> None:
        self.read, self.frames, self.size = read, frames, size
        self.known: dict[int, np.ndarray] = {}
        #: Frames that were unpacked so far.
        self.unpacked = 0

    def frame(self, number: int) -> np.ndarray:
        if number not in self.known:
            if len(self.known) >= 4:
                self.known.pop(next(iter(self.known)))
            self.known[number] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.read(*self.frames[number])), np.uint8)
            self.unpacked += 1
        return self.known[number]

    def __getitem__(self, at: int | slice) -> Any:
        """A byte, or bytes of one frame."""
        if not isinstance(at, slice):
            return self.frame(at // FRAME)[at % FRAME]
        if at.start >= min(at.stop, self.size):
            return np.zeros(0, np.uint8)
        first = at.start // FRAME * FRAME
        return self.frame(at.start // FRAME)[at.start - first : at.stop - first]

    def whole(self) -> np.ndarray:
        return np.concatenate([self.frame(i) for i in range(len(self.frames))]) if self.frames else np.zeros(0, np.uint8)


class WaveletMatrix:
    """Ids as bit-planes with rank and select."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], planes: list[Any], ranks: list[np.ndarray]) -> None:
        self.n, self.alphabet, self.zeros, self.planes, self.ranks = n, alphabet, zeros, planes, ranks

    @property
    def levels(self) -> int:
        return len(self.planes)

    @staticmethod
    def build(ids: np.ndarray) -> WaveletMatrix:
        """Ids stand by their places in the order of frequency, so that high planes are nearly empty."""
        counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        alphabet = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        codes = np.zeros(len(counts), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        codes[alphabet] = np.arange(len(alphabet))
        now = codes[ids]
        one = now.dtype.type(1)
        zeros, planes, ranks = [], [], []
        for level in range(max(len(alphabet) - 1, 1).bit_length() - 1, -1, -1):
            bits = ((now >> now.dtype.type(level)) & one).astype(bool)
            # compress() copies without branching, several times as fast as a mask index here.
            low, high = np.compress(~bits, now), np.compress(bits, now)
            plane = np.packbits(bits, bitorder="little")
            zeros.append(len(low))
            planes.append(plane)
            ranks.append(_block_ranks(plane))
            now = np.concatenate([low, high])
        return WaveletMatrix(len(ids), alphabet, zeros, planes, ranks)

    def _ones(self, level: int, at: int) -> int:
        """The set bits of a plane before a place."""
        block = at // BLOCK
        plane, first = self.planes[level], block * BLOCK // 8
        count = int(self.ranks[level][block]) + int(np.bitwise_count(plane[first : at // 8]).sum())
        return count + (int(plane[at // 8] & ((1 << at % 8) - 1)).bit_count() if at % 8 else 0)

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at // 8]) >> (at % 8) & 1

    def _place(self, level: int, bit: int, number: int) -> int:
        """The place of the ``number``-th bit of a kind, from 0; places are found by halving."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > number:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        out = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, at), self._ones(level, at)
            out = out << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return int(self.alphabet[out])

    def _code(self, value: int) -> int:
        """What stands for an id in the planes, or -1."""
        at = np.flatnonzero(self.alphabet == value)
        return int(at[0]) if len(at) else -1

    def _span(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id before ``end`` lie below the last plane."""
        value, start = self._code(value), 0
        if value < 0:
            return 0, 0
        for level in range(self.levels):
            a, b = self._ones(level, start), self._ones(level, end)
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.levels - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def rank(self, value: int, end: int | None = None) -> int:
        """How often an id occurs before a place, or in all."""
        start, end = self._span(value, self.n if end is None else end)
        return end - start

    def select(self, value: int, number: int) -> int:
        """The place of an id's ``number``-th occurrence, from 0."""
        start, end = self._span(value, self.n)
        if not 0 <= number < end - start:
            raise IndexError(number)
        at, value = start + number, self._code(value)
        for level in range(self.levels - 1, -1, -1):
            bit = value >> (self.levels - 1 - level) & 1
            at = self._place(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, i) for i in range(self.rank(value))]

    def decode(self) -> np.ndarray:
        """All ids: from the last plane upwards, each plane tells which half an id goes to."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            plane = self.planes[level]
            bits = np.unpackbits(plane.whole() if isinstance(plane, Plane) else plane, count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, kind)
            zeros = self.zeros[level]
            up[np.flatnonzero(~bits)] = now[:zeros]
            up[np.flatnonzero(bits)] = now[zeros:] | kind(1 << (self.levels - 1 - level))
            now = up
        return self.alphabet[now] if self.n else np.zeros(0, np.int64)


def _block_ranks(plane: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-max(len(plane), 1) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
    padded[: len(plane)] = plane
    ones = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)


def to_bytes(doc_ids: list[int | None], lengths: list[int], matrix: WaveletMatrix) -> bytes:
    """The file of a shard: magic, length of the header, header as JSON, then its parts in order."""
    pack = zstandard.ZstdCompressor(level=1).compress
    ids = np.array([0 if i is None else i for i in doc_ids], "<i8")
    missing = np.array([i is None for i in doc_ids], np.uint8)
    parts = [pack(x.tobytes()) for x in (ids, missing, np.array(lengths, "<i8"), matrix.alphabet.astype("<u4"))]
    for plane, ranks in zip(matrix.planes, matrix.ranks, strict=True):
        parts += [pack(ranks.astype("<u4").tobytes()), *(pack(plane[at : at + FRAME].tobytes()) for at in range(0, len(plane), FRAME))]
    header = json.dumps({"documents": len(doc_ids), "tokens": matrix.n, "zeros": matrix.zeros, "frame": FRAME, "parts": [len(p) for p in parts]}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(parts)


class Shard:
    """A file of a shard, of which only what is asked for is read and unpacked. ``read`` gives bytes by place and size."""

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        start = read(0, 8)
        if start[:4] != MAGIC:
            raise ValueError("not a wavelet file")
        n = struct.unpack_from("<I", start, 4)[0]
        self.header = json.loads(read(8, n))
        if self.header["frame"] != FRAME:
            raise ValueError("a wavelet file of another frame size")
        sizes = self.header["parts"]
        ends = (8 + n + np.cumsum(sizes)).tolist()
        self.read, self.parts = read, [(e - s, s) for e, s in zip(ends, sizes, strict=True)]
        tokens, levels = self.header["tokens"], len(self.header["zeros"])
        size = -(-tokens // 8)
        step = 1 + -(-size // FRAME)
        at = [4 + step * level for level in range(levels)]
        planes = [Plane(read, self.parts[a + 1 : a + step], size) for a in at]
        self.matrix = WaveletMatrix(tokens, self._part(3, "<u4"), self.header["zeros"], planes, [self._part(a, "<u4") for a in at])

    def _part(self, number: int, kind: str) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.read(*self.parts[number])), kind)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The documents' ids and lengths."""
        ids, missing = self._part(0, "<i8"), self._part(1, np.uint8)
        return [None if m else i for i, m in zip(ids.tolist(), missing.tolist(), strict=True)], self._part(2, "<i8")


def from_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """The documents' ids and lengths, and the matrix of a file's content."""
    shard = Shard(lambda at, size: data[at : at + size])
    return *shard.documents(), shard.matrix


def open_shard(uri: str, name: str) -> Shard:
    """A file in a folder, read part by part; the folder is named as ``qualified`` gives it."""
    system, path = open_folder(uri)
    f = system.open_input_file(f"{path}/{name}")
    return Shard(lambda at, size: f.read_at(size, at))


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and authority under which Spark knows it: a bare path lies on the default file system."""
    files, path = file_system(spark, folder)
    return files.makeQualified(path).toString()


def open_folder(uri: str):  # noqa: ANN201
    """The file system of a folder that executors share, and the folder's path there.

    Python workers reach local, hdfs, s3 and gs folders, with the credentials of their environment. A bare path
    would be one on the executor's own disk, and other schemes are known to Spark alone: both raise.
    """
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or scheme not in ("file", "hdfs", "s3", "s3a", "gs"):
        raise ValueError(f"token files can't be written to {uri}")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def put(uri: str, name: str, data: bytes) -> None:
    """Write a file whole: under another name first, so that a task that is run again or twice leaves one file."""
    system, path = open_folder(uri)
    system.create_dir(path, recursive=True)
    hidden = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as out:
        out.write(data)
    system.move(hidden, f"{path}/{name}")


def get(uri: str, name: str) -> bytes:
    """A file's content."""
    system, path = open_folder(uri)
    with system.open_input_stream(f"{path}/{name}") as f:
        return f.read()


class Ids:
    """Ids of texts as the tokenizers library gives them.

    Most words of a text were seen before, and are remembered within a bound. The
    pieces of new ones go to the library's model many at a time, spelled in the byte
    alphabet and parted by a byte that no UTF-8 text has; texts in which words can't be
    told apart go to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.vocab = vocabulary(path)
        self.kind = self.vocab.kind
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bare = {"version": "1.0", "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}, "model": spec["model"]}
        self.model = Tokenizer.from_str(json.dumps(bare))
        self.spelling = str.maketrans({chr(b): c for c, b in byte_alphabet().items()})
        self.bar = "\xff".translate(self.spelling)
        self.bar_id = self.model.token_to_id(self.bar)
        self.table = WordTable(self.words, self.whole, self.kind)

    def whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 256):
            found = self.vocab.library.encode_batch_fast(texts[at : at + 256], add_special_tokens=False)
            out += [np.array(e.ids, self.kind).tobytes() for e in found]
        return out

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of some ordinary pieces, as bytes."""
        spelled = b"\xff".join([p.encode("utf-8", "surrogatepass") for p in pieces])
        names = spelled.decode("latin-1").translate(self.spelling).split(self.bar)
        lines = [f" {self.bar} ".join(names[i : i + 200]) for i in range(0, len(names), 200)]
        out: list[bytes] = []
        width = np.dtype(self.kind).itemsize
        for e in self.model.encode_batch_fast(lines, add_special_tokens=False):
            ids = np.array(e.ids, self.kind)
            bars = np.flatnonzero(ids == self.bar_id) * width
            raw = ids.tobytes()
            out += [raw[i:j] for i, j in zip([0, *(bars + width).tolist()], [*bars.tolist(), len(raw)], strict=True)]
        return out

    def words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 20_000):
            pieces, starts = self.vocab.cut(words[at : at + 20_000])
            new = [p for p in dict.fromkeys(pieces) if isinstance(p, str)]
            known: dict[str | int, bytes] = dict(zip(new, self._of_pieces(new), strict=True)) if new else {}
            known |= {i: np.array([i], self.kind).tobytes() for i in self.vocab.special.values()}
            found = [known[p] for p in pieces]
            raw = b"".join(found)
            bounds = [*np.cumsum([0, *map(len, found)])[starts].tolist(), len(raw)]
            out += [raw[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.table.encode(texts) if self.vocab.chunkable else self.whole(texts)


_ids: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def write_shards(docs: DataFrame, folder: str, scratch: Scratch, tokenizer: str | None = None, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids as wavelet files in ascending order of doc_id; returns (part, seq, name, documents, tokens).

    Texts move once, to range partitions, and are encoded there. A task holds the
    tokens of one shard at a time.
    """
    spark = docs.sparkSession
    ship(spark)
    path, folder = tokenizer or default_path(), qualified(spark, folder)
    kind = vocabulary(path).kind

    def build(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = ["part", "seq", "name", "documents", "tokens"]
        own, end = ids_of(path), np.array([end_id], kind).tobytes()
        held: list[bytes] = []
        doc_ids: list[int | None] = []
        tokens, part, seq = 0, None, 0

        def close() -> pa.RecordBatch:
            sizes = [len(x) // np.dtype(kind).itemsize for x in held]
            data = to_bytes(doc_ids, sizes, WaveletMatrix.build(np.frombuffer(b"".join(held), kind)))
            put(folder, name := f"shard-{part:06d}-{seq:06d}.wm", data)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, seq, name, len(held), sum(sizes))], names=names)

        for batch in batches(rows, "text"):
            part = batch.column("part")[0].as_py()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode(batch.column("text").to_pylist()), strict=True):
                held.append(ids + end)
                doc_ids.append(doc_id)
                tokens += len(held[-1]) // np.dtype(kind).itemsize
                if tokens >= shard_tokens:
                    yield close()
                    held, doc_ids, tokens, seq = [], [], 0, seq + 1
        if held:
            yield close()

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    ranged = given.repartitionByRange(split_count(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    shards = ranged.select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "text").mapInArrow(build, "part long, seq long, name string, documents long, tokens long")
    return scratch.table(shards, "manifest")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    ``manifest``, a row for each shard, names the files and tells where each shard
    starts; a task opens one file at a time, and no file's content is moved.
    """
    folder = qualified(spark, folder)
    over = "ORDER BY part, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    starts = manifest.select("name", F.expr(f"coalesce(sum(tokens) OVER ({over}), 0)").alias("shard_start"))

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("shard_start").to_pylist(), strict=True):
                doc_ids, lengths, matrix = from_bytes(get(folder, name))
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(ends - lengths + first), pa.array(lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = starts.repartition(split_count(spark))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids to the shared folder and read the files back."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "wavelet")
    folder = scratch.path("shards")
    manifest = write_shards(docs, folder, scratch, tokenizer, end_id, shard_tokens, id_col, text_col)
    return read_shards(spark, folder, manifest)
