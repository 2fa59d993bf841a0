"""Images and video: histograms and texture of decoded pixels.

PNG and BMP payloads of plain kinds are decoded here; other formats need a decoder that
isn't part of this engine, and raise.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tabular import fitted, unit

#: Settings (fixed values).
SIDE, BINS, DIMENSION, VIDEO_DIMENSION, MOST_FRAMES = 224, 32, 2048, 1024, 32
#: First bytes of known formats (fixed values).
MAGIC = {"png": ("89504E47",), "jpg": ("FFD8",), "bmp": ("424D",), "tiff": ("4949", "4D4D"), "riff": ("52494646",), "id3": ("494433",)}


def sniffed(raw: Column) -> Column:
    """The format that a payload of at least four bytes begins like, or null."""
    start, out = F.hex(F.substring(raw, 1, 4)), F.lit(None).cast("string")
    for name, beginnings in MAGIC.items():
        for own in beginnings:
            out = F.when(start.startswith(own), name).otherwise(out)
    return F.when(F.octet_length(raw) >= 4, out)


def is_valid(raw: Column) -> Column:
    """Not empty: a payload isn't held to its format before it is decoded."""
    return F.octet_length(raw) > 0


def decode(raw: bytes) -> np.ndarray:
    """Pixels as (height, width, 3) bytes in the order blue, green, red."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(raw)
    if raw[:2] == b"BM":
        return _bmp(raw)
    raise ValueError("no decoder for this image format")


def _png(raw: bytes) -> np.ndarray:
    at, packed, width = 8, b"", 0
    while at + 8 <= len(raw):
        size, name = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or kind not in (0, 2, 4, 6) or interlaced:
                raise ValueError("only plain 8-bit PNG images are supported")
        elif name == b"IDAT":
            packed += body
        at += 12 + size
    if not width:
        raise ValueError("not a PNG image")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width, channels), np.uint8)
    above = np.zeros((width, channels), np.uint8)
    for y in range(height):
        rule, line = int(lines[y, 0]), lines[y, 1:].reshape(width, channels)
        if rule == 1:
            line = np.cumsum(line, 0, dtype=np.uint8)
        elif rule == 2:
            line = line + above
        elif rule:
            line = _from_the_left(rule, line, above)
        out[y] = above = line
    return np.repeat(out[:, :, :1], 3, 2) if channels < 3 else out[:, :, 2::-1]


def _from_the_left(rule: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A line of the rules that need each byte's left neighbour: channel by channel, in plain numbers."""
    out = np.empty_like(line)
    for c in range(line.shape[1]):
        left = corner = 0
        own = []
        for value, up in zip(line[:, c].tolist(), above[:, c].tolist(), strict=True):
            if rule == 3:
                guess = (left + up) // 2
            else:
                p = left + up - corner
                a, b, d = abs(p - left), abs(p - up), abs(p - corner)
                guess = left if a <= b and a <= d else up if b <= d else corner
            left, corner = (value + guess) & 255, up
            own.append(left)
        out[:, c] = own
    return out


def _bmp(raw: bytes) -> np.ndarray:
    start, = struct.unpack_from("<I", raw, 10)
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", raw, 18)
    if bits not in (24, 32) or packing:
        raise ValueError("only plain BMP images are supported")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    pixels = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, :3]
    return pixels[::-1] if height > 0 else pixels


def resize(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Bilinear, with pixel centres aligned."""
    out = pixels.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape([-1 if a == axis else 1 for a in range(3)])
        out = np.take(out, low, axis) * (1 - part) + np.take(out, np.minimum(low + 1, n - 1), axis) * part
    return out


def features(pixels: np.ndarray) -> np.ndarray:
    """Histograms of the channels, and mean and deviation of the gray image's derivatives."""
    x = resize(pixels) / 255.0
    parts = [np.histogram(x[:, :, c], BINS, (0.0, 1.0))[0] / max(1.0, x[:, :, c].size) for c in range(3)]
    gray = x @ np.array([0.114, 0.587, 0.299])
    p = np.pad(gray, 1, mode="reflect")
    across = p[:, 2:] - p[:, :-2]
    down = p[2:] - p[:-2]
    dx = across[:-2] + 2 * across[1:-1] + across[2:]
    dy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    bend = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * gray
    return np.concatenate([*parts, [f(d) for d in (dx, dy, bend) for f in (np.mean, np.std)]])


def encode(raw: bytes, dim: int = DIMENSION) -> np.ndarray:
    return unit(fitted(features(decode(raw)), dim))


def encode_video(frames: Sequence[bytes], dim: int = VIDEO_DIMENSION) -> np.ndarray:
    """The mean of the features of up to MOST_FRAMES evenly spaced frames."""
    step = max(1, len(frames) // MOST_FRAMES)
    chosen = list(frames)[::step][:MOST_FRAMES]
    return unit(fitted(np.mean([features(decode(bytes(f))) for f in chosen], 0), dim)) if chosen else np.zeros(dim)


def process(raw: Column) -> Column:
    @F.pandas_udf("array<double>")
    def embed(part: pd.Series) -> pd.Series:
        return part.map(lambda b: encode(bytes(b)) if b else None)

    return embed(raw)


def process_video(frames: Column) -> Column:
    """``frames`` is an array of image payloads."""

    @F.pandas_udf("array<double>")
    def embed(part: pd.Series) -> pd.Series:
        return part.map(lambda f: encode_video(f) if f is not None else None)

    return embed(frames)
