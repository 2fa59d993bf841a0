"""Audio: WAV files of 16-bit samples, and features of their windows."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tabular import fitted, unit

#: Settings (fixed values).
RATE, SECONDS, N_FFT, HOP, DIMENSION = 16_000, 10, 2048, 512, 512


def decode(raw: bytes) -> np.ndarray:
    """The mean of the channels, as numbers between -1 and 1, of up to SECONDS at RATE; not resampled."""
    try:
        with wave.open(io.BytesIO(raw)) as file:
            width, channels, frames = file.getsampwidth(), file.getnchannels(), file.getnframes()
            data = file.readframes(min(frames, SECONDS * RATE)) if width == 2 else b""
    except (wave.Error, EOFError) as e:
        raise ValueError(f"only WAV files of PCM samples are supported: {e}") from e
    if not data:
        raise ValueError("only 16-bit PCM is supported")
    samples = np.frombuffer(data[: len(data) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels)
    return samples.sum(1) / (32768.0 * channels)


def _windows(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop] if len(x) >= size else np.zeros((0, size))


def temporal(x: np.ndarray) -> np.ndarray:
    """Mean, deviation, energy and share of sign changes of each window."""
    size = min(N_FFT, 1024)
    w = _windows(x, size, min(HOP, size))
    changes = (w[:, 1:] * w[:, :-1] < 0).sum(1) / (size - 1)
    return np.stack([w.mean(1), np.sqrt(w.var(1) + 1e-12), (w * w).sum(1) / size, changes], 1).ravel()


def spectral(x: np.ndarray) -> np.ndarray:
    """Centroid and bandwidth of each window's spectrum, as shares of half the window."""
    size = min(N_FFT, 512)
    magnitude = np.abs(np.fft.rfft(_windows(x, size, min(HOP, size)), axis=1)) + 1e-6
    k = np.arange(size // 2 + 1)
    whole = magnitude.sum(1)
    centroid = (magnitude * k).sum(1) / whole
    width = np.sqrt((magnitude * (k - centroid[:, None]) ** 2).sum(1) / whole)
    return (np.stack([centroid, width], 1) / (size // 2)).ravel()


def encode(raw: bytes, dim: int = DIMENSION) -> np.ndarray:
    x = decode(raw)
    return unit(fitted(np.concatenate([temporal(x), spectral(x)]), dim))


def process(raw: Column) -> Column:
    @F.pandas_udf("array<double>")
    def embed(part: pd.Series) -> pd.Series:
        return part.map(lambda b: encode(bytes(b)) if b else None)

    return embed(raw)


def is_valid(raw: Column) -> Column:
    """Not empty, as for images."""
    return F.octet_length(raw) > 0
