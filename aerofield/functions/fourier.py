"""Vectorized transforms of array columns, and window shapes."""
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

REALS = T.ArrayType(T.DoubleType())
COMPLEX = T.StructType([T.StructField("re", REALS), T.StructField("im", REALS)])


def _by_length(arrays: list[np.ndarray], transform) -> list[np.ndarray]:
    """Apply a row-wise transform to arrays of one length at a time."""
    out = [None] * len(arrays)
    sizes: dict[int, list[int]] = {}
    for i, a in enumerate(arrays):
        sizes.setdefault(len(a), []).append(i)
    for n, idx in sizes.items():
        block = transform(np.stack([arrays[i] for i in idx])) if n else np.zeros((len(idx), 0))
        for i, row in zip(idx, block):
            out[i] = row
    return out


def _complex_frame(rows: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"re": [a.real.copy() for a in rows], "im": [a.imag.copy() for a in rows]})


@F.pandas_udf(COMPLEX)
def transform_arrays(re: pd.Series, im: pd.Series) -> pd.DataFrame:
    rows = [np.asarray(a, float) + 1j * np.asarray(b, float) for a, b in zip(re, im)]
    return _complex_frame(_by_length(rows, lambda m: np.fft.fft(m, axis=1)))


@F.pandas_udf(COMPLEX)
def transform_placed(at: pd.Series, re: pd.Series, im: pd.Series, size: pd.Series) -> pd.DataFrame:
    """Transform of values placed at indices of zero arrays of a given size."""
    rows = []
    for a, b, c, n in zip(at, re, im, size):
        full = np.zeros(int(n), dtype=complex)
        full[np.asarray(a, int)] = np.asarray(b, float) + 1j * np.asarray(c, float)
        rows.append(full)
    return _complex_frame(_by_length(rows, lambda m: np.fft.fft(m, axis=1)))


@F.pandas_udf(COMPLEX)
def invert_arrays(re: pd.Series, im: pd.Series) -> pd.DataFrame:
    rows = [np.asarray(a, float) + 1j * np.asarray(b, float) for a, b in zip(re, im)]
    return _complex_frame(_by_length(rows, lambda m: np.fft.ifft(m, axis=1)))


def window_values(kind: str, n: int) -> np.ndarray:
    """Periodic spectral windows."""
    t = 2 * math.pi * np.arange(n) / max(n, 1)
    shapes = {"boxcar": lambda: np.ones(n), "hann": lambda: 0.5 - 0.5 * np.cos(t),
              "hamming": lambda: 0.54 - 0.46 * np.cos(t),
              "blackman": lambda: 0.42 - 0.5 * np.cos(t) + 0.08 * np.cos(2 * t)}
    if kind not in shapes:
        raise ValueError(f"unknown spectral window {kind!r}")
    return np.ones(1) if n == 1 else shapes[kind]()


def power_spectrum(fs: float, window: str, nfft: int | None, detrend: str | None, onesided: bool,
                   scaling: str):
    """A pandas UDF from value arrays to their power per frequency bin."""
    if scaling not in ("density", "spectrum"):
        raise ValueError(f"unknown scaling {scaling!r}")

    def block(m: np.ndarray) -> np.ndarray:
        n = m.shape[1]
        size = max(nfft or n, n) if nfft is None or nfft >= n else nfft
        m = m[:, :size]
        w = window_values(window, m.shape[1])
        if detrend == "constant":
            m = m - m.mean(axis=1, keepdims=True)
        elif detrend == "linear" and m.shape[1] > 1:
            t = np.arange(m.shape[1]) - (m.shape[1] - 1) / 2
            m = m - m.mean(axis=1, keepdims=True)
            m = m - np.outer(m @ t / (t @ t), t)
        p = np.abs(np.fft.fft(m * w, size, axis=1)) ** 2
        p = p / (fs * (w ** 2).sum() if scaling == "density" else w.sum() ** 2)
        if onesided:
            p = p[:, :size // 2 + 1].copy()
            p[:, 1:(size + 1) // 2] *= 2
        return p

    @F.pandas_udf(REALS)
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(_by_length([np.asarray(a, float) for a in v], block))
    return run
