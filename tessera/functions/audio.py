"""The front end of a speech model: windows, filter bank, spectra, normalisation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hann(n: int, periodic: bool = True) -> Column:
    """F1."""
    m = n if periodic else n - 1
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: 0.5 * (1 - F.cos(2 * math.pi * i / m)))


def mel_filters(n_mel: int, n_fft: int, rate: int, low: float = 0.0, high: float = 0.0, htk: bool = False, area: bool = True) -> np.ndarray:
    """triangles between neighbouring points that are even on the mel scale, by bins of the spectrum."""
    high = high or rate / 2
    if htk:
        to_mel, to_hz = (lambda f: 2595 * math.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    else:  # linear below 1 kHz, logarithmic above
        step = math.log(6.4) / 27
        to_mel = lambda f: f * 3 / 200 if f < 1000 else 15 + math.log(f / 1000) / step
        to_hz = lambda m: m * 200 / 3 if m < 15 else 1000 * math.exp((m - 15) * step)
    hz = np.array([to_hz(m) for m in np.linspace(to_mel(low), to_mel(high), n_mel + 2)])
    f = np.arange(n_fft // 2 + 1) * rate / n_fft
    left, centre, right = hz[:-2, None], hz[1:-1, None], hz[2:, None]
    out = np.maximum(0, np.minimum((f - left) / np.maximum(1e-30, centre - left), (right - f) / np.maximum(1e-30, right - centre)))
    return out * (2 / np.maximum(1e-30, right - left)) if area else out


def spectrum(c, inverse: bool = False) -> Column:
    """the discrete Fourier transform of an array as (re, im); inverse: of such a pair, the real part."""
    if inverse:

        @F.pandas_udf("array<double>")
        def back(s: pd.DataFrame) -> pd.Series:
            return pd.Series([np.fft.ifft(np.asarray(a) + 1j * np.asarray(b)).real for a, b in zip(s["re"], s["im"], strict=True)])

        return back(c)

    @F.pandas_udf("re array<double>, im array<double>")
    def run(s: pd.Series) -> pd.DataFrame:
        got = [np.fft.fft(np.asarray(x, float)) for x in s]
        return pd.DataFrame({"re": [g.real for g in got], "im": [g.imag for g in got]})

    return run(c)


def log_mel(clips: DataFrame, n_mel: int, n_fft: int, hop: int, rate: int, floor: float = 5.960464477539063e-08, natural: bool = False, magnitude: bool = False) -> DataFrame:
    """clips(clip_id, samples) to (clip_id, frame, mel array): Hann windows every hop, power spectrum, filter bank, logarithm."""
    filters = mel_filters(n_mel, n_fft, rate).T
    window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(n_fft) / n_fft))

    @F.pandas_udf("array<array<double>>")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            x = np.asarray(x, float)
            if len(x) < n_fft:
                return []
            frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop] * window
            power = np.abs(np.fft.rfft(frames, axis=1)) ** (1 if magnitude else 2)
            out = np.maximum(power @ filters, floor)
            return list(np.log(out) if natural else np.log10(out))

        return s.map(one)

    return clips.select("clip_id", F.posexplode(run("samples")).alias("frame", "mel"))


def clamped(frames: DataFrame) -> DataFrame:
    """values at least the clip's greatest less 8, then (x + 4) / 4."""
    top = F.max(F.array_max("mel")).over(Window.partitionBy("clip_id"))
    return frames.withColumn("_top", top).withColumn("mel", F.transform("mel", lambda x: (F.greatest(x, F.col("_top") - 8.0) + 4.0) / 4.0)).drop("_top")


def standardised(frames: DataFrame) -> DataFrame:
    """each mel bin less its mean over the clip, by its deviation (unbiased, with 1e-5 under the root): (clip_id, frame, bin, v)."""
    rows = frames.select("clip_id", "frame", F.posexplode("mel").alias("bin", "v"))
    own = Window.partitionBy("clip_id", "bin")
    return rows.withColumn("v", (F.col("v") - F.avg("v").over(own)) / F.sqrt(F.var_samp("v").over(own) + 1e-5))


def chunked(frames: DataFrame, n: int = 3000) -> DataFrame:
    """F7."""
    return frames.withColumn("chunk", F.floor(F.col("frame") / n)).withColumn("frame_in_chunk", F.col("frame") % n)
