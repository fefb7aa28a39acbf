"""Phase and spectral metrics of channel pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import pair_sums, plv


def compute_plv(signal: DataFrame) -> DataFrame:
    """run, u, v, plv of u < v over all samples."""
    return pair_sums(signal, ["run"]).where("u < v").select("run", "u", "v", plv(F.col("re"), F.col("im"), F.col("n")).alias("plv"))


def _differences(signal: DataFrame) -> DataFrame:
    a = signal.select("run", "t", F.col("channel").alias("u"), F.col("phase").alias("a"))
    b = signal.select("run", "t", F.col("channel").alias("v"), F.col("phase").alias("b"))
    return a.join(b, ["run", "t"]).where("u < v").select("run", "t", "u", "v", "a", "b")


def compute_wpli(signal: DataFrame) -> DataFrame:
    """run, u, v, wpli = |mean sin| / mean |sin| of the phase difference; 0 where the denominator vanishes."""
    s = F.sin(F.col("a") - F.col("b"))
    got = _differences(signal).groupBy("run", "u", "v").agg(F.abs(F.avg(s)).alias("top"), F.avg(F.abs(s)).alias("low"))
    return got.select("run", "u", "v", F.when(F.col("low") < 1e-15, 0.0).otherwise(F.col("top") / F.nullif("low", F.lit(0.0))).alias("wpli"))


def circular_correlation(signal: DataFrame) -> DataFrame:
    """run, u, v, ccorr with means adjusted for the pair: two aggregates, angles between them."""
    d = _differences(signal)
    angle = lambda x: F.atan2(F.sum(F.sin(x)), F.sum(F.cos(x)))
    norm = lambda x: F.sqrt(F.pow(F.sum(F.sin(x)), F.lit(2.0)) + F.pow(F.sum(F.cos(x)), F.lit(2.0)))
    minus, plus = F.col("a") - F.col("b"), F.col("a") + F.col("b")
    first = d.groupBy("run", "u", "v").agg(angle(minus).alias("pm"), angle(plus).alias("pp"), norm(minus).alias("nm"), norm(plus).alias("np"))
    means = first.select("run", "u", "v", "nm", "np", ((F.col("pm") + F.col("pp")) / 2).alias("ma"), ((F.col("pp") - F.col("pm")) / 2).alias("mb"))
    sq = lambda x, m: F.sum(F.pow(F.sin(F.col(x) - F.col(m)), F.lit(2.0)))
    second = d.join(means, ["run", "u", "v"]).groupBy("run", "u", "v", "nm", "np").agg(sq("a", "ma").alias("sa"), sq("b", "mb").alias("sb"))
    low = 2 * F.sqrt(F.col("sa") * F.col("sb"))
    return second.select("run", "u", "v", F.coalesce(F.abs((F.col("nm") - F.col("np")) / F.nullif(low, F.lit(0.0))), F.lit(0.0)).alias("ccorr"))


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal along the last axis."""
    n = x.shape[-1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=-1) * h, axis=-1)


def hilbert_phase(signal: DataFrame, band: tuple[float, float] | None = None, fs: float = 1.0) -> DataFrame:
    """run, channel, t, phase of (run, channel, t, x); with a band, frequencies outside it are cleared first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x = pdf["x"].to_numpy(float)
        if band:
            f = np.fft.rfftfreq(len(x), 1 / fs)
            x = np.fft.irfft(np.where((f >= band[0]) & (f <= band[1]), np.fft.rfft(x), 0), len(x))
        return pdf[["run", "channel", "t"]].assign(phase=np.angle(analytic(x)))

    rows = signal.select(F.col("run").cast("string").alias("run"), F.col("channel").cast("int").alias("channel"), F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x"))
    return rows.groupBy("run", "channel").applyInPandas(run, "run string, channel int, t long, phase double")


def welch(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Cross spectral density by Hann segments with half overlap, means removed; up to a factor common to all."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    starts = range(0, len(x) - size + 1, size - size // 2)
    f = lambda s: np.fft.rfft(np.stack([(s[i : i + size] - s[i : i + size].mean()) * w for i in starts]), axis=1)
    return (np.conj(f(x)) * f(y)).mean(0)


def compute_imaginary_coherence(signal: DataFrame, fs: float, nperseg: int | None = None) -> DataFrame:
    """run, u, v, frequency, coherence = |Im(Pxy / sqrt(Pxx Pyy))| of (run, channel, t, x), u < v; a group a pair."""
    arrays = signal.groupBy("run", "channel").agg(F.sort_array(F.collect_list(F.struct("t", F.col("x").cast("double").alias("x")))).alias("s"))
    arrays = arrays.select(F.col("run").cast("string").alias("run"), F.col("channel").cast("int").alias("channel"), F.col("s.x").alias("x"))
    a, b = arrays.withColumnsRenamed({"channel": "u", "x": "a"}), arrays.withColumnsRenamed({"channel": "v", "x": "b"})

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                n = min(len(r.a), len(r.b))
                x, y, size = np.asarray(r.a[:n]), np.asarray(r.b[:n]), nperseg or min(256, n)
                low = np.maximum(np.sqrt(np.abs(welch(x, x, size)) * np.abs(welch(y, y, size))), 1e-15)
                c = np.abs(np.imag(welch(x, y, size) / low))
                yield pd.DataFrame({"run": r.run, "u": r.u, "v": r.v, "frequency": np.fft.rfftfreq(size, 1 / fs), "coherence": c})

    return a.join(b, "run").where("u < v").mapInPandas(run, "run string, u int, v int, frequency double, coherence double")
