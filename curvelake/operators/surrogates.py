"""Surrogate data: what destroys one kind of structure and keeps the rest. All draws are md5 values of a seed and keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stats import _order


def uniform(seed: int, *keys: Column) -> Column:
    """In [0, 1): 52 bits of the md5 of seed and keys."""
    return F.conv(F.substring(_order(seed, *keys), 1, 13), 16, 10).cast("double") / float(1 << 52)


def circular_time_shift(signal: DataFrame, length: int, min_shift: int = 1, seed: int = 42, by: tuple[str, ...] = ("run", "channel"), column: str = "phase") -> DataFrame:
    """Each channel rolled by its own shift in [min_shift, length - min_shift)."""
    if length <= 2 * min_shift:
        raise ValueError("a signal must be longer than twice the least shift")
    shift = min_shift + F.floor(uniform(seed, *(F.col(c) for c in by)) * (length - 2 * min_shift)).cast("long")
    return signal.select(*by, ((F.col("t") + shift) % length).alias("t"), column)


def derangement(ids: DataFrame, column: str, seed: int = 42) -> DataFrame:
    """column, partner: a random cycle, so for two or more ids nobody is their own partner."""
    order = Window.orderBy(_order(seed, F.col(column)), column)
    first = F.first(column).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ids.select(column).distinct().select(column, F.coalesce(F.lead(column).over(order), first).alias("partner"))


def dyad_subject_swap(signal: DataFrame, seed: int = 42) -> DataFrame:
    """signal(dyad, subject 0 or 1, ...): subject 1 of each dyad comes from its partner of a derangement."""
    cycle = derangement(signal.select("dyad"), "dyad", seed)
    rest = [c for c in signal.columns if c != "dyad"]
    other = signal.where("subject = 1").join(cycle.select(F.col("partner").alias("dyad"), F.col("dyad").alias("_to")), "dyad").select(F.col("_to").alias("dyad"), *rest)
    return signal.where("subject = 0").select("dyad", *rest).unionByName(other)


def dyad_label_shuffle(rows: DataFrame, key: str = "id", label: str = "dyad", seed: int = 42) -> DataFrame:
    """key, label: labels permuted over all rows."""
    a = rows.select(key, F.row_number().over(Window.orderBy(key)).alias("_r"))
    b = rows.select(label, F.row_number().over(Window.orderBy(_order(seed, F.col(key)), key)).alias("_r"))
    return a.join(b, "_r").select(key, label)


def condition_label_shuffle_within_dyad(rows: DataFrame, key: str = "id", blocks: bool = True, seed: int = 42) -> DataFrame:
    """key, dyad, trial, condition: labels permuted within dyads, of whole trials (the label of a trial's first row) or of rows."""
    if blocks:
        units = rows.groupBy("dyad", "trial").agg(F.min_by("condition", key).alias("condition"))
        unit = "trial"
    else:
        units, unit = rows.select("dyad", key, "condition"), key
    w = Window.partitionBy("dyad")
    a = units.select("dyad", unit, F.row_number().over(w.orderBy(unit)).alias("_r"))
    b = units.select("dyad", "condition", F.row_number().over(w.orderBy(_order(seed, F.col("dyad"), F.col(unit)), unit)).alias("_r"))
    dealt = a.join(b, ["dyad", "_r"]).select("dyad", unit, "condition")
    return rows.select(*dict.fromkeys([key, "dyad", "trial"])).join(dealt, ["dyad", unit])


def phase_randomize(signal: DataFrame, seed: int = 42, by: tuple[str, ...] = ("run", "channel")) -> DataFrame:
    """by..., t, x with the amplitude spectrum of each channel and random phases; a group a channel."""
    kind = ", ".join([f"{c} {signal.schema[c].dataType.simpleString()}" for c in by]) + ", t long, x double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        f = np.fft.rfft(pdf["x"].to_numpy(float))
        rng = np.random.default_rng([seed, *(int.from_bytes(str(k).encode()[:8], "little") for k in key)])
        turn = rng.uniform(0, 2 * np.pi, len(f))
        turn[0] = 0
        if len(pdf) % 2 == 0:
            turn[-1] = 0
        return pdf[[*by, "t"]].assign(x=np.fft.irfft(f * np.exp(1j * turn), len(pdf)))

    return signal.select(*by, F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x")).groupBy(*by).applyInPandas(run, kind)


def generate_surrogate_stack(signal: DataFrame, method: str = "circular_time_shift", n_surrogates: int = 100, seed: int = 42, **parameters) -> DataFrame:
    """surrogate_id and n surrogates by a method of this module, each with its own draws."""
    many = signal.withColumn("surrogate_id", F.explode(F.sequence(F.lit(0), F.lit(n_surrogates - 1))))
    if method == "circular_time_shift":
        return circular_time_shift(many, seed=seed, by=("surrogate_id", "run", "channel"), **parameters)
    if method == "phase_randomize":
        return phase_randomize(many, seed, ("surrogate_id", "run", "channel"))
    if method == "dyad_subject_swap":
        out = None
        for i in range(n_surrogates):
            one = dyad_subject_swap(signal, seed + i).withColumn("surrogate_id", F.lit(i))
            out = one if out is None else out.unionByName(one)
        return out
    raise ValueError(f"unknown method {method!r}")


def shuffle_connectome(edges: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """u, v, weight, length: weights and lengths of the first block's upper triangle permuted together over its cells, and the same in the second block."""
    upper = edges.where((F.col("u") < F.col("v")) & (F.col("v") < size))
    a = upper.select("u", "v", F.row_number().over(Window.orderBy("u", "v")).alias("_r"))
    b = upper.select("weight", "length", F.row_number().over(Window.orderBy(_order(seed, F.col("u"), F.col("v")), "u", "v")).alias("_r"))
    one = a.join(b, "_r").select("u", "v", "weight", "length")
    return one.unionByName(one.select((F.col("u") + size).alias("u"), (F.col("v") + size).alias("v"), "weight", "length"))
