"""Generators: small-world graphs from hash draws in SQL, oscillators in numpy, one run a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .curvature import compute_frc
from .distribution import get_quantiles, vec_entropy
from .surrogates import uniform


def small_world_grid(spark: SparkSession, n_reps: int, t_rez: int, min_pow: float, max_pow: float) -> DataFrame:
    """graph_id, rep, step, p: rewiring probabilities on a logarithmic grid, for each repetition."""
    step = F.when(F.lit(t_rez) > 1, F.col("step") / F.lit(float(max(1, t_rez - 1)))).otherwise(0.0)
    at = spark.range(n_reps * t_rez).select((F.col("id") / t_rez).cast("int").alias("rep"), (F.col("id") % t_rez).cast("int").alias("step"))
    return at.select(F.format_string("%03d-%03d", "rep", "step").alias("graph_id"), "rep", "step", F.pow(F.lit(10.0), min_pow + (max_pow - min_pow) * step).alias("p"))


def watts_strogatz(graphs: DataFrame, n: int, k: int, seed: int = 42) -> DataFrame:
    """graph_id, u, v, weight 1 of (graph_id, p): ring edges to k // 2 neighbours, each end rewired with probability p.

    Every ring edge draws from the md5 of seed, graph and edge; one whose new end is its own node or makes an edge twice
    is dropped as double, so a graph has at most n k / 2 edges.
    """
    if k >= n:
        raise ValueError("k must be less than n")
    ring = graphs.select("graph_id", "p", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("a")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("j"))
    keys: list[Column] = [F.col("graph_id"), F.col("a"), F.col("j")]
    target = F.floor(uniform(seed + 1, *keys) * n).cast("int")
    b = F.when(uniform(seed, *keys) < F.col("p"), target).otherwise((F.col("a") + F.col("j")) % n)
    moved = ring.select("graph_id", "a", b.alias("b")).where("a <> b")
    return moved.select("graph_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().withColumn("weight", F.lit(1.0))


def gen_weighted_sw(graphs: DataFrame, n: int, k: int, epsilon: float = 1.0, seed: int = 42) -> DataFrame:
    """Small-world graphs with weight Dmax - ring distance, Dmax = (n // 2 + 1) epsilon; epsilon of 1 or more keeps weights positive."""
    if epsilon < 1:
        raise ValueError("epsilon below 1 can make weights negative")
    apart = F.abs(F.col("u") - F.col("v"))
    return watts_strogatz(graphs, n, k, seed).withColumn("weight", (n // 2 + 1) * epsilon - F.least(apart, n - apart))


def gen_tv_sw(spark: SparkSession, n: int, k: int, t_rez: int, min_pow: float, max_pow: float, seed: int = 42) -> DataFrame:
    return watts_strogatz(small_world_grid(spark, 1, t_rez, min_pow, max_pow), n, k, seed)


def gen_tv_weighted_sw(spark: SparkSession, n: int, k: int, epsilon: float, t_rez: int, min_pow: float, max_pow: float, seed: int = 42) -> DataFrame:
    return gen_weighted_sw(small_world_grid(spark, 1, t_rez, min_pow, max_pow), n, k, epsilon, seed)


def gen_nature_sw(spark: SparkSession, seed: int = 42) -> DataFrame:
    return gen_tv_sw(spark, 1000, 50, 100, -4, 0, seed)


def gen_neureps_wsw(spark: SparkSession, seed: int = 42) -> DataFrame:
    return gen_tv_weighted_sw(spark, 1000, 50, 1.0, 100, -4, 0, seed)


def run_ws_sweep(spark: SparkSession, n: int = 1000, k: int = 50, epsilon: float = 1.0, t_rez: int = 100, min_pow: float = -4, max_pow: float = 0, n_reps: int = 200, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Entropy (graph_id, rep, step, p, entropy) and quantiles (graph_id, q, value) of the Forman curvature of every graph of the sweep."""
    grid = small_world_grid(spark, n_reps, t_rez, min_pow, max_pow)
    curv = compute_frc(gen_weighted_sw(grid, n, k, epsilon, seed))
    return grid.join(vec_entropy(curv, "kozachenko"), "graph_id"), get_quantiles(curv)


def replicate_bands(values: DataFrame, by: str, value: str, qs: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Quantiles over repetitions for each value of `by`."""
    return values.groupBy(by).agg(F.percentile(value, F.array(*map(F.lit, qs))).alias("bands"))


# Oscillators


def kuramoto_field(theta: np.ndarray, coupling: float, omega: np.ndarray) -> np.ndarray:
    z = np.exp(1j * theta).mean()
    return omega + coupling * (z.imag * np.cos(theta) - z.real * np.sin(theta))


def rk4(field, state: np.ndarray, dt: float) -> np.ndarray:
    a = field(state)
    b = field(state + dt / 2 * a)
    c = field(state + dt / 2 * b)
    d = field(state + dt * c)
    return state + dt / 6 * (a + 2 * b + 2 * c + d)


def kuramoto(n: int, coupling: float, dt: float, n_steps: int, omega_std: float = 1.0, seed: int = 42) -> np.ndarray:
    """(n_steps + 1, n) phases of the mean-field model from random phases and normal frequencies."""
    rng = np.random.default_rng(seed)
    omega, theta = rng.normal(0, omega_std, n), rng.uniform(0, 2 * np.pi, n)
    out = np.empty((n_steps + 1, n))
    out[0] = theta
    for i in range(n_steps):
        out[i + 1] = theta = rk4(lambda x: kuramoto_field(x, coupling, omega), theta, dt)
    return out


def simulate_kuramoto(runs: DataFrame, n: int = 100, dt: float = 0.01, n_steps: int = 2000, omega_std: float = 1.0) -> DataFrame:
    """signal(run, channel, t, phase) of runs (run, coupling, seed): one group a run."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        theta = kuramoto(n, float(r["coupling"]), dt, n_steps, omega_std, int(r["seed"]))
        t, c = np.indices(theta.shape)
        return pd.DataFrame({"run": r["run"], "channel": c.ravel(), "t": t.ravel(), "phase": np.mod(theta.ravel(), 2 * np.pi)})

    at = runs.select(F.col("run").cast("string").alias("run"), F.col("coupling").cast("double").alias("coupling"), F.col("seed").cast("long").alias("seed"))
    return at.groupBy("run").applyInPandas(run, "run string, channel int, t long, phase double")


def missing_runs(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Runs without phases yet: those to simulate."""
    return expected.join(present.select("run").distinct(), "run", "left_anti")


def delayed_kuramoto(w: np.ndarray, delay: np.ndarray, omega: np.ndarray, coupling: float, dt: float, t_max: float, noise: float = 0.1, seed: int = 42) -> np.ndarray:
    """(steps, n) phases: theta_i' = omega_i + c * sum over j with w[j, i] of sin(theta_j(t - delay_ij) - theta_i), with noise sqrt(2 D dt)."""
    rng, n, steps = np.random.default_rng(seed), len(w), round(t_max / dt)
    lag = np.minimum(np.round(delay / dt).astype(int), max(1, steps))
    size = int(lag.max(initial=0)) + 1
    past = np.empty((size, n))
    start = rng.uniform(0, 2 * np.pi, n)
    past[:] = start + omega * dt * (np.arange(size)[:, None] - size + 1)
    mask, i, out = w.T != 0, np.arange(n), np.empty((steps, n))
    for t in range(steps):
        now = (size - 1 + t) % size
        theta = past[now]
        seen = past[(now - lag) % size, i[None, :]]
        new = theta + dt * (omega + coupling * np.where(mask, np.sin(seen - theta[:, None]), 0).sum(1)) + np.sqrt(2 * noise * dt) * rng.standard_normal(n)
        past[(now + 1) % size] = out[t] = new
    return out


def simulate_delayed_kuramoto(runs: DataFrame, connectome: DataFrame, n: int, omega_mean: float = 40.0, omega_std: float = 1.0, velocity: float = 1.65, dt: float = 1e-3, t_max: float = 1.0, t_skip: float = 0.0, noise: float = 0.1) -> DataFrame:
    """signal of runs (run, coupling, seed) on a directed connectome (u, v, weight, length in m); the first t_skip is cut.

    The connectome, n * n cells at most, goes to every run with the group; more rows than that, as of repeated cells, are an error.
    """
    cells = [(int(r["u"]), int(r["v"]), float(r["weight"]), float(r["length"])) for r in connectome.select("u", "v", "weight", "length").limit(n * n + 1).collect()]
    if len(cells) > n * n or len({c[:2] for c in cells}) < len(cells):
        raise ValueError("the connectome has repeated cells or nodes beyond n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        w, delay = np.zeros((n, n)), np.zeros((n, n))
        for u, v, x, length in cells:
            w[u, v], delay[u, v] = x, length / velocity
        omega = 2 * np.pi * np.random.default_rng(int(r["seed"])).normal(omega_mean, omega_std, n)
        theta = delayed_kuramoto(w, delay.T, omega, float(r["coupling"]), dt, t_max, noise, int(r["seed"]))[round(t_skip / dt) :]
        t, c = np.indices(theta.shape)
        return pd.DataFrame({"run": r["run"], "channel": c.ravel(), "t": t.ravel(), "phase": np.mod(theta.ravel(), 2 * np.pi)})

    at = runs.select(F.col("run").cast("string").alias("run"), F.col("coupling").cast("double").alias("coupling"), F.col("seed").cast("long").alias("seed"))
    return at.groupBy("run").applyInPandas(run, "run string, channel int, t long, phase double")


def order_parameter(signal: DataFrame) -> DataFrame:
    """run, t, r = |mean of exp(i phase)| over channels."""
    return signal.groupBy("run", "t").agg(F.sqrt(F.pow(F.avg(F.cos("phase")), F.lit(2.0)) + F.pow(F.avg(F.sin("phase")), F.lit(2.0))).alias("r"))


def ensemble_bands(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and mean +- 1.96 standard errors over runs."""
    sem = F.stddev_samp(value) / F.sqrt(F.count(value).cast("double"))
    return values.groupBy(*by).agg(F.avg(value).alias("mean"), (F.avg(value) - 1.96 * sem).alias("low"), (F.avg(value) + 1.96 * sem).alias("high"))


def source_signals(signal: DataFrame, dipoles: DataFrame, regions: DataFrame, gain: DataFrame) -> DataFrame:
    """sensor, run, t, x: cos(phase) of each dipole's nearest region (regions: region, x, y, z; dipoles: dipole, x, y, z) through gain(sensor, dipole, g).

    Regions are a parcellation, a table of fixed size, so the nearest one is found by a broadcast.
    """
    r = regions.select("region", *(F.col(c).alias(f"r{c}") for c in "xyz"))
    d2 = sum(((F.col(c) - F.col(f"r{c}")) * (F.col(c) - F.col(f"r{c}")) for c in "xyz"), F.lit(0.0))
    near = dipoles.crossJoin(F.broadcast(r)).groupBy("dipole").agg(F.min_by("region", F.struct(d2, "region")).alias("channel"))
    s = signal.join(near, "channel").select("run", "t", "dipole", F.cos("phase").alias("s"))
    return s.join(gain, "dipole").groupBy("sensor", "run", "t").agg(F.sum(F.col("g") * F.col("s")).alias("x"))
