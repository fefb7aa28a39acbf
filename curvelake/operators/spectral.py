"""Laplacians, their spectra and distances between heat operators; dense linear algebra is numpy, a group or a row at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import EDGE, both_ways, remove_self_loops


def laplacian(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """graph_id, i, j, value: -w off the diagonal, the sum of w on it; zero cells are left out."""
    e = both_ways(remove_self_loops(edges).select(*EDGE, F.coalesce(F.col(weight), F.lit(0.0)).alias("w")))
    off = e.select("graph_id", F.col("node").alias("i"), F.col("other").alias("j"), (-F.col("w")).alias("value"))
    on = e.groupBy("graph_id", "node").agg(F.sum("w").alias("value")).select("graph_id", F.col("node").alias("i"), F.col("node").alias("j"), "value")
    return off.unionByName(on).where("value <> 0")


def _dense(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int | None = None) -> np.ndarray:
    if n is None:
        _, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        u, v = at[: len(u)], at[len(u) :]
        n = int(at.max()) + 1
    a = np.zeros((n, n))
    a[u, v] = a[v, u] = w
    np.fill_diagonal(a, 0)
    return np.diag(a.sum(1)) - a


def eigen_in_time(edges: DataFrame) -> DataFrame:
    """graph_id, lambda2 (algebraic connectivity), gap = lambda1 - lambda2 as the reference defines it (never above 0)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.linalg.eigvalsh(_dense(pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["weight"].to_numpy(float)))
        return pd.DataFrame({"graph_id": [pdf["graph_id"].iloc[0]], "lambda2": [w[1] if len(w) > 1 else 0.0], "gap": [w[0] - w[1] if len(w) > 1 else 0.0]})

    return remove_self_loops(edges).select(*EDGE, F.col("weight").cast("double").alias("weight")).groupBy("graph_id").applyInPandas(run, "graph_id string, lambda2 double, gap double")


def spectra(edges: DataFrame) -> DataFrame:
    """graph_id, k, eigenvalue of the Laplacian in ascending order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.linalg.eigvalsh(_dense(pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["weight"].to_numpy(float)))
        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "k": np.arange(len(w)), "eigenvalue": w})

    return remove_self_loops(edges).select(*EDGE, F.col("weight").cast("double").alias("weight")).groupBy("graph_id").applyInPandas(run, "graph_id string, k int, eigenvalue double")


def heat_distance(l1: np.ndarray, l2: np.ndarray, times: np.ndarray) -> float:
    """Greatest Frobenius norm of exp(-t l1) - exp(-t l2): by traces of the spectra, with no matrix for each t."""
    (a, x), (b, y) = np.linalg.eigh(l1), np.linalg.eigh(l2)
    overlap = (x.T @ y) ** 2
    ea, eb = np.exp(-np.outer(times, a)), np.exp(-np.outer(times, b))
    square = (ea**2).sum(1) + (eb**2).sum(1) - 2 * np.einsum("ti,ij,tj->t", ea, overlap, eb)
    return float(np.sqrt(np.maximum(square, 0)).max())


def log_times() -> np.ndarray:
    return np.logspace(-2, 2, 100)


def one_row_per_graph(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """graph_id with arrays u, v, w in a fixed order: what a distance of two graphs needs of each."""
    cells = F.sort_array(F.collect_list(F.struct("u", "v", F.coalesce(F.col(weight), F.lit(0.0)).cast("double").alias("w"))))
    return remove_self_loops(edges).groupBy("graph_id").agg(cells.alias("c")).select("graph_id", F.col("c.u").cast("array<int>").alias("u"), F.col("c.v").cast("array<int>").alias("v"), F.col("c.w").alias("w"))


def _pair_distance(nodes: int, times: np.ndarray) -> Column:
    @F.pandas_udf("double")
    def run(u1: pd.Series, v1: pd.Series, w1: pd.Series, u2: pd.Series, v2: pd.Series, w2: pd.Series) -> pd.Series:
        return pd.Series([heat_distance(_dense(a, b, c, nodes), _dense(d, e, f, nodes), times) for a, b, c, d, e, f in zip(u1, v1, w1, u2, v2, w2)])

    return run("u", "v", "w", "u2", "v2", "w2")


def compute_successive_gdd(edges: DataFrame, nodes: int, weight: str = "weight") -> DataFrame:
    """graph_id (the earlier one), next, distance of graphs that follow each other by graph_id."""
    w = Window.orderBy("graph_id")
    rows = one_row_per_graph(edges, weight).select("*", *(F.lead(c).over(w).alias(n) for c, n in (("graph_id", "next"), ("u", "u2"), ("v", "v2"), ("w", "w2")))).where("next is not null")
    return rows.select("graph_id", "next", _pair_distance(nodes, log_times()).alias("distance"))


def compute_pairwise_gdd(edges: DataFrame, nodes: int, weight: str = "weight") -> DataFrame:
    """graph_id, other, distance of all pairs, both directions; a graph to itself has 0."""
    one = one_row_per_graph(edges, weight)
    two = one.withColumnsRenamed({"graph_id": "other", "u": "u2", "v": "v2", "w": "w2"})
    upper = one.join(two, F.col("graph_id") < F.col("other")).repartition("graph_id", "other").select("graph_id", "other", _pair_distance(nodes, log_times()).alias("distance"))
    return upper.unionByName(upper.select(F.col("other").alias("graph_id"), F.col("graph_id").alias("other"), "distance")).unionByName(one.select("graph_id", F.col("graph_id").alias("other"), F.lit(0.0).alias("distance")))


def diffusion_distance(a: np.ndarray, b: np.ndarray, time_limit: float, fs: float) -> float:
    """heat_distance of adjacencies over 0, 1 / fs, ... below the limit."""
    return heat_distance(np.diag(a.sum(1)) - a, np.diag(b.sum(1)) - b, np.arange(0, time_limit, 1 / fs))


def edge_deletion(edges: DataFrame, i: int, j: int) -> DataFrame:
    return edges.where(~((F.col("u") == min(i, j)) & (F.col("v") == max(i, j))))


def edge_deletion_perturbation(edges: DataFrame, nodes: int, time_limit: float = 100.0, fs: float = 1.0) -> DataFrame:
    """graph_id, u, v, chi = distance to the graph without the edge / its weight, for every edge."""
    one = one_row_per_graph(edges)
    rows = one.select("*", F.posexplode("w").alias("k", "weight")).repartition("graph_id", "k")

    @F.pandas_udf("double")
    def chi(u: pd.Series, v: pd.Series, w: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for a, b, c, e in zip(u, v, w, k):
            whole = _dense(a, b, c, nodes)
            less = np.array(c)
            less[e] = 0
            out.append(heat_distance(whole, _dense(a, b, less, nodes), np.arange(0, time_limit, 1 / fs)) / c[e] if c[e] else 0.0)
        return pd.Series(out)

    return rows.select("graph_id", F.element_at("u", F.col("k") + 1).alias("u"), F.element_at("v", F.col("k") + 1).alias("v"), chi("u", "v", "w", "k").alias("chi"))


def spectral_normalise(edges: DataFrame) -> DataFrame:
    """Weights over the greatest absolute eigenvalue of each graph's adjacency."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        l = _dense(pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["weight"].to_numpy(float))  # noqa: E741
        a = np.diag(np.diag(l)) - l
        top = np.abs(np.linalg.eigvalsh(a)).max()
        return pdf.assign(weight=pdf["weight"] / top if top else pdf["weight"])

    kind = "graph_id string, u int, v int, weight double"
    return edges.select("graph_id", F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), F.col("weight").cast("double").alias("weight")).groupBy("graph_id").applyInPandas(run, kind)
