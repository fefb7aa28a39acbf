"""Discrete Ricci curvature of edges, and what is done with it.

Forman curvature needs degrees and sums at an edge's ends only: two aggregates by node, joined back. The augmented form adds
triangles, found by joining each edge with its ends' neighbours of greater number. Ollivier curvature solves a transport problem for each edge in numpy, one
graph to a group.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .graph import EDGE, both_ways, remove_self_loops

CURV = "graph_id string, u int, v int, curvature double"


def _prepared(edges: DataFrame, keep_loops: bool) -> DataFrame:
    at = edges.select(*EDGE, F.coalesce("weight", F.lit(1.0)).cast("double").alias("weight"))
    return at if keep_loops else remove_self_loops(at)


def _ends(edges: DataFrame) -> DataFrame:
    """graph_id, node, s = sum of 1 / sqrt(weight), degree."""
    return both_ways(edges).groupBy("graph_id", "node").agg(F.sum(1 / F.sqrt("weight")).alias("s"), F.count("*").alias("degree"))


def _with_ends(edges: DataFrame, ends: DataFrame) -> DataFrame:
    cols = [c for c in ends.columns if c not in ("graph_id", "node")]
    out = edges
    for x in ("u", "v"):
        out = out.join(ends.select("graph_id", F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in cols)), ["graph_id", x])
    return out


def compute_frc(edges: DataFrame, method: str = "1d", keep_loops: bool = False) -> DataFrame:
    """Edges with `curvature`: Forman-Ricci with node weights 1; method "1d" or "augmented". Weights are positive."""
    if method == "augmented":
        return compute_afrc(edges, keep_loops)
    if method != "1d":
        raise ValueError("method is '1d' or 'augmented'")
    e = _prepared(edges, keep_loops)
    root = F.sqrt("weight")
    value = 2 - root * ((F.col("s_u") - 1 / root) + (F.col("s_v") - 1 / root))
    return _with_ends(e, _ends(e)).select(*EDGE, "weight", value.alias("curvature"))


def triangles(edges: DataFrame) -> DataFrame:
    """graph_id, a < b < c of each triangle; edges without loops, u < v."""
    e = edges.select(*EDGE)
    ab = e.select("graph_id", F.col("u").alias("a"), F.col("v").alias("b"))
    bc = e.select("graph_id", F.col("u").alias("b"), F.col("v").alias("c"))
    ac = e.select("graph_id", F.col("u").alias("a"), F.col("v").alias("c"))
    return ab.join(bc, ["graph_id", "b"]).join(ac, ["graph_id", "a", "c"]).select("graph_id", "a", "b", "c")


def compute_afrc(edges: DataFrame, keep_loops: bool = False) -> DataFrame:
    """Forman-Ricci with triangles as faces of weight 1: w (T w + 2 / w - |sum over other edges at both ends outside e's triangles of 1 / sqrt(w w')|)."""
    e = _prepared(edges, keep_loops)
    r = e.select(*EDGE, (1 / F.sqrt("weight")).alias("r"))
    t = triangles(remove_self_loops(e))
    sides = [("a", "b", "c"), ("a", "c", "b"), ("b", "c", "a")]
    out = None
    for x, y, z in sides:  # each side, with the other two sides' 1 / sqrt(w)
        one = t.select("graph_id", F.col(x).alias("u"), F.col(y).alias("v"), F.col(z).alias("z"))
        out = one if out is None else out.unionByName(one)
    side = lambda p, name: r.select("graph_id", F.col("u").alias(f"p_{name}"), F.col("v").alias(f"q_{name}"), F.col("r").alias(f"r_{name}"))
    faces = out.select("*", *(f(x, "z").alias(f"{k}_{x}z") for x in ("u", "v") for k, f in (("p", F.least), ("q", F.greatest))))
    for x in ("uz", "vz"):
        faces = faces.join(side("", x), ["graph_id", f"p_{x}", f"q_{x}"])
    faces = faces.groupBy("graph_id", "u", "v").agg(F.count("*").alias("t"), F.sum(F.col("r_uz") + F.col("r_vz")).alias("faced"))
    joined = _with_ends(e, _ends(e)).join(faces, EDGE, "left")
    w, root = F.col("weight"), F.sqrt("weight")
    t, faced = F.coalesce("t", F.lit(0)), F.coalesce("faced", F.lit(0.0))
    free = (F.col("s_u") + F.col("s_v") - 2 / root - faced) / root
    return joined.select(*EDGE, "weight", (w * (t * w + 2 / w - F.abs(free))).alias("curvature"))


def node_curvature(curv: DataFrame) -> DataFrame:
    """Mean curvature of the edges at each node."""
    return both_ways(curv.select(*EDGE, "curvature")).groupBy("graph_id", "node").agg(F.avg("curvature").alias("curvature"))


def curvature_matrices(curv: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, i, j, value of the full matrix over a graph's nodes: both directions, 0 where there is no edge."""
    n = nodes.select("graph_id", "node")
    grid = n.withColumnRenamed("node", "i").join(n.withColumnRenamed("node", "j"), "graph_id")
    cells = both_ways(curv.select(*EDGE, "curvature")).select("graph_id", F.col("node").alias("i"), F.col("other").alias("j"), "curvature")
    return grid.join(cells, ["graph_id", "i", "j"], "left").select("graph_id", "i", "j", F.coalesce("curvature", F.lit(0.0)).alias("value"))


def update_weight(curv: DataFrame) -> DataFrame:
    return curv.withColumn("curvature", F.col("curvature") + 1)


def update_weights(curv: DataFrame) -> DataFrame:
    """1 - curvature; a missing one is an error."""
    return curv.withColumn("curvature", F.when(F.col("curvature").isNull(), F.raise_error(F.lit("an edge has no curvature"))).otherwise(1 - F.col("curvature")))


def fit_global_positive_linear_transform(curv: DataFrame, flip_sign: bool = True, eps: float = 1e-9, rescale: tuple[float, float] | None = None) -> DataFrame:
    """One row: sign, scale, shift and the ranges, fitted over all graphs, so that scale * sign * x + shift is positive."""
    sign = -1.0 if flip_sign else 1.0
    bad = F.max(F.when(F.isnan("curvature") | (F.abs("curvature") == float("inf")), 1).otherwise(0))
    at = curv.agg(F.min(sign * F.col("curvature")).alias("low"), F.max(sign * F.col("curvature")).alias("high"), bad.alias("bad"), F.count("curvature").alias("n"))
    at = at.select("low", "high", "n", F.when((F.col("n") == 0) | (F.col("bad") == 1), F.raise_error(F.lit("curvatures are empty or not finite"))).otherwise(F.lit(sign)).alias("sign"))
    if rescale is None:
        scale, shift = F.lit(1.0), eps - F.col("low")
    else:
        low, high = rescale
        if not 0 < low < high:
            raise ValueError("rescale is (low, high) with 0 < low < high")
        span = F.when(F.col("high") == F.col("low"), F.raise_error(F.lit("constant curvatures can't be rescaled")).cast("double")).otherwise(F.col("high") - F.col("low"))
        scale = (high - low) / span
        shift = low - F.col("low") * scale
    return at.select("sign", scale.alias("scale"), shift.alias("shift"), "low", "high", "n")


def transform_curvature_collection(curv: DataFrame, parameters: DataFrame) -> DataFrame:
    """Adds positive_weight; parameters is the one row of the fit."""
    value = F.col("scale") * F.col("sign") * F.col("curvature") + F.col("shift")
    return curv.crossJoin(F.broadcast(parameters.select("sign", "scale", "shift"))).withColumn("positive_weight", value).drop("sign", "scale", "shift")


def check_all_positive(curv: DataFrame, column: str = "positive_weight") -> DataFrame:
    return curv.groupBy("graph_id").agg(F.min(column).alias("least"), F.max(column).alias("most"), F.min(F.col(column) > 0).alias("all_positive"))


def forman_ricci_flow(edges: DataFrame, iterations: int = 30, step: float = 1.0, delta: float = 1e-4, method: str = "1d", eps: float = 1e-12, cut_every: int = 1) -> DataFrame:
    """graph_id, u, v, original_frc, weight, curvature after the flow: w <- max(eps, w - step k w), sum of w as many as edges, k anew.

    A graph stops when its curvatures' range is below delta or its weights vanish; the others go on. Each round refers to the last one several times, so lineage is cut every round.
    """
    now = compute_frc(edges, method).withColumn("original_frc", F.col("curvature")).withColumn("running", F.lit(True))
    now = cut(now)
    for k in range(1, iterations + 1):
        moved = F.greatest(F.lit(eps), F.col("weight") - step * F.col("curvature") * F.col("weight"))
        going = now.where("running").withColumn("moved", moved)
        total = going.groupBy("graph_id").agg(F.sum("moved").alias("total"), F.count("*").alias("size"))
        scaled = going.join(total, "graph_id").withColumn("scaled", F.when(F.col("total") > eps, F.col("moved") * F.col("size") / F.col("total")))
        ok = scaled.where("scaled is not null")
        again = compute_frc(ok.select(*EDGE, F.col("scaled").alias("weight")), method)
        spread = again.groupBy("graph_id").agg((F.max("curvature") - F.min("curvature")).alias("spread"))
        again = again.join(ok.select(*EDGE, "original_frc"), EDGE).join(spread, "graph_id")
        again = again.select(*EDGE, "weight", "curvature", "original_frc", (F.col("spread") >= delta).alias("running"))
        stopped = now.where("not running").unionByName(scaled.where("scaled is null").select(*now.columns).withColumn("running", F.lit(False)))
        now = again.select(*now.columns).unionByName(stopped)
        if k % cut_every == 0 or k == iterations:
            now = cut(now)
            if now.where("running").isEmpty():
                break
    return now.select(*EDGE, "original_frc", "weight", "curvature")


# Ollivier curvature


def shortest_paths(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """All-pairs distances, inf where there is no path."""
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    np.minimum.at(d, (u, v), w)
    np.minimum.at(d, (v, u), w)
    for k in range(n):
        np.minimum(d, d[:, k, None] + d[None, k, :], out=d)
    return d


def transport(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray, tiny: float = 1e-12) -> float:
    """Least cost of moving supply to demand of the same sum: successive shortest paths with potentials."""
    supply, demand = supply.copy(), demand.copy()
    n, m = cost.shape
    flow, pi, pj, total = np.zeros((n, m)), np.zeros(n), np.zeros(m), 0.0
    while supply.max(initial=0) > tiny and demand.max(initial=0) > tiny:
        di, dj = np.where(supply > tiny, 0.0, np.inf), np.full(m, np.inf)
        from_i, from_j = np.full(n, -1), np.full(m, -1)
        done_i, done_j = np.zeros(n, bool), np.zeros(m, bool)
        reduced = cost + pi[:, None] - pj[None, :]
        while True:
            a, b = np.where(done_i, np.inf, di), np.where(done_j, np.inf, dj)
            i, j = int(a.argmin()), int(b.argmin())
            if min(a[i], b[j]) == np.inf:
                return total
            if a[i] <= b[j]:
                done_i[i] = True
                new = di[i] + np.maximum(reduced[i], 0)
                better = (new < dj - 1e-15) & ~done_j
                dj[better], from_j[better] = new[better], i
            else:
                done_j[j] = True
                if demand[j] > tiny:
                    break
                new = dj[j] + np.where(flow[:, j] > tiny, np.maximum(-reduced[:, j], 0), np.inf)
                better = (new < di - 1e-15) & ~done_i
                di[better], from_i[better] = new[better], j
        far = dj[j]
        pi += np.minimum(di, far)
        pj += np.minimum(dj, far)
        path, at = [], j
        while True:
            i = from_j[at]
            path.append((i, at, 1))
            if from_i[i] < 0:
                break
            path.append((i, from_i[i], -1))
            at = from_i[i]
        amount = min(supply[path[-1][0]], demand[j], *(flow[a, b] for a, b, s in path if s < 0)) if len(path) > 1 else min(supply[path[-1][0]], demand[j])
        for a, b, s in path:
            flow[a, b] += s * amount
            total += s * amount * cost[a, b]
        supply[path[-1][0]] -= amount
        demand[j] -= amount
    return total


def sinkhorn(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray, strength: float = 0.1, rounds: int = 200) -> float:
    """Entropic approximation of transport."""
    scale = cost.max() or 1.0
    k = np.exp(-cost / (strength * scale))
    a = np.ones(len(supply))
    for _ in range(rounds):
        b = demand / np.maximum(k.T @ a, 1e-300)
        a = supply / np.maximum(k @ b, 1e-300)
    return float((a[:, None] * k * b[None, :] * cost).sum())


def ollivier(u: np.ndarray, v: np.ndarray, w: np.ndarray, alpha: float = 0.5, base: float = np.e, power: float = 0.0, method: str = "OTD") -> np.ndarray:
    """1 - W1(m_x, m_y) / d(x, y) of each edge; mass alpha stays, the rest goes to neighbours by base ** -(d ** power).

    Mass that both measures have at a node stays there, which some cheapest plan does for a metric.
    """
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    n, x, y = len(nodes), at[: len(u)], at[len(u) :]
    d = shortest_paths(n, x, y, w)
    mass = np.zeros((n, n))
    for a, b in ((x, y), (y, x)):
        mass[a, b] = base ** -(w**power)
    total = mass.sum(1, keepdims=True)
    mass = np.where(total > 0, (1 - alpha) * mass / np.where(total > 0, total, 1), 0)
    mass[np.arange(n), np.arange(n)] += np.where(total[:, 0] > 0, alpha, 1.0)
    out = np.empty(len(u))
    for e, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
        s, t = np.maximum(mass[a] - mass[b], 0), np.maximum(mass[b] - mass[a], 0)
        i, j = np.flatnonzero(s), np.flatnonzero(t)
        if not len(i):
            out[e] = 1.0
            continue
        solve = sinkhorn if method == "Sinkhorn" or method == "OTDSinkhornMix" and len(i) * len(j) > 10_000 else transport
        out[e] = 1 - solve(s[i], t[j], d[np.ix_(i, j)]) / d[a, b]
    return out


def compute_orc(edges: DataFrame, alpha: float = 0.5, base: float = float(np.e), exp_power: float = 0.0, method: str = "OTDSinkhornMix") -> DataFrame:
    """Ollivier-Ricci curvature of each edge, a group a graph; "OTDSinkhornMix" is exact up to 100 by 100 transports."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = ollivier(pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["weight"].to_numpy(), alpha, base, exp_power, method)
        return pdf[["graph_id", "u", "v"]].assign(curvature=k)

    return _prepared(edges, False).withColumns({"u": F.col("u").cast("int"), "v": F.col("v").cast("int")}).groupBy("graph_id").applyInPandas(run, CURV)


def compute_ricci_curvature(distances: DataFrame, threshold: float = 0.5, alpha: float = 0.5) -> DataFrame:
    """Ollivier curvature of the graph of distances (graph_id, u, v, d) up to the threshold, weights 1."""
    return compute_orc(thresholded(distances, threshold), alpha)


def compute_forman_curvature(distances: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Augmented Forman curvature, the library default, of the same graph."""
    return compute_afrc(thresholded(distances, threshold))


def thresholded(distances: DataFrame, threshold: float) -> DataFrame:
    return distances.where((F.col("d") <= threshold) & (F.col("d") != 0)).select(*EDGE, F.lit(1.0).alias("weight"))


def ricci_flow(edges: DataFrame, iterations: int = 30, alpha: float = 0.5, step: float = 1.0, delta: float = 1e-4) -> DataFrame:
    """Ollivier flow: w <- w (1 - step k), sum of w as many as edges; all rounds of a graph in its group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v, w = pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["weight"].to_numpy(float)
        for _ in range(iterations):
            k = ollivier(u, v, w, alpha)
            if k.max() - k.min() < delta:
                break
            w = np.maximum(w * (1 - step * k), 1e-12)
            w *= len(w) / w.sum()
        return pdf[["graph_id", "u", "v"]].assign(weight=w, curvature=ollivier(u, v, w, alpha))

    at = _prepared(edges, False).withColumns({"u": F.col("u").cast("int"), "v": F.col("v").cast("int")})
    return at.groupBy("graph_id").applyInPandas(run, "graph_id string, u int, v int, weight double, curvature double")


def ricci_flow_metric(edges: DataFrame) -> DataFrame:
    """graph_id, i, j, distance of all pairs; infinite where there is no path."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = pdf["u"].to_numpy(), pdf["v"].to_numpy()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        d = shortest_paths(len(nodes), at[: len(u)], at[len(u) :], pdf["weight"].to_numpy(float))
        i, j = np.indices(d.shape)
        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "i": nodes[i.ravel()], "j": nodes[j.ravel()], "distance": d.ravel()})

    at = edges.select("graph_id", F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return at.groupBy("graph_id").applyInPandas(run, "graph_id string, i int, j int, distance double")


