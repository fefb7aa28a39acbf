"""Whole analyses: from signals or windowed graphs to curvature, flow, distances and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curvature as cv
from ..operators import distribution as ds
from ..operators import graph as gr
from ..operators import metrics as mt
from ..operators import phase as ph
from ..operators import spectral as sp
from ..operators import stats as st
from ..sources import trade as tr
from .graphs import pruned, yearly
from .registry import query, rounded


def window_graphs(plv: DataFrame, threshold: float | None = None) -> DataFrame:
    """edges of windowed PLV (run, window, u, v, weight), graph_id "run/window", without loops."""
    e = gr.remove_self_loops(plv).select(F.concat("run", F.lit("/"), F.format_string("%05d", F.col("window").cast("int"))).alias("graph_id"), "u", "v", "weight")
    return e if threshold is None else e.where(F.col("weight") >= threshold)


def curvature_sweep(edges: DataFrame, kind: str = "1d", entropy: str = "kozachenko", qs: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """graph_id, entropy, quantiles of every graph: one plan over all keys that graph_id stands for."""
    c = cv.compute_frc(edges, kind)
    q = c.groupBy("graph_id").agg(F.percentile("curvature", F.array(*map(F.lit, qs))).alias("quantiles"))
    return ds.vec_entropy(c, entropy).join(q, "graph_id")


def ricci_flow_analysis(signal: DataFrame, size: int, stride: int, threshold: float | None = None, iterations: int = 30, step: float = 1.0, delta: float = 1e-4) -> DataFrame:
    """graph_id, edges, components, ranges of Forman curvature before and after the flow, for every window."""
    e = window_graphs(gr.sliding_window_plv(signal, size, stride), threshold)
    flow = cv.forman_ricci_flow(e, iterations, step, delta)
    parts = mt.connected_components(e).groupBy("graph_id").agg(F.count_distinct("component").alias("n_components"))
    ranges = [f(c).alias(f"{n}_{s}") for c, s in (("original_frc", "before"), ("curvature", "after")) for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))]
    return flow.groupBy("graph_id").agg(F.count("*").alias("n_edges"), *ranges).join(parts, "graph_id")


def orc_grid(edges: DataFrame, alphas: tuple[float, ...] = (0.25, 0.5, 0.75), powers: tuple[float, ...] = (0.0, 1.0, 2.0)) -> DataFrame:
    """alpha, power, graph_id, entropy of Ollivier curvature over a grid of its parameters."""
    found = [ds.vec_entropy(cv.compute_orc(edges, a, exp_power=p), "kozachenko").select(F.lit(a).alias("alpha"), F.lit(p).alias("power"), "graph_id", "entropy") for a in alphas for p in powers]
    return reduce(DataFrame.unionByName, found)


def gdd_analysis(edges: DataFrame, nodes: int, successive: bool = False) -> DataFrame:
    """Distances of graphs weighted by their curvature, made positive by one transform for all."""
    c = cv.compute_frc(edges)
    positive = cv.transform_curvature_collection(c, cv.fit_global_positive_linear_transform(c))
    return (sp.compute_successive_gdd if successive else sp.compute_pairwise_gdd)(positive, nodes, "positive_weight")


def band_plv(signal: DataFrame, band: tuple[float, float], fs: float, size: int, stride: int, half: int) -> DataFrame:
    """run, block ("intra" or "inter" of channels below and from `half`), plv: band-passed phases, mean over windows and pairs."""
    plv = gr.remove_self_loops(gr.sliding_window_plv(ph.hilbert_phase(signal, band, fs), size, stride))
    block = F.when((F.col("u") < half) == (F.col("v") < half), "intra").otherwise("inter")
    return plv.groupBy("run", block.alias("block")).agg(F.avg("weight").alias("plv"))


def hierarchical_report(rows: DataFrame, conditions: list[str], n_perms: int = 2000, seed: int = 42) -> DataFrame:
    """freq, p of both permutation tests with Holm's correction, the null check on shuffled dyads, and the largest effect."""
    flat = st.hierarchical_permutation_test(rows, ["freq"], n_perms, seed).select("freq", F.col("p").alias("p_mean"))
    energy = st.energy_distance_hierarchical(rows, ["freq"], n_perms, seed).select("freq", F.col("p").alias("p_energy"))
    ids = rows.select("dyad").distinct()
    cycle = ids.withColumn("_r", F.md5(F.concat(F.lit(f"{seed}|"), F.col("dyad").cast("string"))))
    null = rows.join(cycle, "dyad").withColumn("dyad", F.col("_r")).drop("_r")
    sane = st.hierarchical_permutation_test(null, ["freq"], min(n_perms, 500), seed + 1).select("freq", F.col("p").alias("p_null"))
    effect = st.effect_sizes(rows.where(F.col("condition").isin(conditions)), ["freq"]).groupBy("freq").agg(F.max(F.abs("d")).alias("largest_d"))
    joined = flat.join(energy, "freq").join(sane, "freq").join(effect, "freq").withColumn("family", F.lit("bands"))
    return st.holm(joined, ["family"], "p_mean")


@query()
def sweep_augmented(spark: SparkSession, d: str) -> DataFrame:
    s = curvature_sweep(pruned(spark, d), "augmented", "vasicek")
    return rounded(s.select("graph_id", "entropy", *(F.col("quantiles")[k].alias(f"q{k}") for k in range(5))), 4)


@query()
def flow_analysis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ricci_flow_analysis(tr.phases(spark, d), 240, 240, None, 5, 0.05), 4)


@query()
def orc_parameter_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(orc_grid(pruned(spark, d), (0.25, 0.5), (0.0, 1.0)), 5)


@query()
def gdd_analysis_yearly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gdd_analysis(yearly(spark, d), 25, True), 5)


@query()
def band_limited_plv(spark: SparkSession, d: str) -> DataFrame:
    return rounded(band_plv(tr.phases(spark, d), (0.5, 4.0), 24.0, 120, 60, 2))


@query()
def hierarchical_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hierarchical_report(tr.trials(spark, d), ["F", "O", "P"]))
