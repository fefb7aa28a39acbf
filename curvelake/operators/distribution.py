"""Entropies, quantiles and other summaries of curvature distributions.

Per graph the curvatures are one sorted array, and estimators are expressions on it. Pooled samples, which have no bound, are never
gathered: their summaries are aggregates and windows over rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import at, log_or_never, over, total
from ..functions.special import digamma_column

FLOOR = 1e-10


def sorted_values(curv: DataFrame, column: str = "curvature", by: str = "graph_id") -> DataFrame:
    """by, x ascending, n, m: the spacing floor(sqrt(n) + 0.5). Nulls are left out."""
    got = curv.groupBy(by).agg(F.sort_array(F.collect_list(F.col(column).cast("double"))).alias("x"))
    return got.select(by, "x", F.size("x").alias("n"), F.floor(F.sqrt(F.size("x").cast("double")) + 0.5).cast("int").alias("m"))


def _spaced(x: Column, n: Column, m: Column) -> Column:
    """Mean of ln of the clamped 2m-spacings n / (2m) (x[i + m] - x[i - m])."""
    return total(over(F.lit(1), n, lambda i: log_or_never(n / (2.0 * m) * (at(x, i + m) - at(x, i - m))))) / n


def vasicek(x: Column, n: Column, m: Column) -> Column:
    return _spaced(x, n, m)


def van_es(x: Column, n: Column, m: Column) -> Column:
    spacings = total(over(F.lit(1), n - m, lambda i: log_or_never((n + 1.0) / m * (at(x, i + m) - at(x, i)))))
    harmonic = total(over(m, n, lambda k: 1.0 / k))
    return F.when(n > m, spacings / F.nullif(n - m, F.lit(0))) + harmonic + F.ln(m.cast("double")) - F.ln(n + 1.0)


def ebrahimi(x: Column, n: Column, m: Column) -> Column:
    def c(i: Column) -> Column:
        return F.when(i <= m, 1 + (i - 1.0) / m).when(i > n - m, 1 + (n - i) / m.cast("double")).otherwise(2.0)

    return total(over(F.lit(1), n, lambda i: log_or_never(n / (c(i) * m) * (at(x, i + m) - at(x, i - m))))) / n


def correa(x: Column, n: Column, m: Column) -> Column:
    def slope(i: Column) -> Column:
        js = F.sequence(-m, m)
        mean = total(F.transform(js, lambda j: at(x, i + j))) / (2 * m + 1.0)
        top = total(F.transform(js, lambda j: (at(x, i + j) - mean) * j))
        low = total(F.transform(js, lambda j: (at(x, i + j) - mean) * (at(x, i + j) - mean)))
        return -log_or_never(F.coalesce(top / F.nullif(n * low, F.lit(0.0)), F.lit(float("inf"))))

    return total(over(F.lit(1), n, slope)) / n


def neighbour_distances(x: Column, k: int) -> Column:
    """Distance of each value to its k-th nearest other one: least over slices of k + 1 values that hold it, floored."""
    n = F.size(x)

    def eps(i: Column) -> Column:
        a = F.greatest(F.lit(1), i - k)
        b = F.least(i, n - k)
        return F.greatest(F.lit(FLOOR), F.array_min(over(a, b, lambda s: F.greatest(at(x, i) - at(x, s), at(x, s + k) - at(x, i)))))

    return over(F.lit(1), n, eps)


def kozachenko(x: Column, n: Column, k: int = 4) -> Column:
    mean = total(F.transform(neighbour_distances(x, k), F.ln)) / n
    return digamma_column(n) - digamma_column(F.lit(k)) + F.ln(F.lit(2.0)) + mean


def information_potential(x: Column, n: Column, order: int = 2, k: int = 4) -> Column:
    """Estimate of the integral of f ** order: mean of ((n - 1) C 2 eps) ** (1 - order), C = (Gamma(k) / Gamma(k + 1 - order)) ** (1 / (1 - order))."""
    from math import gamma

    c = (gamma(k) / gamma(k + 1 - order)) ** (1 / (1 - order))
    return total(F.transform(neighbour_distances(x, k), lambda e: F.pow((n - 1) * c * 2 * e, F.lit(1.0 - order)))) / n


def renyi(x: Column, n: Column, order: int = 2, k: int = 4) -> Column:
    return F.ln(information_potential(x, n, order, k)) / (1 - order)


def tsallis(x: Column, n: Column, order: int = 2, k: int = 4) -> Column:
    return (1 - information_potential(x, n, order, k)) / (order - 1)


SPACING: dict[str, Callable[[Column, Column, Column], Column]] = {"vasicek": vasicek, "van_es": van_es, "ebrahimi": ebrahimi, "correa": correa}
NEAREST: dict[str, Callable[[Column, Column], Column]] = {"kozachenko": kozachenko, "renyi": renyi, "tsallis": tsallis}


def vec_entropy(curv: DataFrame, estimator: str | Callable[[Column, Column, Column], Column] = "kozachenko", column: str = "curvature", by: str = "graph_id", window_length: int | None = None) -> DataFrame:
    """by, entropy by a named estimator or by an expression of (sorted values, n, m); null below the values that it needs."""
    v = sorted_values(curv, column, by)
    x, n, m = F.col("x"), F.col("n"), F.lit(window_length) if window_length else F.col("m")
    if callable(estimator):
        return v.select(by, estimator(x, n, m).alias("entropy"))
    if estimator in SPACING:
        return v.select(by, F.when(n >= 2, SPACING[estimator](x, n, m)).alias("entropy"))
    if estimator in NEAREST:
        return v.select(by, F.when(n > 4, NEAREST[estimator](x, n)).alias("entropy"))
    if estimator == "kde":
        return entropy_kde_plugin(curv, column=column, by=by)
    raise ValueError(f"unknown estimator {estimator!r}")


def compute_entropy(curv: DataFrame, method: str = "vasicek") -> DataFrame:
    """Vasicek or KDE entropy; 0 where a graph has fewer than two values, or for KDE fewer than two different ones."""
    if method not in ("vasicek", "kde"):
        raise ValueError("method is 'vasicek' or 'kde'")
    sizes = curv.groupBy("graph_id").agg(F.count("curvature").alias("n"), F.count_distinct("curvature").alias("different"))
    few = F.col("n") < 2 if method == "vasicek" else F.col("different") < 2
    return vec_entropy(curv, method).join(sizes, "graph_id").select("graph_id", F.when(few, 0.0).otherwise(F.col("entropy")).alias("entropy"))


def entropy_kde_scott(curv: DataFrame, column: str = "curvature", by: str = "graph_id", rule: str = "scott") -> DataFrame:
    """-mean ln(f(x) + 1e-10) with a Gaussian kernel; bandwidth by Scott's or Silverman's rule, in SQL."""
    v = curv.groupBy(by).agg(F.collect_list(F.col(column).cast("double")).alias("x"), F.stddev_samp(column).alias("sd"))
    n = F.size("x")
    factor = 1.0 if rule == "scott" else (3 / 4) ** -0.2
    h = F.col("sd") * F.pow(n.cast("double"), F.lit(-0.2)) * factor
    v = v.select(by, "x", n.alias("n"), h.alias("h")).where("h > 0")
    value = F.expr("aggregate(transform(x, a -> -ln(aggregate(x, 0D, (s, b) -> s + exp(-0.5D * pow((a - b) / h, 2))) / (n * h * sqrt(2 * pi())) + 1e-10D)), 0D, (s, b) -> s + b) / n")
    return v.select(by, value.alias("entropy"))


def improved_sheather_jones(x: np.ndarray, bins: int = 1024) -> float:
    """Bandwidth by the fixed point of Botev, Grotowski and Kroese (2010), on a binned cosine transform."""
    low, high = x.min(), x.max()
    span = high - low
    if span == 0:
        return 0.0
    low, high = low - span / 2, high + span / 2
    span = high - low
    counts = np.histogram(x, bins, (low, high))[0] / len(x)
    k = np.arange(bins)
    a = 2 * (counts[None, :] * np.cos(np.pi * k[:, None] * (k[None, :] + 0.5) / bins)).sum(1)
    i2, a2, n = k[1:].astype(float) ** 2, (a[1:] / 2) ** 2, len(np.unique(x))

    def gap(t: float) -> float:
        f = 2 * np.pi**14 * (i2**7 * a2 * np.exp(-i2 * np.pi**2 * t)).sum()
        for s in range(6, 1, -1):
            odd = np.prod(np.arange(1, 2 * s, 2)) / np.sqrt(2 * np.pi)
            time = (2 * (1 + 0.5 ** (s + 0.5)) / 3 * odd / n / f) ** (2 / (3 + 2 * s))
            f = 2 * np.pi ** (2 * s) * (i2**s * a2 * np.exp(-i2 * np.pi**2 * time)).sum()
        return t - (2 * n * np.sqrt(np.pi) * f) ** -0.4

    ts = np.logspace(-8, -1, 60)
    with np.errstate(all="ignore"):
        g = np.array([gap(t) for t in ts])
    turn = np.flatnonzero((g[:-1] < 0) & (g[1:] >= 0))
    if not len(turn):
        return float(x.std(ddof=1) * len(x) ** -0.2)
    a0, b0 = ts[turn[0]], ts[turn[0] + 1]
    for _ in range(60):
        mid = (a0 + b0) / 2
        a0, b0 = (mid, b0) if gap(mid) < 0 else (a0, mid)
    return float(np.sqrt(a0) * span)


def bandwidth(x: np.ndarray, rule: str | float = "ISJ") -> float:
    if not isinstance(rule, str):
        return float(rule)
    if rule.lower() == "isj":
        return improved_sheather_jones(x)
    if rule.lower() in ("scott", "silverman"):
        return float(x.std(ddof=1) * len(x) ** -0.2 * (1.0 if rule.lower() == "scott" else 0.75**-0.2))
    raise ValueError("bw is 'ISJ', 'scott', 'silverman' or a number")


def density(x: np.ndarray, h: float, block: int = 2048) -> np.ndarray:
    """Gaussian kernel density of a sample at its own points."""
    out = np.empty(len(x))
    for i in range(0, len(x), block):
        out[i : i + block] = np.exp(-0.5 * ((x[i : i + block, None] - x[None, :]) / h) ** 2).sum(1)
    return out / (len(x) * h * np.sqrt(2 * np.pi))


def fit_kde(curv: DataFrame, bw: str | float = "ISJ", column: str = "curvature", by: str = "graph_id") -> DataFrame:
    """by, x, density of every value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["x"].to_numpy(float)
        h = bandwidth(x, bw)
        return pdf.assign(density=density(x, h) if h > 0 else np.inf)

    rows = curv.select(F.col(by).cast("string").alias(by), F.col(column).cast("double").alias("x")).where("x is not null")
    return rows.groupBy(by).applyInPandas(run, f"{by} string, x double, density double")


def entropy_kde_plugin(curv: DataFrame, bw: str | float = "ISJ", column: str = "curvature", by: str = "graph_id") -> DataFrame:
    """-mean ln(f(x) + 1e-10); 0 for a graph of one distinct value."""
    got = fit_kde(curv, bw, column, by).groupBy(by).agg((-F.avg(F.ln(F.col("density") + 1e-10))).alias("e"), F.count_distinct("x").alias("n"))
    return got.select(by, F.when(F.col("n") <= 1, 0.0).otherwise(F.col("e")).alias("entropy"))


def get_quantiles(curv: DataFrame, qs: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95), column: str = "curvature", by: str = "graph_id") -> DataFrame:
    """by, q, value: exact quantiles, linear between values."""
    got = curv.groupBy(by).agg(F.percentile(F.col(column), F.array(*map(F.lit, qs))).alias("p"))
    return got.select(by, F.posexplode("p").alias("k", "value")).select(by, F.element_at(F.array(*map(F.lit, qs)), F.col("k") + 1).alias("q"), "value")


def kl_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """One row: sum of p ln(p / (q + 1e-10)) over bins where both are positive; tables (bin, weight), made to sum to 1, a missing bin 0."""
    both = p.select("bin", F.col("weight").alias("p")).join(q.select("bin", F.col("weight").alias("q")), "bin", "full")
    sums = p.agg(F.sum("weight").alias("sp")).crossJoin(q.agg(F.sum("weight").alias("sq")))
    at_ = both.crossJoin(F.broadcast(sums)).select((F.col("p") / F.col("sp")).alias("p"), (F.col("q") / F.col("sq")).alias("q")).where("p > 0 and q > 0")
    return at_.agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("q") + 1e-10))).alias("kl"))


def compute_global_curvature_stats(curv: DataFrame) -> DataFrame:
    """One row over all graphs: mean, std (population), median, mad."""
    first = curv.agg(F.avg("curvature").alias("mean"), F.stddev_pop("curvature").alias("std"), F.median("curvature").alias("median"))
    away = curv.crossJoin(F.broadcast(first.select("median"))).agg(F.median(F.abs(F.col("curvature") - F.col("median"))).alias("mad"))
    return first.crossJoin(away)


def ecdf(rows: DataFrame, by: list[str], column: str = "curvature") -> DataFrame:
    """by, x, y with y = (rank - 1) / n from 0."""
    w = Window.partitionBy(*by)
    return rows.select(*by, F.col(column).alias("x"), ((F.row_number().over(w.orderBy(column)) - 1) / F.count("*").over(w)).alias("y"))


def downsample(rows: DataFrame, by: list[str], key: Column, size: int, seed: int = 42) -> DataFrame:
    """At most `size` rows of each group, those of the smallest md5 of seed and key: the same rows whatever the partitions."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_rank") <= size).drop("_rank")


def histogram(rows: DataFrame, bins: int, column: str = "curvature", by: str = "graph_id") -> DataFrame:
    """by, bin, n, low edge: equal bins between a group's ends; the greatest value falls in the last."""
    ends = rows.groupBy(by).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    k = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("low")) / F.nullif(width, F.lit(0.0)))))
    return rows.join(ends, by).groupBy(by, k.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min(F.col("low") + k * width).alias("edge"))


def freedman_diaconis(rows: DataFrame, column: str = "curvature", by: str = "graph_id") -> DataFrame:
    """by, width: 2 IQR / cube root of n."""
    p = F.percentile(column, F.array(F.lit(0.25), F.lit(0.75)))
    return rows.groupBy(by).agg(p.alias("p"), F.count(column).alias("n")).select(by, (2 * (F.col("p")[1] - F.col("p")[0]) / F.cbrt("n")).alias("width"))
