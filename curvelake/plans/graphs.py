"""Queries on trade graphs: construction, curvature, distributions, metrics, spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import curvature as cv
from ..operators import distribution as ds
from ..operators import graph as gr
from ..operators import metrics as mt
from ..operators import spectral as sp
from ..sources import graphs as src
from ..sources import trade as tr
from .registry import query, rounded

NATIONS = 25


def yearly(spark: SparkSession, d: str) -> DataFrame:
    return gr.remove_self_loops(tr.trade_edges(spark, d))


def pruned(spark: SparkSession, d: str) -> DataFrame:
    """Quarterly trade of at least the quarter's mean weight, without loops."""
    e = gr.remove_self_loops(tr.trade_edges(spark, d, "quarter"))
    return e.withColumn("_m", F.avg("weight").over(Window.partitionBy("graph_id"))).where("weight >= _m").drop("_m")


def nodes_of(spark: SparkSession, d: str, edges: DataFrame) -> DataFrame:
    nations = tr.table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("node"))
    return edges.select("graph_id").distinct().crossJoin(F.broadcast(nations))


def frc(spark: SparkSession, d: str) -> DataFrame:
    return cv.compute_frc(pruned(spark, d))


_JOINED = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3"
_ENDS = "least(c_nationkey, s_nationkey) AS u, greatest(c_nationkey, s_nationkey) AS v, CAST(count(*) AS DOUBLE) AS weight"
YEAR = f"trade AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS graph_id, {_ENDS} {_JOINED}), y AS (SELECT * FROM trade WHERE u <> v)"
QUARTER = f"tradeq AS (SELECT CAST(year(l_shipdate) AS VARCHAR) || 'Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS graph_id, {_ENDS} {_JOINED})"
PRUNED = QUARTER + ", e AS (SELECT graph_id, u, v, weight FROM (SELECT *, avg(weight) OVER (PARTITION BY graph_id) AS m FROM tradeq WHERE u <> v) WHERE weight >= m)"
BOTH = ", b AS (SELECT graph_id, u AS node, v AS other, weight FROM e UNION ALL SELECT graph_id, v, u, weight FROM e)"
NODES = ", nodes AS (SELECT graph_id, n_nationkey AS node FROM (SELECT DISTINCT graph_id FROM e), nation)"
TRI = ", t AS (SELECT x.graph_id, x.u AS a, x.v AS b, y2.v AS c FROM e x JOIN e y2 ON y2.graph_id = x.graph_id AND y2.u = x.v JOIN e z ON z.graph_id = x.graph_id AND z.u = x.u AND z.v = y2.v)"


def frc_sql(edges: str, name: str = "c") -> str:
    return f""", ends AS (SELECT graph_id, node, sum(1 / sqrt(weight)) AS s FROM (SELECT graph_id, u AS node, weight FROM {edges} UNION ALL SELECT graph_id, v, weight FROM {edges}) GROUP BY 1, 2),
    {name} AS (SELECT q.graph_id, q.u, q.v, q.weight, 2 - sqrt(q.weight) * ((a.s - 1 / sqrt(q.weight)) + (b2.s - 1 / sqrt(q.weight))) AS curvature
      FROM {edges} q JOIN ends a ON a.graph_id = q.graph_id AND a.node = q.u JOIN ends b2 ON b2.graph_id = q.graph_id AND b2.node = q.v)"""


FRC = "WITH " + PRUNED + frc_sql("e")
SORTED = FRC + ", s AS (SELECT graph_id, list_sort(list(curvature)) AS x, count(*) AS n, CAST(floor(sqrt(count(*)) + 0.5) AS BIGINT) AS m FROM c GROUP BY 1), i AS (SELECT graph_id, x, n, m, unnest(range(1, n + 1)) AS i FROM s)"
AFRC = (
    "WITH " + PRUNED + TRI + frc_sql("e") + """, r AS (SELECT graph_id, u, v, 1 / sqrt(weight) AS r FROM e),
    sides AS (SELECT graph_id, a AS u, b AS v, c AS z FROM t UNION ALL SELECT graph_id, a, c, b FROM t UNION ALL SELECT graph_id, b, c, a FROM t),
    faces AS (SELECT s.graph_id, s.u, s.v, count(*) AS t, sum(p.r + q.r) AS faced FROM sides s
      JOIN r p ON p.graph_id = s.graph_id AND p.u = least(s.u, s.z) AND p.v = greatest(s.u, s.z)
      JOIN r q ON q.graph_id = s.graph_id AND q.u = least(s.v, s.z) AND q.v = greatest(s.v, s.z) GROUP BY 1, 2, 3),
    ac AS (SELECT e.graph_id, e.u, e.v, e.weight * (coalesce(t, 0) * e.weight + 2 / e.weight - abs((a.s + b2.s - 2 / sqrt(e.weight) - coalesce(faced, 0)) / sqrt(e.weight))) AS curvature
      FROM e JOIN ends a ON a.graph_id = e.graph_id AND a.node = e.u JOIN ends b2 ON b2.graph_id = e.graph_id AND b2.node = e.v
      LEFT JOIN faces f ON f.graph_id = e.graph_id AND f.u = e.u AND f.v = e.v)"""
)


@query("WITH " + YEAR + frc_sql("y") + """, s AS (SELECT graph_id, list_sort(list(curvature)) AS x, count(*) AS n, CAST(floor(sqrt(count(*)) + 0.5) AS BIGINT) AS m FROM c GROUP BY 1),
    i AS (SELECT graph_id, x, n, m, unnest(range(1, n + 1)) AS i FROM s),
    h AS (SELECT graph_id, avg(CASE WHEN x[least(i + m, n)] > x[greatest(i - m, 1)] THEN ln(n / (2.0 * m) * (x[least(i + m, n)] - x[greatest(i - m, 1)])) ELSE '-inf'::DOUBLE END) AS entropy FROM i GROUP BY 1)
    SELECT graph_id, round(entropy, 6) AS entropy, round(quantile_cont(curvature, 0.05), 6) AS q05, round(quantile_cont(curvature, 0.5), 6) AS q50, round(quantile_cont(curvature, 0.95), 6) AS q95
    FROM c JOIN h USING (graph_id) GROUP BY graph_id, entropy""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Yearly trade: Forman curvature, its entropy and quantiles."""
    c = cv.compute_frc(yearly(spark, d))
    q = c.groupBy("graph_id").agg(F.percentile("curvature", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    at = q.select("graph_id", *(F.col("q")[k].alias(n) for k, n in enumerate(("q05", "q50", "q95"))))
    return rounded(ds.vec_entropy(c, "vasicek").join(at, "graph_id"))


@query("WITH " + YEAR + " SELECT * FROM trade")
def edges_year(spark: SparkSession, d: str) -> DataFrame:
    return tr.trade_edges(spark, d)


@query("WITH " + PRUNED + " SELECT * FROM e")
def edges_quarter_pruned(spark: SparkSession, d: str) -> DataFrame:
    return pruned(spark, d)


@query("WITH " + YEAR + " SELECT * FROM y")
def edges_no_loops(spark: SparkSession, d: str) -> DataFrame:
    return yearly(spark, d)


@query("WITH " + QUARTER + " SELECT * FROM tradeq WHERE weight >= 8")
def prune_by_weight(spark: SparkSession, d: str) -> DataFrame:
    return gr.prune_graph_by_weight(tr.trade_edges(spark, d, "quarter"), 8.0)


@query("WITH " + PRUNED + NODES + ", k AS (SELECT * FROM e WHERE weight >= 12) SELECT graph_id, node FROM nodes WHERE EXISTS (SELECT 1 FROM k WHERE k.graph_id = nodes.graph_id AND (k.u = node OR k.v = node))")
def pruned_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = pruned(spark, d)
    return gr.pruned_nodes(e, nodes_of(spark, d, e), 12.0)


_CELLS = "cells AS (SELECT graph_id, u AS i, v AS j, curvature AS value FROM c UNION ALL SELECT graph_id, v, u, curvature FROM c)"


@query(FRC + ", " + _CELLS + " SELECT graph_id, i AS u, j AS v, round(abs(value), 6) AS weight FROM cells WHERE i <= j AND value <> 0")
def window_graphs_from_matrices(spark: SparkSession, d: str) -> DataFrame:
    c = frc(spark, d)
    cells = gr.both_ways(c.select(*gr.EDGE, "curvature")).select("graph_id", F.col("node").alias("i"), F.col("other").alias("j"), F.col("curvature").alias("value"))
    return rounded(gr.build_sliding_window_graphs(cells))


@query("WITH " + PRUNED + " SELECT graph_id, min(weight) AS least, max(weight) AS most, round(avg(weight), 6) AS mean FROM e GROUP BY 1")
def edge_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gr.edge_stats(pruned(spark, d), "weight"))


@query("WITH " + YEAR + """, two AS (SELECT graph_id, v AS u, u AS v, weight + (u % 3) AS weight FROM y UNION ALL SELECT graph_id, u, v, weight FROM y)
    SELECT graph_id, least(u, v) AS u, greatest(u, v) AS v, max(weight) AS weight FROM two GROUP BY 1, 2, 3""")
def symmetrised(spark: SparkSession, d: str) -> DataFrame:
    y = yearly(spark, d)
    other = y.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v"), (F.col("weight") + F.col("u") % 3).alias("weight"))
    return gr.symmetrise(y.unionByName(other))


@query("WITH " + YEAR + """, cells AS (SELECT u, v, sum(weight) AS weight, sum(weight) * 10 AS tract FROM y GROUP BY 1, 2),
    bothc AS (SELECT u, v, weight, tract FROM cells UNION ALL SELECT v, u, weight, tract FROM cells)
    SELECT u, v, round(sum(weight) / 2, 6) AS weight, round(sum(tract) / 2000, 6) AS length FROM bothc GROUP BY 1, 2""")
def connectome(spark: SparkSession, d: str) -> DataFrame:
    return rounded(src.load_connectome(_cells(spark, d)))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """All years' trade as one graph."""
    return yearly(spark, d).groupBy("u", "v").agg(F.sum("weight").alias("weight")).select("u", "v", "weight", (F.col("weight") * 10).alias("tract"))


_DIRECTED = YEAR + ", w AS (SELECT u, v, sum(weight) AS weight FROM y GROUP BY 1, 2), con AS (SELECT u, v, weight FROM w UNION ALL SELECT v, u, weight FROM w)"


def _directed(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    return c.select("u", "v", "weight").unionByName(c.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))


@query("WITH " + _DIRECTED + """, den AS (SELECT sum(CASE WHEN weight > 0 THEN 1 ELSE 0 END) / 625.0 AS den FROM con),
    lab AS (SELECT n_nationkey AS node, n_regionkey AS r FROM nation),
    link AS (SELECT m.node AS m, s.node AS s, den / 100 * 3.0 AS weight FROM lab m, lab s, den WHERE m.r = 0 AND s.r = 1)
    SELECT u, v, round(weight, 6) AS weight FROM (SELECT u, v, weight FROM con UNION ALL SELECT u + 25, v + 25, weight FROM con UNION ALL SELECT m, s + 25, weight FROM link
      UNION ALL SELECT s + 25, m, weight FROM link UNION ALL SELECT s, m + 25, weight FROM link UNION ALL SELECT m + 25, s, weight FROM link)""")
def virtual_partner(spark: SparkSession, d: str) -> DataFrame:
    labels = tr.table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("label"))
    return rounded(gr.create_virtual_partner_connectome(_directed(spark, d), labels, NATIONS, 3.0, ("r0",), ("r1",)))


_RUNS = """, idx AS (SELECT graph_id, dense_rank() OVER (ORDER BY graph_id) - 1 AS run_idx FROM (SELECT DISTINCT graph_id FROM y)),
    merged AS (SELECT 'all' AS graph_id, u + 25 * run_idx AS u, v + 25 * run_idx AS v, weight FROM y JOIN idx USING (graph_id))"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    y = yearly(spark, d)
    idx = src.temporal_tensor(y.select("graph_id").distinct()).withColumnRenamed("frame", "run_idx")
    return gr.aggregate_window_graphs(y.join(idx, "graph_id").withColumn("graph_id", F.lit("all")), NATIONS)


@query("WITH " + YEAR + _RUNS + " SELECT * FROM merged")
def merge_runs(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)


@query("WITH " + _DIRECTED + _RUNS + """ SELECT m.graph_id, m.u, m.v, m.weight, m.weight AS plv_weight, CASE WHEN m.u // 25 = m.v // 25 THEN coalesce(con.weight, 0) ELSE 0 END AS connectome_weight,
    CASE WHEN m.u // 25 = m.v // 25 THEN m.u // 25 ELSE -1 END AS source_run FROM merged m LEFT JOIN con ON con.u = m.u % 25 AND con.v = m.v % 25""")
def attach_connectome(spark: SparkSession, d: str) -> DataFrame:
    return gr.attach_connectome_weights(_merged(spark, d), _directed(spark, d), NATIONS)


@query("WITH " + _DIRECTED + " SELECT u, v, weight FROM con UNION ALL SELECT u + 25, v + 25, weight FROM con")
def resolve_connectome(spark: SparkSession, d: str) -> DataFrame:
    return gr.resolve_connectome_weights(_directed(spark, d), NATIONS, 2 * NATIONS)


# Curvature


@query(FRC + " SELECT graph_id, u, v, weight, round(curvature, 6) AS curvature FROM c")
def frc_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(frc(spark, d))


@query(AFRC + " SELECT e.graph_id, e.u, e.v, e.weight, round(curvature, 5) AS curvature FROM ac JOIN e ON e.graph_id = ac.graph_id AND e.u = ac.u AND e.v = ac.v")
def afrc_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cv.compute_afrc(pruned(spark, d)), 5)


@query(FRC + " SELECT graph_id, node, round(avg(curvature), 6) AS curvature FROM (SELECT graph_id, u AS node, curvature FROM c UNION ALL SELECT graph_id, v, curvature FROM c) GROUP BY 1, 2")
def frc_node_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cv.node_curvature(frc(spark, d)))


@query(FRC + ", " + _CELLS + NODES + """ SELECT a.graph_id, a.node AS i, b3.node AS j, round(coalesce(value, 0), 6) AS value FROM nodes a JOIN nodes b3 ON b3.graph_id = a.graph_id
    LEFT JOIN cells ON cells.graph_id = a.graph_id AND cells.i = a.node AND cells.j = b3.node""")
def curv_dense(spark: SparkSession, d: str) -> DataFrame:
    c = frc(spark, d)
    return rounded(cv.curvature_matrices(c, nodes_of(spark, d, c)))


_POSITIVE = FRC + ", p AS (SELECT 1e-9 - min(-curvature) AS shift FROM c)"


@query(_POSITIVE + " SELECT graph_id, u, v, weight, round(curvature, 6) AS curvature, round(shift - curvature, 6) AS positive_weight FROM c, p")
def curv_transform_positive(spark: SparkSession, d: str) -> DataFrame:
    c = frc(spark, d)
    return rounded(cv.transform_curvature_collection(c, cv.fit_global_positive_linear_transform(c)))


@query(_POSITIVE + " SELECT graph_id, round(min(shift - curvature), 6) AS least, round(max(shift - curvature), 6) AS most, min(shift - curvature) > 0 AS all_positive FROM c, p GROUP BY 1")
def curv_positive_check(spark: SparkSession, d: str) -> DataFrame:
    c = frc(spark, d)
    return rounded(cv.check_all_positive(cv.transform_curvature_collection(c, cv.fit_global_positive_linear_transform(c))))


@query(FRC + " SELECT graph_id, u, v, weight, round(1 - (curvature + 1), 6) AS curvature FROM c")
def curv_update_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cv.update_weights(cv.update_weight(frc(spark, d))))


# Distributions


@query(FRC + ", q AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS q) SELECT graph_id, CAST(q AS DOUBLE) AS q, round(CASE q WHEN 0.05 THEN quantile_cont(curvature, 0.05) WHEN 0.25 THEN quantile_cont(curvature, 0.25) WHEN 0.5 THEN quantile_cont(curvature, 0.5) WHEN 0.75 THEN quantile_cont(curvature, 0.75) ELSE quantile_cont(curvature, 0.95) END, 6) AS value FROM c, q GROUP BY graph_id, q")
def curv_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ds.get_quantiles(frc(spark, d)))


@query(FRC + ", g AS (SELECT avg(curvature) AS mean, stddev_pop(curvature) AS std, median(curvature) AS med FROM c) SELECT round(mean, 6) AS mean, round(std, 6) AS std, round(med, 6) AS median, round((SELECT median(abs(curvature - med)) FROM c, g), 6) AS mad FROM g")
def curv_global_stats_mad(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ds.compute_global_curvature_stats(frc(spark, d)))


@query(FRC + " SELECT graph_id, round(curvature, 6) AS x, round((row_number() OVER (PARTITION BY graph_id ORDER BY round(curvature, 6)) - 1) / CAST(count(*) OVER (PARTITION BY graph_id) AS DOUBLE), 6) AS y FROM c")
def curv_ecdf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ds.ecdf(rounded(frc(spark, d)), ["graph_id"]))


_BINS = ", bins AS (SELECT graph_id, CAST(floor(curvature / 5) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS weight FROM c GROUP BY 1, 2), ends2 AS (SELECT min(graph_id) AS a, max(graph_id) AS z FROM c)"


@query(FRC + _BINS + """, p AS (SELECT bin, weight / sum(weight) OVER () AS p FROM bins, ends2 WHERE graph_id = a), q AS (SELECT bin, weight / sum(weight) OVER () AS q FROM bins, ends2 WHERE graph_id = z)
    SELECT round(sum(p * ln(p / (q + 1e-10))), 6) AS kl FROM p JOIN q USING (bin)""")
def curv_kl(spark: SparkSession, d: str) -> DataFrame:
    bins = frc(spark, d).groupBy("graph_id", F.floor(F.col("curvature") / 5).alias("bin")).agg(F.count("*").cast("double").alias("weight"))
    one = lambda f: bins.join(F.broadcast(bins.agg(f("graph_id").alias("graph_id"))), "graph_id", "left_semi").select("bin", "weight")
    return rounded(ds.kl_divergence(one(F.min), one(F.max)))


_HI, _LO = "x[least(i + m, n)]", "x[greatest(i - m, 1)]"
_EPS = """, e4 AS (SELECT graph_id, n, greatest(1e-10, list_min([greatest(x[i] - x[s], x[s + 4] - x[i]) FOR s IN range(greatest(1, i - 4), least(i, n - 4) + 1)])) AS eps FROM i)"""
_PSI = "(SELECT sum(1.0 / r) FROM range(1, 4) AS z(r))"


@query(SORTED + f" SELECT graph_id, round(avg(CASE WHEN {_HI} > {_LO} THEN ln(n / (2.0 * m) * ({_HI} - {_LO})) ELSE '-inf'::DOUBLE END), 6) AS entropy FROM i GROUP BY 1")
def entropy_vasicek(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ds.vec_entropy(frc(spark, d), "vasicek"))


@query(SORTED + """ SELECT graph_id, round(sum(CASE WHEN i <= n - m THEN CASE WHEN x[i + m] > x[i] THEN ln((n + 1.0) / m * (x[i + m] - x[i])) ELSE '-inf'::DOUBLE END ELSE 0 END) / (max(n) - max(m)) + sum(CASE WHEN i >= m THEN 1.0 / i ELSE 0 END) + ln(max(m)) - ln(max(n) + 1), 6) AS entropy
    FROM i GROUP BY 1""")
def entropy_van_es(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ds.vec_entropy(frc(spark, d), "van_es"))


@query(SORTED + f""" SELECT graph_id, round(avg(CASE WHEN {_HI} > {_LO} THEN ln(n / ((CASE WHEN i <= m THEN 1 + (i - 1.0) / m WHEN i > n - m THEN 1 + CAST(n - i AS DOUBLE) / m ELSE 2.0 END) * m) * ({_HI} - {_LO})) ELSE '-inf'::DOUBLE END), 6) AS entropy FROM i GROUP BY 1""")
def entropy_ebrahimi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ds.vec_entropy(frc(spark, d), "ebrahimi"))


@query(SORTED + """, k AS (SELECT graph_id, n, i, m, unnest(range(-m, m + 1)) AS j, x FROM i), v AS (SELECT graph_id, n, i, j, x[greatest(1, least(n, i + j))] AS v FROM k),
    mean AS (SELECT graph_id, i, avg(v) AS mu FROM v GROUP BY 1, 2), b4 AS (SELECT v.graph_id, v.i, max(n) AS n, sum((v - mu) * j) AS top, sum((v - mu) * (v - mu)) AS low FROM v JOIN mean ON mean.graph_id = v.graph_id AND mean.i = v.i GROUP BY 1, 2)
    SELECT graph_id, round(avg(-CASE WHEN low = 0 THEN 'inf'::DOUBLE WHEN top <= 0 THEN '-inf'::DOUBLE ELSE ln(top / (n * low)) END), 6) AS entropy FROM b4 GROUP BY 1""")
def entropy_correa(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ds.vec_entropy(frc(spark, d), "correa"))


@query(SORTED + _EPS + f", h AS (SELECT graph_id, max(n) AS n, avg(ln(eps)) AS mean FROM e4 WHERE n > 4 GROUP BY 1) SELECT graph_id, round((SELECT sum(1.0 / r) FROM range(1, n) AS z(r)) - {_PSI} + ln(2) + mean, 6) AS entropy FROM h")
def entropy_kozachenko(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ds.vec_entropy(frc(spark, d), "kozachenko"))


@query(SORTED + _EPS + " SELECT graph_id, round(-ln(avg(1 / ((n - 1) * (1 / 3.0) * 2 * eps * (2.0 * 3 * 3) / 6))), 6) AS entropy FROM e4 GROUP BY 1".replace("(1 / 3.0) * 2 * eps * (2.0 * 3 * 3) / 6", "2 * eps / 3.0"))
def entropy_renyi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ds.vec_entropy(frc(spark, d), "renyi"))


@query(SORTED + _EPS + " SELECT graph_id, round(1 - avg(1 / ((n - 1) * 2 * eps / 3.0)), 6) AS entropy FROM e4 GROUP BY 1")
def entropy_tsallis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ds.vec_entropy(frc(spark, d), "tsallis"))


@query(FRC + """, h AS (SELECT graph_id, count(*) AS n, stddev_samp(curvature) * power(count(*), -0.2) AS h FROM c GROUP BY 1),
    f AS (SELECT a.graph_id, a.u, a.v, sum(exp(-0.5 * power((a.curvature - b5.curvature) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())) AS f FROM c a JOIN c b5 ON b5.graph_id = a.graph_id JOIN h ON h.graph_id = a.graph_id GROUP BY 1, 2, 3)
    SELECT graph_id, round(avg(-ln(f + 1e-10)), 6) AS entropy FROM f GROUP BY 1""")
def entropy_kde_scott(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ds.entropy_kde_scott(frc(spark, d)))


@query()
def entropy_kde_isj(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ds.entropy_kde_plugin(frc(spark, d)))


@query(FRC + """, r6 AS (SELECT graph_id, round(curvature, 6) AS x FROM c), lim AS (SELECT graph_id, min(x) AS low, max(x) AS high FROM r6 GROUP BY 1),
    k AS (SELECT graph_id, low, high, x, CASE WHEN high = low THEN 0 ELSE least(19, floor((x - low) / ((high - low) / 20))) END AS bin FROM r6 JOIN lim USING (graph_id))
    SELECT graph_id, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(min(low + bin * ((high - low) / 20)), 6) AS edge FROM k GROUP BY 1, 2""")
def curv_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ds.histogram(rounded(frc(spark, d)), 20))


@query(FRC + " SELECT graph_id, round(2 * (quantile_cont(curvature, 0.75) - quantile_cont(curvature, 0.25)) / cbrt(count(*)), 6) AS width FROM c GROUP BY 1")
def curv_freedman_diaconis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ds.freedman_diaconis(frc(spark, d)))


@query(FRC + " SELECT graph_id, u, v, round(curvature, 6) AS curvature FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY md5('42|' || graph_id || '-' || u || '-' || v)) AS r FROM c) WHERE r <= 50")
def curv_downsample(spark: SparkSession, d: str) -> DataFrame:
    c = frc(spark, d).select("graph_id", "u", "v", "curvature")
    return rounded(ds.downsample(c, ["graph_id"], F.concat_ws("-", "graph_id", F.col("u").cast("string"), F.col("v").cast("string")), 50))


# Metrics

_DEG = ", dg AS (SELECT graph_id, node, count(*) AS degree, sum(weight) AS strength FROM b GROUP BY 1, 2)"


@query("WITH " + PRUNED + BOTH + _DEG + " SELECT * FROM (SELECT graph_id, node, degree, strength, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY strength DESC, node) AS INTEGER) AS rank FROM dg) WHERE rank <= 10")
def degree_strength_topk(spark: SparkSession, d: str) -> DataFrame:
    return mt.top_nodes(pruned(spark, d), "strength", 10)


@query("WITH " + PRUNED + NODES + """ SELECT graph_id, 25 AS n_nodes, count(*) AS n_edges, round(2.0 * count(*) / 600, 6) AS density, 2 * count(*) = 600 AS is_complete FROM e GROUP BY 1""")
def density(spark: SparkSession, d: str) -> DataFrame:
    e = pruned(spark, d)
    return rounded(mt.density(e, nodes_of(spark, d, e)))


@query("WITH " + PRUNED + NODES + " SELECT graph_id, node FROM nodes WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph_id = nodes.graph_id AND weight >= 16 AND (u = node OR v = node))")
def isolates(spark: SparkSession, d: str) -> DataFrame:
    e = pruned(spark, d)
    return mt.isolates(e.where("weight >= 16"), nodes_of(spark, d, e))


@query("WITH " + PRUNED + TRI + " SELECT graph_id, node, count(*) AS triangles FROM (SELECT graph_id, a AS node FROM t UNION ALL SELECT graph_id, b FROM t UNION ALL SELECT graph_id, c FROM t) GROUP BY 1, 2")
def triangles(spark: SparkSession, d: str) -> DataFrame:
    return mt.triangle_counts(pruned(spark, d))


@query("WITH " + PRUNED + BOTH + TRI + """, n AS (SELECT graph_id, u, v, weight / max(weight) OVER (PARTITION BY graph_id) AS w FROM e),
    tw AS (SELECT t.*, cbrt(p.w * q.w * r.w) AS value FROM t JOIN n p ON p.graph_id = t.graph_id AND p.u = a AND p.v = b JOIN n q ON q.graph_id = t.graph_id AND q.u = a AND q.v = c JOIN n r ON r.graph_id = t.graph_id AND r.u = b AND r.v = c),
    s AS (SELECT graph_id, node, sum(value) AS s FROM (SELECT graph_id, a AS node, value FROM tw UNION ALL SELECT graph_id, b, value FROM tw UNION ALL SELECT graph_id, c, value FROM tw) GROUP BY 1, 2),
    dd AS (SELECT graph_id, node, count(*) AS d FROM b GROUP BY 1, 2)
    SELECT dd.graph_id, dd.node, round(CASE WHEN d < 2 THEN 0 ELSE coalesce(2 * s / (d * (d - 1)), 0) END, 6) AS clustering FROM dd LEFT JOIN s ON s.graph_id = dd.graph_id AND s.node = dd.node""")
def clustering_onnela(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.clustering(pruned(spark, d)))


@query("WITH " + PRUNED + BOTH + _DEG + """, p AS (SELECT b.graph_id, a.strength AS x, z.strength AS y FROM b JOIN dg a ON a.graph_id = b.graph_id AND a.node = b.node JOIN dg z ON z.graph_id = b.graph_id AND z.node = b.other)
    SELECT graph_id, round(corr(x, y), 6) AS assortativity FROM p GROUP BY 1""")
def assortativity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.compute_assortativity(pruned(spark, d)))


_WALKED = "WITH RECURSIVE " + PRUNED + BOTH


@query(_WALKED + ", reach AS (SELECT DISTINCT graph_id, node, node AS to_ FROM b UNION SELECT r.graph_id, r.node, b.other FROM reach r JOIN b ON b.graph_id = r.graph_id AND b.node = r.to_) SELECT graph_id, node, min(to_) AS component FROM reach GROUP BY 1, 2")
def components(spark: SparkSession, d: str) -> DataFrame:
    return mt.connected_components(pruned(spark, d))


_HOPS = _WALKED + ", walk AS (SELECT DISTINCT graph_id, node AS source, node, 0 AS hops FROM b UNION SELECT w.graph_id, w.source, b.other, w.hops + 1 FROM walk w JOIN b ON b.graph_id = w.graph_id AND b.node = w.node WHERE w.hops < 12), near AS (SELECT graph_id, source, node, min(hops) AS hops FROM walk GROUP BY 1, 2, 3)"


@query(_HOPS + " SELECT * FROM near")
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    return mt.hop_distances(pruned(spark, d))


@query(_HOPS + " SELECT graph_id, round(sum(CASE WHEN hops > 0 THEN 1.0 / hops ELSE 0 END) / 600, 6) AS global_efficiency FROM near GROUP BY 1")
def global_efficiency(spark: SparkSession, d: str) -> DataFrame:
    e = pruned(spark, d)
    return rounded(mt.compute_global_efficiency(e, nodes_of(spark, d, e)))


@query()
def network_summary(spark: SparkSession, d: str) -> DataFrame:
    e = pruned(spark, d)
    return rounded(mt.summarize_network(e, nodes_of(spark, d, e)))


@query()
def communities(spark: SparkSession, d: str) -> DataFrame:
    return mt.communities(pruned(spark, d), "louvain")


@query("WITH " + PRUNED + """, p AS (SELECT n_nationkey AS node, n_regionkey AS community FROM nation), q AS (SELECT graph_id, weight, a.community AS cu, b6.community AS cv FROM e JOIN p a ON a.node = u JOIN p b6 ON b6.node = v),
    tot AS (SELECT graph_id, sum(weight) AS m FROM q GROUP BY 1), ins AS (SELECT graph_id, cu AS c, sum(weight) AS inside FROM q WHERE cu = cv GROUP BY 1, 2),
    en AS (SELECT graph_id, c, sum(weight) AS ends FROM (SELECT graph_id, cu AS c, weight FROM q UNION ALL SELECT graph_id, cv, weight FROM q) GROUP BY 1, 2)
    SELECT en.graph_id, round(sum(coalesce(inside, 0) / m - power(ends / (2 * m), 2)), 6) AS modularity FROM en JOIN tot ON tot.graph_id = en.graph_id LEFT JOIN ins ON ins.graph_id = en.graph_id AND ins.c = en.c GROUP BY 1""")
def modularity_by_region(spark: SparkSession, d: str) -> DataFrame:
    e = pruned(spark, d)
    regions = tr.table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    return rounded(mt.partition_modularity(e, e.select("graph_id").distinct().crossJoin(F.broadcast(regions))))


@query()
def modularity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.compute_modularity(pruned(spark, d)))


@query()
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.find_centrality(pruned(spark, d)))


_DYAD = YEAR.split(", y AS")[0].replace("least(c_nationkey, s_nationkey) AS u, greatest(c_nationkey, s_nationkey) AS v", "c_nationkey AS i, s_nationkey + 25 AS j") + """, sc AS (SELECT graph_id, i, j, weight / max(weight) OVER (PARTITION BY graph_id) AS value FROM trade),
    axis AS (SELECT unnest(range(50)) AS k), cells AS (SELECT g.graph_id, a.k AS i, z.k AS j, coalesce(s.value, r.value, 0) AS value FROM (SELECT DISTINCT graph_id FROM sc) g CROSS JOIN axis a CROSS JOIN axis z
      LEFT JOIN sc s ON s.graph_id = g.graph_id AND s.i = a.k AND s.j = z.k LEFT JOIN sc r ON r.graph_id = g.graph_id AND r.i = z.k AND r.j = a.k)"""


@query("WITH " + _DYAD + """ SELECT graph_id, round(avg(value) FILTER (WHERE i < 25 AND j >= 25), 6) AS cross_mean, round(stddev_pop(value) FILTER (WHERE i < 25 AND j >= 25), 6) AS cross_std, round(avg(abs(value)) FILTER (WHERE i < 25 AND j >= 25), 6) AS cross_abs_mean,
    round(avg(abs(value)) FILTER (WHERE i < j AND j < 25), 6) AS intra_a_mean, round(avg(abs(value)) FILTER (WHERE i < j AND i >= 25), 6) AS intra_b_mean, round(sum(abs(value)) FILTER (WHERE i < j), 6) AS total_strength FROM cells GROUP BY 1""")
def connectivity_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.connectivity_matrix_features(tr.dyad_cells(spark, d), 25))


@query()
def window_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.window_features(tr.dyad_cells(spark, d), 25, 0.5))


@query("WITH " + _DYAD + " SELECT CAST(a.graph_id AS INTEGER) AS f, CAST(z.graph_id AS INTEGER) AS g, round(corr(a.value, z.value), 6) AS r FROM cells a JOIN cells z ON z.i = a.i AND z.j = a.j WHERE a.graph_id <= z.graph_id GROUP BY 1, 2")
def frame_similarity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.frame_similarity(tr.dyad_cells(spark, d).select(F.col("graph_id").cast("int").alias("frame"), "i", "j", "value")))


# Spectra


@query("WITH " + PRUNED + BOTH + " SELECT graph_id, node AS i, other AS j, -weight AS value FROM b UNION ALL SELECT graph_id, node, node, sum(weight) FROM b GROUP BY 1, 2")
def laplacian_long(spark: SparkSession, d: str) -> DataFrame:
    return sp.laplacian(pruned(spark, d))


@query("WITH " + YEAR + " SELECT * FROM y WHERE NOT (u = 2 AND v = 3)")
def edge_deletion(spark: SparkSession, d: str) -> DataFrame:
    return sp.edge_deletion(yearly(spark, d), 3, 2)


@query()
def fiedler(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sp.eigen_in_time(pruned(spark, d)))


def _positive(spark: SparkSession, d: str) -> DataFrame:
    c = cv.compute_frc(yearly(spark, d))
    return cv.transform_curvature_collection(c, cv.fit_global_positive_linear_transform(c, rescale=(0.1, 1.0)))


@query()
def gdd_successive(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sp.compute_successive_gdd(_positive(spark, d), NATIONS, "positive_weight"))


@query()
def gdd_pairwise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sp.compute_pairwise_gdd(_positive(spark, d), NATIONS, "positive_weight"))


@query()
def edp(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sp.edge_deletion_perturbation(pruned(spark, d), NATIONS))


@query()
def orc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cv.compute_orc(pruned(spark, d)))


@query()
def orc_flow(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cv.ricci_flow(pruned(spark, d), 5), 4)


@query()
def ricci_flow_metric(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cv.ricci_flow_metric(pruned(spark, d)))


@query()
def forman_flow(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cv.forman_ricci_flow(pruned(spark, d), 5, step=0.01), 4)
