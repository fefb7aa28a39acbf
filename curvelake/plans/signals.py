"""Queries on signals, vectors and long statistics tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph as gr
from ..operators import ml
from ..operators import phase as ph
from ..operators import simulation as sim
from ..operators import stats as st
from ..operators import surrogates as su
from ..sources import trade as tr
from .registry import query, rounded

_SIGNAL = """h AS (SELECT event_type, date_trunc('hour', ts) AS h, sum(value) AS x FROM events GROUP BY 1, 2),
    ch AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS channel FROM (SELECT DISTINCT event_type FROM events)),
    x AS (SELECT channel, CAST(epoch(h) - epoch((SELECT min(h) FROM h)) AS BIGINT) // 3600 AS t, x FROM h JOIN ch USING (event_type)), n AS (SELECT max(t) + 1 AS n FROM x),
    f AS (SELECT g.channel, g.t, coalesce(x.x, 0) AS x FROM (SELECT channel, t FROM ch, (SELECT unnest(range(n)) AS t FROM n)) g LEFT JOIN x ON x.channel = g.channel AND x.t = g.t),
    sg AS (SELECT a.channel, a.t, atan2(a.x - coalesce(b.x, a.x), a.x - m) AS phase, a.x AS x FROM f a LEFT JOIN f b ON b.channel = a.channel AND b.t = a.t - 1 JOIN (SELECT channel, avg(x) AS m FROM f GROUP BY 1) q ON q.channel = a.channel)"""
_PAIRS = _SIGNAL + ", p AS (SELECT a.t, a.channel AS u, b.channel AS v, a.phase AS a, b.phase AS b FROM sg a JOIN sg b ON b.t = a.t AND a.channel <= b.channel)"
_PLV = "sqrt(power(avg(cos(a - b)), 2) + power(avg(sin(a - b)), 2))"


@query("WITH " + _SIGNAL + " SELECT channel, t, round(phase, 6) AS phase, round(x, 6) AS x, 'events' AS run FROM sg")
def signal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.phases(spark, d))


_WINDOWS = _PAIRS + f", w AS (SELECT k AS win, u, v, {_PLV} AS weight FROM p, (SELECT unnest(range((n - 120) // 60 + 1)) AS k FROM n) WHERE t >= k * 60 AND t < k * 60 + 120 GROUP BY 1, 2, 3)"


@query("WITH " + _WINDOWS + ' SELECT \'events\' AS run, win AS "window", u, v, round(weight, 6) AS weight FROM w')
def plv_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gr.sliding_window_plv(tr.phases(spark, d), 120, 60, tr.hours(spark, d)))


@query("WITH " + _PAIRS + f" SELECT 'events' AS run, k AS \"window\", u, v, round({_PLV}, 6) AS weight FROM p, (SELECT unnest(range((n - 120) // 50 + 1)) AS k FROM n) WHERE t >= k * 50 AND t < k * 50 + 120 GROUP BY 2, 3, 4")
def plv_windows_uneven(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gr.sliding_window_plv(tr.phases(spark, d), 120, 50, tr.hours(spark, d)))


@query("WITH " + _WINDOWS + " SELECT 'events' AS run, win AS \"window\", round(avg(weight), 6) AS avg_plv FROM w GROUP BY 2")
def avg_plv(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gr.get_avg_plv(gr.sliding_window_plv(tr.phases(spark, d), 120, 60, tr.hours(spark, d))))


@query("WITH " + _PAIRS + f" SELECT 'events' AS run, u, v, round({_PLV}, 6) AS plv FROM p WHERE u < v GROUP BY 2, 3")
def plv_pair(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ph.compute_plv(tr.phases(spark, d)))


@query("WITH " + _PAIRS + f", m AS (SELECT u, v, {_PLV} AS weight FROM p GROUP BY 1, 2) SELECT 'merged' AS run, u, v, round(weight, 6) AS weight FROM m WHERE u <> v AND weight >= 0.05")
def merged_plv(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gr.build_merged_plv_graph(tr.phases(spark, d).withColumn("run_idx", F.lit(0)), 5, 0.05))


@query("WITH " + _PAIRS + " SELECT 'events' AS run, u, v, round(abs(avg(sin(a - b))) / avg(abs(sin(a - b))), 6) AS wpli FROM p WHERE u < v GROUP BY 2, 3")
def wpli_pair(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ph.compute_wpli(tr.phases(spark, d)))


@query("WITH " + _PAIRS + """, m AS (SELECT u, v, atan2(sum(sin(a - b)), sum(cos(a - b))) AS pm, atan2(sum(sin(a + b)), sum(cos(a + b))) AS pp, sqrt(power(sum(sin(a - b)), 2) + power(sum(cos(a - b)), 2)) AS nm,
      sqrt(power(sum(sin(a + b)), 2) + power(sum(cos(a + b)), 2)) AS np FROM p WHERE u < v GROUP BY 1, 2)
    SELECT 'events' AS run, p.u, p.v, round(abs((nm - np) / (2 * sqrt(sum(power(sin(a - (pm + pp) / 2), 2)) * sum(power(sin(b - (pp - pm) / 2), 2))))), 6) AS ccorr FROM p JOIN m ON m.u = p.u AND m.v = p.v GROUP BY p.u, p.v, nm, np""")
def ccorr_pair(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ph.circular_correlation(tr.phases(spark, d)))


@query("WITH " + _SIGNAL + " SELECT 'events' AS run, t, round(sqrt(power(avg(cos(phase)), 2) + power(avg(sin(phase)), 2)), 6) AS r FROM sg GROUP BY 2")
def order_parameter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sim.order_parameter(tr.phases(spark, d)))


@query()
def imag_coherence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ph.compute_imaginary_coherence(tr.phases(spark, d), 24.0))


@query()
def hilbert_phase(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ph.hilbert_phase(tr.phases(spark, d)), 4)


# Vectors

_V = "v AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings)"
_EUCLID = "WITH " + _V + ", dist AS (SELECT a.id AS i, b.id AS j, round(list_distance(a.e, b.e), 3) AS d FROM v a JOIN v b ON a.id < b.id)"
_RANKED = _EUCLID + ", mir AS (SELECT i, j, d FROM dist UNION ALL SELECT j, i, d FROM dist), rk AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM mir)"


def _euclid(spark: SparkSession, d: str) -> DataFrame:
    v = tr.vectors(spark, d)
    return gr.adj_matrix(v, v.count(), 1)


def _nearest(spark: SparkSession, d: str, k: int) -> DataFrame:
    v = tr.vectors(spark, d)
    return gr.nearest(v, v.count(), k)


@query(_EUCLID + " SELECT * FROM dist")
def dist_euclid(spark: SparkSession, d: str) -> DataFrame:
    return _euclid(spark, d)


@query("WITH " + _V + " SELECT a.id AS i, b.id AS j, round(1 - list_cosine_similarity(a.e, b.e), 3) AS d FROM v a JOIN v b ON a.id < b.id")
def dist_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = tr.vectors(spark, d)
    return gr.adj_matrix(v, v.count(), 2)


@query("WITH " + _V + """, x AS (SELECT id, unnest(e) AS x, unnest(range(len(e))) AS k FROM v), r AS (SELECT id, k, rank() OVER (PARTITION BY id ORDER BY x) + (count(*) OVER (PARTITION BY id, x) - 1) / 2.0 AS r FROM x)
    SELECT a.id AS i, b.id AS j, round(1 - abs(corr(a.r, b.r)) + 1e-9, 3) AS d FROM r a JOIN r b ON b.k = a.k AND a.id < b.id GROUP BY 1, 2""")
def dist_spearman(spark: SparkSession, d: str) -> DataFrame:
    v = tr.vectors(spark, d)
    return gr.adj_matrix(v, v.count(), 3)


@query(_RANKED + " SELECT least(i, j) AS u, greatest(i, j) AS v, min(d) AS weight FROM rk WHERE rank <= 5 GROUP BY 1, 2")
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return gr.nearest_neighbor_graph(_nearest(spark, d, 5), 5, True)


@query(_EUCLID + """, mir AS (SELECT i, j, d FROM dist UNION ALL SELECT j, i, d FROM dist UNION ALL SELECT id, id, 0.0 FROM v), rk AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM mir)
    SELECT least(i, j) AS u, greatest(i, j) AS v, min(d) AS weight FROM rk WHERE rank <= 5 GROUP BY 1, 2""")
def sim_graph(spark: SparkSession, d: str) -> DataFrame:
    return gr.sim_graph(_nearest(spark, d, 5), tr.vectors(spark, d), 5)


@query(_RANKED + """, rho AS (SELECT i, 1 / max(d) AS rho FROM rk WHERE rank <= 20 GROUP BY 1), ends AS (SELECT min(rho) AS low, max(rho) AS high FROM rho),
    k AS (SELECT i, CAST(round_even(5 + 15 * ((rho - low) / (high - low)), 0) AS INTEGER) AS k FROM rho, ends)
    SELECT least(rk.i, j) AS u, greatest(rk.i, j) AS v, min(d) AS weight FROM rk JOIN k ON k.i = rk.i WHERE rank <= k GROUP BY 1, 2""")
def adaptive_graph(spark: SparkSession, d: str) -> DataFrame:
    return gr.adaptive_neighborhood_graph(_nearest(spark, d, 20), 5, 20)


@query()
def knn_graph_lsh(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gr.nearest_neighbor_graph_lsh(tr.vectors(spark, d), 5, 4.0, 6))


# Statistics

LONG = """lg AS (SELECT c_nationkey AS dyad, o_orderstatus AS condition, quarter(o_orderdate) AS freq, year(o_orderdate) * 100 + month(o_orderdate) AS trial, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS "window",
    round(log10(avg(o_totalprice)), 6) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4, 5)"""


@query("WITH " + LONG + " SELECT * FROM lg")
def long_table(spark: SparkSession, d: str) -> DataFrame:
    return tr.trials(spark, d)


_D = "CASE WHEN sd < 1e-15 THEN 0 ELSE (ma - mb) / sd END"
_POOL = "SELECT {by} count(value) FILTER (condition = 'F') AS na, count(value) FILTER (condition = 'O') AS nb, avg(value) FILTER (condition = 'F') AS ma, avg(value) FILTER (condition = 'O') AS mb, var_samp(value) FILTER (condition = 'F') AS va, var_samp(value) FILTER (condition = 'O') AS vb FROM lg {group}"


@query("WITH " + LONG + ", q AS (" + _POOL.format(by="freq,", group="GROUP BY freq") + "), s AS (SELECT *, sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS sd FROM q) SELECT freq, na AS n_a, nb AS n_b, round(" + _D + ", 6) AS d FROM s")
def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.cohens_d(tr.trials(spark, d), "condition", "F", "O", ["freq"]))


@query("WITH " + LONG + ", q AS (" + _POOL.format(by='freq, "window",', group='GROUP BY freq, "window"') + "), s AS (SELECT *, sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS sd FROM q) SELECT freq, \"window\", na AS n_a, nb AS n_b, round(" + _D + ", 6) AS d FROM s")
def cohens_d_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.cohens_d(tr.trials(spark, d), "condition", "F", "O", ["freq", "window"]))


@query("WITH " + LONG + ", m AS (SELECT freq, condition, avg(value) AS m FROM lg GROUP BY 1, 2) SELECT a.freq, round(sum(power(a.m - b.m, 2)), 9) AS stat FROM m a JOIN m b ON b.freq = a.freq AND a.condition < b.condition GROUP BY 1")
def mean_diff_stat(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.mean_difference(tr.trials(spark, d), ["freq"]), 9)


@query("WITH " + LONG + """, m AS (SELECT freq, condition, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM lg GROUP BY 1, 2)
    SELECT a.freq, a.condition AS a, b.condition AS b, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS d FROM m a JOIN m b ON b.freq = a.freq AND a.condition < b.condition""")
def effect_sizes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.effect_sizes(tr.trials(spark, d), ["freq"]))


def energy_sql(rows: str, by: str, group: str) -> str:
    """Pairs of groups in each `by` (a comma list) of `rows`: table en(by..., a, b, energy)."""
    eq = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in by.split(", "))
    return f"""sz AS (SELECT {by}, {group} AS g, count(*) AS total FROM {rows} GROUP BY ALL),
    pr AS (SELECT {", ".join("a." + c for c in by.split(", "))}, a.g AS a, b.g AS b, a.total AS ta, b.total AS tb FROM sz a JOIN sz b ON {eq("b", "a")} AND a.g < b.g),
    sp AS (SELECT {", ".join("r." + c for c in by.split(", "))}, a, b, value AS x, sum(CASE WHEN {group} = a THEN 1.0 / ta ELSE -1.0 / tb END) AS step FROM {rows} r JOIN pr ON {eq("pr", "r")} AND {group} IN (a, b) GROUP BY ALL),
    gp AS (SELECT {by}, a, b, sum(step) OVER w AS g, lead(x) OVER w - x AS dx FROM sp WINDOW w AS (PARTITION BY {by}, a, b ORDER BY x)),
    en AS (SELECT {by}, a, b, sqrt(2 * sum(coalesce(g * g * dx, 0))) AS energy FROM gp GROUP BY ALL)"""


@query("WITH " + LONG + ", " + energy_sql("lg", "freq", "condition") + " SELECT freq, a, b, round(energy, 6) AS energy FROM en")
def energy_distance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.energy_distance(tr.trials(spark, d), "condition", ["freq"]))


#: Of the queries whose SQL states as many; the others take their operators' defaults.
PERMS = 20
_UNITS = """, un AS (SELECT freq, dyad, condition, trial, dyad || '__' || condition || '__' || trial AS unit, sum(value) AS s, count(value) AS n FROM lg GROUP BY 1, 2, 3, 4),
    lab AS (SELECT DISTINCT dyad, unit, condition FROM un), pm AS (SELECT unnest(range(1, 21)) AS perm),
    slot AS (SELECT *, row_number() OVER (PARTITION BY dyad ORDER BY unit) AS r FROM lab),
    drawn AS (SELECT dyad, perm, condition, row_number() OVER (PARTITION BY dyad, perm ORDER BY md5('42|' || perm || '|' || unit), unit) AS r FROM lab, pm),
    dealt AS (SELECT perm, unit, d.condition FROM slot s JOIN drawn d ON d.dyad = s.dyad AND d.r = s.r UNION ALL SELECT 0, unit, condition FROM lab)"""


def _p(stats: str, by: str) -> str:
    on = " AND ".join(f"s.{c} = o.{c}" for c in by.split(", "))
    return f"SELECT {', '.join('s.' + c for c in by.split(', '))}, o.stat AS observed, count(*) AS n_perms, round((sum(CASE WHEN s.stat >= o.stat THEN 1 ELSE 0 END) + 1) / (count(*) + 1.0), 6) AS p FROM {stats} s JOIN {stats} o ON {on} AND o.perm = 0 AND s.perm > 0 GROUP BY ALL"


_HIER = "WITH " + LONG + _UNITS + """, mn AS (SELECT freq, perm, d.condition, sum(s) / sum(n) AS m FROM un JOIN dealt d ON d.unit = un.unit GROUP BY 1, 2, 3),
    stt AS (SELECT freq, perm, round(count(*) * sum(m * m) - sum(m) * sum(m), 9) AS stat FROM mn GROUP BY 1, 2), res AS (""" + _p("stt", "freq") + ")"  # fmt: skip


@query(_HIER + " SELECT freq, observed, n_perms, p FROM res")
def perm_test_hier(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.hierarchical_permutation_test(tr.trials(spark, d), ["freq"], PERMS), 9).withColumn("p", F.round("p", 6))


@query(_HIER + ", st AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, freq, observed, n_perms) + 1) * p) AS s FROM res), hm AS (SELECT *, max(s) OVER (ORDER BY p, freq, observed, n_perms ROWS UNBOUNDED PRECEDING) AS h FROM st) SELECT freq, observed, n_perms, p, round(h, 6) AS p_holm, h <= 0.05 AS rejected, 'all' AS family FROM hm")
def holm(spark: SparkSession, d: str) -> DataFrame:
    tests = st.hierarchical_permutation_test(tr.trials(spark, d), ["freq"], PERMS).withColumn("p", F.round("p", 6)).withColumn("family", F.lit("all"))
    return rounded(st.holm(tests, ["family"]), 9).withColumn("p_holm", F.round("p_holm", 6))


@query("WITH " + LONG + _UNITS + ", ev AS (SELECT lg.freq, lg.dyad, perm, d.condition, value FROM lg JOIN dealt d ON d.unit = lg.dyad || '__' || lg.condition || '__' || lg.trial), " + energy_sql("ev", "freq, dyad, perm", "condition") + ", dm AS (SELECT freq, dyad, perm, avg(energy) AS e FROM en GROUP BY 1, 2, 3), stt AS (SELECT freq, perm, round(avg(e), 9) AS stat FROM dm GROUP BY 1, 2) " + _p("stt", "freq").replace("o.stat AS observed", "round(o.stat, 6) AS observed"))
def energy_test_hier(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.energy_distance_hierarchical(tr.trials(spark, d), ["freq"], PERMS))


_KEY = "concat_ws('|', dyad, condition, trial, \"window\")"
_SAMPLE = f""", ky AS (SELECT freq, condition, {_KEY} AS id, value FROM lg), sm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY freq, condition ORDER BY md5('42|' || id)) AS r FROM ky) WHERE r <= 400),
    pm AS (SELECT unnest(range(1, 21)) AS perm), slot AS (SELECT freq, id, row_number() OVER (PARTITION BY freq ORDER BY id) AS r FROM sm),
    drawn AS (SELECT freq, perm, condition, row_number() OVER (PARTITION BY freq, perm ORDER BY md5('42|' || perm || '|' || id), id) AS r FROM sm, pm),
    ev AS (SELECT sm.freq, perm, d.condition, value FROM slot JOIN drawn d ON d.freq = slot.freq AND d.r = slot.r JOIN sm ON sm.freq = slot.freq AND sm.id = slot.id UNION ALL SELECT freq, 0, condition, value FROM sm)"""


@query("WITH " + LONG + _SAMPLE + ", " + energy_sql("ev", "freq, perm", "condition") + ", stt AS (SELECT freq, perm, round(avg(energy), 9) AS stat FROM en GROUP BY 1, 2) " + _p("stt", "freq").replace("o.stat AS observed", "round(o.stat, 6) AS observed"))
def perm_test_pooled(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in ("dyad", "condition", "trial", "window")))
    return rounded(st.energy_test(tr.trials(spark, d), "condition", ["freq"], key, PERMS, 400))


@query()
def pairwise_energy(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in ("dyad", "condition", "trial", "window")))
    return rounded(st.holm(st.pairwise_energy_tests(tr.trials(spark, d), "condition", ["freq"], key).withColumn("family", F.lit("pairs")), ["family"]))


@query("WITH " + LONG + """ SELECT CAST(grouping(condition) * 16 + grouping(freq) * 8 + grouping(dyad) * 4 + grouping(trial) * 2 + grouping("window") AS BIGINT) AS level, condition, freq, dyad, trial, "window", count(value) AS n, round(avg(value), 11) AS mean,
    round(quantile_cont(value, 0.25), 11) AS q25, round(quantile_cont(value, 0.5), 11) AS q50, round(quantile_cont(value, 0.75), 11) AS q75 FROM lg
    GROUP BY GROUPING SETS ((condition, freq, dyad, "window"), (condition, freq, dyad, trial), (condition, freq, "window"), (condition, freq, trial), (condition, freq))""")
def pooling_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.pooled(tr.trials(spark, d)), 11)


@query("WITH " + LONG + ", p AS (SELECT dyad, count(DISTINCT condition) AS c FROM lg GROUP BY 1) SELECT count(*) AS n_dyads, sum(CASE WHEN c = 3 THEN 1 ELSE 0 END) AS n_complete, 3 AS n_conditions, CASE WHEN count(*) >= 10 THEN 'exploratory' ELSE 'small' END AS regime, true AS can_permute, true AS can_mixed, true AS can_group_cv FROM p")
def preflight(spark: SparkSession, d: str) -> DataFrame:
    return st.preflight(tr.trials(spark, d), ["F", "O", "P"])


@query("WITH " + LONG + ", q AS (SELECT DISTINCT condition, dyad, trial FROM lg) SELECT dyad, condition, trial, row_number() OVER (PARTITION BY dyad, condition ORDER BY trial) AS turn FROM q")
def interleave_trials(spark: SparkSession, d: str) -> DataFrame:
    rows = tr.trials(spark, d).select("dyad", "condition", "trial").distinct()
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("dyad", "condition").orderBy("trial")))


@query("WITH " + LONG + ' SELECT freq, "window", round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM lg GROUP BY 1, 2')
def median_iqr(spark: SparkSession, d: str) -> DataFrame:
    p = tr.trials(spark, d).groupBy("freq", "window").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    return rounded(p.select("freq", "window", *(F.col("p")[k].alias(n) for k, n in enumerate(("q25", "q50", "q75")))))


@query()
def mixed_effects(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.run_mixed_effects(tr.trials(spark, d)))


@query()
def mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    """Trials by what each has, whichever its windows: mean, number and spread of their values. n_a and n_b count the trials."""
    has = [F.avg("value").alias("mean"), F.count("value").alias("n_windows"), F.stddev_pop("value").alias("spread")]
    each = tr.trials(spark, d).groupBy("dyad", "condition", "trial").agg(*has)
    return rounded(st.mahalanobis(each, "condition", "F", "O", ["mean", "n_windows", "spread"]))


@query()
def power_n(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.power_table(spark, [0.2, 0.5, 0.8]), 3)


@query()
def classifier_compare(spark: SparkSession, d: str) -> DataFrame:
    v = tr.vectors(spark, d).withColumn("y", (F.col("label") % 2).cast("string"))
    rows = v.select("id", "y", F.slice("vector", 1, 32).alias("first"), F.slice("vector", 33, 32).alias("second"), F.col("vector").alias("both"))
    return rounded(ml.summary(ml.classify_curvature_vs_benchmarks(rows, {"first": "first", "second": "second", "both": "both"}, cv=3, classifier="logreg")))


@query()
def report(spark: SparkSession, d: str) -> DataFrame:
    rows = tr.trials(spark, d)
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in ("dyad", "condition", "trial", "window")))
    whole = st.holm(st.energy_test(rows, "condition", ["freq"], key).withColumn("family", F.lit("o")), ["family"])
    pairs = st.holm(st.pairwise_energy_tests(rows, "condition", ["freq"], key).withColumn("family", F.lit("p")), ["family"])
    return st.report_json(rounded(whole), rounded(pairs))


# Surrogates

_UNIFORM = "CAST(('0x' || substring(md5({keys}), 1, 13)) AS BIGINT) / 4503599627370496.0"


@query("WITH " + _SIGNAL + ", sh AS (SELECT channel, 10 + CAST(floor(" + _UNIFORM.format(keys="'42|events|' || channel") + " * (SELECT n - 20 FROM n)) AS BIGINT) AS s FROM ch) SELECT 'events' AS run, sg.channel, (t + s) % (SELECT n FROM n) AS t, round(phase, 6) AS phase FROM sg JOIN sh ON sh.channel = sg.channel")
def circular_shift(spark: SparkSession, d: str) -> DataFrame:
    return rounded(su.circular_time_shift(tr.phases(spark, d), tr.hours(spark, d), 10))


@query("WITH " + _SIGNAL + ", k AS (SELECT unnest(range(3)) AS sid), sh AS (SELECT sid, channel, 10 + CAST(floor(" + _UNIFORM.format(keys="'42|' || sid || '|events|' || channel") + " * (SELECT n - 20 FROM n)) AS BIGINT) AS s FROM ch, k) SELECT sid AS surrogate_id, 'events' AS run, sg.channel, (t + s) % (SELECT n FROM n) AS t, round(phase, 6) AS phase FROM sg JOIN sh ON sh.channel = sg.channel")
def surrogate_stack(spark: SparkSession, d: str) -> DataFrame:
    return rounded(su.generate_surrogate_stack(tr.phases(spark, d), "circular_time_shift", 3, length=tr.hours(spark, d), min_shift=10))


def _dyads(spark: SparkSession, d: str) -> DataFrame:
    """A dyad for each nation: subject 0 its customers, subject 1 its suppliers; x the sorted balances."""
    c = tr.table(spark, d, "customer").select(F.col("c_nationkey").alias("dyad"), F.lit(0).alias("subject"), F.col("c_acctbal").alias("x"), F.col("c_custkey").alias("k"))
    s = tr.table(spark, d, "supplier").select(F.col("s_nationkey").alias("dyad"), F.lit(1).alias("subject"), F.col("s_acctbal").alias("x"), F.col("s_suppkey").alias("k"))
    w = Window.partitionBy("dyad", "subject").orderBy("k")
    return c.unionByName(s).select("dyad", "subject", (F.row_number().over(w) - 1).alias("t"), "x")


@query("""WITH r AS (SELECT c_nationkey AS dyad, 0 AS subject, c_acctbal AS x, c_custkey AS k FROM customer UNION ALL SELECT s_nationkey, 1, s_acctbal, s_suppkey FROM supplier),
    sg AS (SELECT dyad, subject, row_number() OVER (PARTITION BY dyad, subject ORDER BY k) - 1 AS t, x FROM r), ids AS (SELECT DISTINCT dyad FROM sg),
    cyc AS (SELECT dyad, coalesce(lead(dyad) OVER w, first_value(dyad) OVER w) AS partner FROM ids WINDOW w AS (ORDER BY md5('42|' || dyad), dyad))
    SELECT dyad, subject, t, x FROM sg WHERE subject = 0 UNION ALL SELECT cyc.dyad, subject, t, x FROM sg JOIN cyc ON cyc.partner = sg.dyad WHERE subject = 1""")
def dyad_swap(spark: SparkSession, d: str) -> DataFrame:
    return su.dyad_subject_swap(_dyads(spark, d))


@query("""WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders), b AS (SELECT c_nationkey AS dyad, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT id, dyad FROM a JOIN b USING (r)""")
def dyad_label_shuffle(spark: SparkSession, d: str) -> DataFrame:
    o = tr.table(spark, d, "orders").join(tr.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return su.dyad_label_shuffle(o.select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("dyad")))


@query("""WITH o AS (SELECT o_orderkey AS id, c_nationkey AS dyad, year(o_orderdate) * 100 + month(o_orderdate) AS trial, o_orderstatus AS condition FROM orders JOIN customer ON o_custkey = c_custkey),
    un AS (SELECT dyad, trial, arg_min(condition, id) AS condition FROM o GROUP BY 1, 2), a AS (SELECT dyad, trial, row_number() OVER (PARTITION BY dyad ORDER BY trial) AS r FROM un),
    b AS (SELECT dyad, condition, row_number() OVER (PARTITION BY dyad ORDER BY md5('42|' || dyad || '|' || trial), trial) AS r FROM un), dl AS (SELECT a.dyad, trial, condition FROM a JOIN b ON b.dyad = a.dyad AND b.r = a.r)
    SELECT o.id, o.dyad, o.trial, dl.condition FROM o JOIN dl ON dl.dyad = o.dyad AND dl.trial = o.trial""")
def condition_shuffle_blocks(spark: SparkSession, d: str) -> DataFrame:
    o = tr.table(spark, d, "orders").join(tr.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("dyad"), (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("trial"), F.col("o_orderstatus").alias("condition"))
    return su.condition_label_shuffle_within_dyad(rows)


@query("""WITH up AS (SELECT n.n_nationkey AS u, m.n_nationkey AS v, (n.n_nationkey * 7 + m.n_nationkey) * 1.0 AS weight, (n.n_regionkey + m.n_regionkey) * 1.0 AS length FROM nation n JOIN nation m ON n.n_nationkey < m.n_nationkey),
    a AS (SELECT u, v, row_number() OVER (ORDER BY u, v) AS r FROM up), b AS (SELECT weight, length, row_number() OVER (ORDER BY md5('42|' || u || '|' || v), u, v) AS r FROM up), one AS (SELECT u, v, weight, length FROM a JOIN b USING (r))
    SELECT u, v, CAST(weight AS DOUBLE) AS weight, CAST(length AS DOUBLE) AS length FROM one UNION ALL SELECT u + 25, v + 25, CAST(weight AS DOUBLE), CAST(length AS DOUBLE) FROM one""")
def shuffle_connectome(spark: SparkSession, d: str) -> DataFrame:
    n = tr.table(spark, d, "nation").select(F.col("n_nationkey").alias("u"), F.col("n_regionkey").alias("p"))
    m = n.select(F.col("u").alias("v"), F.col("p").alias("q"))
    edges = n.join(m, F.col("u") < F.col("v")).select("u", "v", (F.col("u") * 7 + F.col("v")).cast("double").alias("weight"), (F.col("p") + F.col("q")).cast("double").alias("length"))
    return su.shuffle_connectome(edges, 25)


@query()
def phase_randomize(spark: SparkSession, d: str) -> DataFrame:
    return rounded(su.phase_randomize(tr.phases(spark, d)), 4)


# Simulation

_GRID = "gd AS (SELECT printf('%03d-%03d', rep, step) AS graph_id, rep, step, power(10.0, -4 + 4 * step / 3.0) AS p FROM range(2) AS a(rep), range(4) AS b(step))"
_SW = _GRID + """, rg AS (SELECT graph_id, p, a, j, graph_id || '|' || a || '|' || j AS k FROM gd, range(60) AS x(a), range(1, 4) AS y(j)),
    mv AS (SELECT graph_id, a, CASE WHEN """ + _UNIFORM.format(keys="'42|' || k") + " < p THEN CAST(floor(" + _UNIFORM.format(keys="'43|' || k") + """ * 60) AS BIGINT) ELSE (a + j) % 60 END AS b FROM rg),
    sw AS (SELECT DISTINCT graph_id, least(a, b) AS u, greatest(a, b) AS v FROM mv WHERE a <> b), wt AS (SELECT *, 31.0 - least(v - u, 60 - (v - u)) AS weight FROM sw)"""  # fmt: skip


@query("WITH " + _SW + " SELECT graph_id, u, v, CAST(weight AS DOUBLE) AS weight FROM wt")
def sw_graph(spark: SparkSession, d: str) -> DataFrame:
    return sim.gen_weighted_sw(sim.small_world_grid(spark, 2, 4, -4, 0), 60, 6)


@query("WITH " + _SW + """, en AS (SELECT graph_id, node, sum(1 / sqrt(weight)) AS s FROM (SELECT graph_id, u AS node, weight FROM wt UNION ALL SELECT graph_id, v, weight FROM wt) GROUP BY 1, 2),
    c AS (SELECT q.graph_id, 2 - sqrt(q.weight) * (a.s + b.s - 2 / sqrt(q.weight)) AS k FROM wt q JOIN en a ON a.graph_id = q.graph_id AND a.node = q.u JOIN en b ON b.graph_id = q.graph_id AND b.node = q.v)
    SELECT graph_id, round(quantile_cont(k, 0.05), 6) AS q05, round(quantile_cont(k, 0.5), 6) AS q50, round(quantile_cont(k, 0.95), 6) AS q95 FROM c GROUP BY 1""")
def sw_sweep(spark: SparkSession, d: str) -> DataFrame:
    _, q = sim.run_ws_sweep(spark, 60, 6, 1.0, 4, -4, 0, 2, 42)
    wide = q.groupBy("graph_id").pivot("q", [0.05, 0.5, 0.95]).agg(F.first("value"))
    return rounded(wide.toDF("graph_id", "q05", "q50", "q95"))


@query()
def sw_sweep_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sim.run_ws_sweep(spark, 60, 6, 1.0, 4, -4, 0, 2, 42)[0])


@query()
def kuramoto(spark: SparkSession, d: str) -> DataFrame:
    runs = spark.createDataFrame([("a", 2.0, 1), ("b", 0.1, 2)], "run string, coupling double, seed long")
    return rounded(gr.get_avg_plv(gr.sliding_window_plv(sim.simulate_kuramoto(runs, 20, 0.01, 600), 200, 50, 600)), 4)


@query()
def delayed_kuramoto(spark: SparkSession, d: str) -> DataFrame:
    runs = spark.createDataFrame([("a", 5.0, 1)], "run string, coupling double, seed long")
    cells = [(i, j, 1.0, 0.01 * (abs(i - j))) for i in range(8) for j in range(8) if i != j]
    net = spark.createDataFrame(cells, "u int, v int, weight double, length double")
    return rounded(sim.order_parameter(sim.simulate_delayed_kuramoto(runs, net, 8, t_max=0.5, t_skip=0.1)), 4)
