"""Known answers on toy graphs, and numpy checks of what SQL can't state."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelake.operators import curvature as cv
from curvelake.operators import distribution as ds
from curvelake.operators import graph as gr
from curvelake.operators import metrics as mt
from curvelake.operators import spectral as sp

GRAPHS = {
    "K5": list(itertools.combinations(range(5), 2)),
    "C10": [(i, (i + 1) % 10) for i in range(10)],
    "S6": [(0, i) for i in range(1, 6)],
    "toy4": [(0, 1), (0, 2), (1, 2), (2, 3)],
}
KIND = "graph_id string, u int, v int, weight double"


@pytest.fixture(scope="module")
def toys(spark):
    return gr.canonical(spark.createDataFrame([(g, u, v, 1.0) for g, e in GRAPHS.items() for u, v in e], KIND)).cache()


@pytest.fixture(scope="module")
def weighted(spark):
    rng = np.random.default_rng(3)
    pairs = [p for p in itertools.combinations(range(12), 2) if rng.random() < 0.45]
    return spark.createDataFrame([("r", u, v, float(rng.uniform(0.2, 3))) for u, v in pairs], KIND).cache()


def values(df, column="curvature"):
    out = {}
    for r in df.collect():
        out.setdefault(r.graph_id, []).append(round(r[column], 6))
    return out


def test_forman_known_answers(toys):
    got = values(cv.compute_frc(toys))
    assert got["K5"] == [-4] * 10 and got["C10"] == [0] * 10 and got["S6"] == [-2] * 5 and set(got["toy4"]) == {-1, 0}


def test_augmented_adds_three_for_each_triangle(toys):
    got = values(cv.compute_afrc(toys))
    assert got["K5"] == [5] * 10 and got["C10"] == [0] * 10 and got["S6"] == [-2] * 5 and set(got["toy4"]) == {0, 2, 3}
    assert values(cv.compute_frc(toys, "augmented")) == got
    with pytest.raises(ValueError, match="method"):
        cv.compute_frc(toys, "other")


def test_weighted_forman_against_loops(weighted):
    e = {(r.u, r.v): r.weight for r in weighted.collect()}
    at = lambda x: [p for p in e if x in p]
    frc = {(r.u, r.v): r.curvature for r in cv.compute_frc(weighted).collect()}
    afrc = {(r.u, r.v): r.curvature for r in cv.compute_afrc(weighted).collect()}
    for (u, v), w in e.items():
        other = [p for x in (u, v) for p in at(x) if p != (u, v)]
        assert frc[u, v] == pytest.approx(w * (2 / w - sum(1 / np.sqrt(w * e[p]) for p in other)))
        third = [z for z in range(12) if tuple(sorted((u, z))) in e and tuple(sorted((v, z))) in e]
        faced = {tuple(sorted((x, z))) for z in third for x in (u, v)}
        assert afrc[u, v] == pytest.approx(w * (len(third) * w + 2 / w - abs(sum(1 / np.sqrt(w * e[p]) for p in other if p not in faced))))


def test_ollivier_bounds_and_known_answers(toys):
    got = values(cv.compute_orc(toys, alpha=0.0))
    assert got["K5"] == pytest.approx([0.75] * 10) and got["C10"] == pytest.approx([0.0] * 10)
    assert values(cv.compute_orc(toys, alpha=0.5))["K5"] == pytest.approx([0.625] * 10)


def test_transport_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        cost = rng.random((4, 4))
        best = min(sum(cost[i, p[i]] for i in range(4)) for p in itertools.permutations(range(4))) / 4
        assert cv.transport(np.full(4, 0.25), np.full(4, 0.25), cost) == pytest.approx(best)
        assert cv.sinkhorn(np.full(4, 0.25), np.full(4, 0.25), cost, 0.01, 2000) == pytest.approx(best, abs=0.03)


def test_flows_keep_total_weight(weighted):
    n = weighted.count()
    for flow in (cv.forman_ricci_flow(weighted, 3, step=0.01), cv.ricci_flow(weighted, 3)):
        assert flow.agg(F.sum("weight")).first()[0] == pytest.approx(n)


def test_prune_loops_isolates(spark):
    e = spark.createDataFrame([("p", 0, 1, 0.1), ("p", 1, 2, 0.6), ("p", 2, 3, 0.5), ("p", 2, 2, 0.9), ("p", 3, 4, None)], KIND)
    nodes = spark.createDataFrame([("p", i) for i in range(6)], "graph_id string, node int")
    assert {(r.u, r.v) for r in gr.prune_graph_by_weight(e, 0.5).collect()} == {(1, 2), (2, 3), (2, 2)}
    assert gr.remove_self_loops(e).count() == 4 and e.count() == 5
    assert {r.node for r in gr.pruned_nodes(e, nodes, 0.5).collect()} == {1, 2, 3} and gr.pruned_nodes(e, nodes, 0.5, True).count() == 6
    assert {r.node for r in mt.isolates(e, nodes).collect()} == {5}


def test_metrics_of_complete_and_empty(spark, toys):
    k5 = toys.where("graph_id = 'K5'")
    nodes = spark.createDataFrame([("K5", i) for i in range(5)] + [("none", i) for i in range(5)], "graph_id string, node int")
    s = {r.graph_id: r for r in mt.summarize_network(k5, nodes).collect()}
    assert s["K5"].is_complete and s["K5"].n_triangles == 10 and s["K5"].avg_clustering == 1 and s["K5"].is_connected
    assert s["none"].n_edges == 0 and s["none"].n_isolates == 5 and s["none"].density == 0 and s["none"].n_components == 5
    eff = {r.graph_id: r.global_efficiency for r in mt.compute_global_efficiency(k5, nodes).collect()}
    assert eff == {"K5": 1.0, "none": 0.0}
    assert mt.compute_assortativity(k5).first().assortativity == 0


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([("a", i, i + 1, 1.0) for i in range(60)] + [("b", 5, 9, 1.0), ("b", 7, 8, 1.0)], KIND)
    got = {(r.graph_id, r.node): r.component for r in mt.connected_components(e).collect()}
    assert {got["a", i] for i in range(61)} == {0} and got["b", 9] == 5 and got["b", 8] == 7


def test_betweenness_and_communities(spark):
    path = spark.createDataFrame([("p", i, i + 1, 1.0) for i in range(4)], KIND)
    got = {r.node: r.betweenness for r in mt.find_centrality(path).collect()}
    assert got[2] == pytest.approx(4 / 6) and got[0] == 0
    two = [(a + o, b + o) for o in (0, 5) for a, b in itertools.combinations(range(5), 2)] + [(4, 5)]
    g = spark.createDataFrame([("g", u, v, 1.0) for u, v in two], KIND)
    for method in ("greedy", "louvain"):
        by = {r.node: r.community for r in mt.communities(g, method).collect()}
        assert len({by[i] for i in range(5)}) == 1 and len({by[i] for i in range(5, 10)}) == 1 and by[0] != by[9]
    assert mt.compute_modularity(g).first().modularity == pytest.approx(20 / 21 - 2 * (21 / 42) ** 2)


def test_laplacian_spectrum(toys):
    got = {r.graph_id: r.lambda2 for r in sp.eigen_in_time(toys).collect()}
    assert got["K5"] == pytest.approx(5) and got["C10"] == pytest.approx(0.381966, abs=1e-6) and got["S6"] == pytest.approx(1) and got["toy4"] == pytest.approx(1)


def test_heat_distance_against_matrices():
    rng = np.random.default_rng(1)

    def one():
        a = np.triu(rng.random((6, 6)), 1)
        a += a.T
        return np.diag(a.sum(1)) - a

    x, y, times = one(), one(), sp.log_times()

    def heat(m, t):
        w, q = np.linalg.eigh(m)
        return q @ np.diag(np.exp(-t * w)) @ q.T

    assert sp.heat_distance(x, y, times) == pytest.approx(max(np.linalg.norm(heat(x, t) - heat(y, t)) for t in times))
    assert sp.heat_distance(x, x, times) == pytest.approx(0, abs=1e-6)


def test_gdd_is_symmetric(spark):
    rng = np.random.default_rng(6)
    e = spark.createDataFrame([(f"g{k}", u, v, float(rng.random())) for k in range(3) for u, v in itertools.combinations(range(5), 2)], KIND)
    d = {(r.graph_id, r.other): r.distance for r in sp.compute_pairwise_gdd(e, 5).collect()}
    step = {(r.graph_id, r.next): r.distance for r in sp.compute_successive_gdd(e, 5).collect()}
    assert all(d[a, b] == d[b, a] for a, b in d) and d["g0", "g0"] == 0 and step["g0", "g1"] == pytest.approx(d["g0", "g1"]) and len(step) == 2


@pytest.fixture(scope="module")
def normals(spark):
    x = np.random.default_rng(42).standard_normal(1000)
    return spark.createDataFrame([("n", 0, 0, float(v)) for v in x], "graph_id string, u int, v int, curvature double").cache()


@pytest.mark.parametrize(("name", "value"), [("vasicek", 1.403619), ("ebrahimi", 1.423953), ("correa", 1.424757), ("van_es", 1.326320), ("kozachenko", 1.446500)])
def test_entropies_of_normals(normals, name, value):
    assert ds.vec_entropy(normals, name).first().entropy == pytest.approx(value, abs=1e-5)


def test_kde_entropy_and_quantiles(normals, spark):
    for bw in ("ISJ", "scott", "silverman", 0.3):
        assert ds.entropy_kde_plugin(normals, bw).first().entropy == pytest.approx(1.4189, abs=0.3)
    assert ds.entropy_kde_scott(normals).first().entropy == pytest.approx(ds.entropy_kde_plugin(normals, "scott").first().entropy)
    assert abs(ds.get_quantiles(normals, (0.5,)).first().value) < 0.15
    same = spark.createDataFrame([("c", 0, i, 1.0) for i in range(9)], "graph_id string, u int, v int, curvature double")
    assert ds.entropy_kde_plugin(same).first().entropy == 0 and ds.compute_entropy(same, "kde").first().entropy == 0
    assert ds.vec_entropy(same, "vasicek").first().entropy == float("-inf")
    with pytest.raises(ValueError, match="unknown"):
        ds.vec_entropy(same, "other")


def test_renyi_of_a_uniform_sample(spark):
    x = np.random.default_rng(0).random(2000)
    u = spark.createDataFrame([("u", 0, 0, float(v)) for v in x], "graph_id string, u int, v int, curvature double")
    assert ds.vec_entropy(u, "renyi").first().entropy == pytest.approx(0, abs=0.1) and ds.vec_entropy(u, "tsallis").first().entropy == pytest.approx(0, abs=0.1)


def test_transform_is_positive_and_guards(spark, toys):
    c = cv.compute_frc(toys)
    moved = cv.transform_curvature_collection(c, cv.fit_global_positive_linear_transform(c, rescale=(0.5, 2.0)))
    assert cv.check_all_positive(moved).where("not all_positive").count() == 0
    assert moved.agg(F.min("positive_weight"), F.max("positive_weight")).first() == (0.5, 2.0)
    with pytest.raises(ValueError, match="rescale"):
        cv.fit_global_positive_linear_transform(c, rescale=(2.0, 1.0))
    with pytest.raises(Exception, match="empty or not finite"):
        cv.fit_global_positive_linear_transform(c.where("false")).collect()


def test_spectral_normalise_and_deletion(weighted):
    assert sp.edge_deletion(weighted, 1, 0).count() == weighted.where("not (u = 0 and v = 1)").count()
    w = sp.spectral_normalise(weighted).toPandas()
    a = np.zeros((12, 12))
    a[w.u, w.v] = a[w.v, w.u] = w.weight
    assert np.abs(np.linalg.eigvalsh(a)).max() == pytest.approx(1)
    assert sp.edge_deletion_perturbation(weighted, 12).where("chi <= 0").count() == 0


def test_graph_queries_take_every_edge(spark, tmp_path):
    """Trade of eight nations, one item a pair: 28 edges of weight 1, whose values are known."""
    from curvelake.plans.registry import QUERIES

    pairs = list(itertools.combinations(range(8), 2))
    tables = {
        "nation": ("n_nationkey int, n_regionkey int", [(i, i % 2) for i in range(8)]),
        "customer": ("c_custkey int, c_nationkey int", [(i, i) for i in range(8)]),
        "supplier": ("s_suppkey int, s_nationkey int", [(i, i) for i in range(8)]),
        "orders": ("o_orderkey int, o_custkey int", [(k, u) for k, (u, _) in enumerate(pairs)]),
        "lineitem": ("l_orderkey int, l_suppkey int, l_shipdate string", [(k, v, "1995-02-03") for k, (_, v) in enumerate(pairs)]),
    }
    for name, (kind, rows) in tables.items():
        df = spark.createDataFrame(rows, kind)
        (df.withColumn("l_shipdate", F.to_date("l_shipdate")) if name == "lineitem" else df).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {n: QUERIES[n](spark, str(tmp_path)).toPandas() for n in ("network_summary", "betweenness", "edp", "orc", "orc_flow", "ricci_flow_metric", "forman_flow", "orc_parameter_grid")}
    assert got["network_summary"].n_edges.tolist() == [28] and got["network_summary"].is_complete.all()
    assert len(got["betweenness"]) == 8 and (got["betweenness"].betweenness == 0).all() and (got["betweenness"].degree_centrality == 1).all()
    assert len(got["edp"]) == 28 and got["edp"].chi.nunique() == 1
    assert len(got["orc"]) == 28 and got["orc"].curvature.tolist() == pytest.approx([4 / 7] * 28, abs=1e-6)
    assert len(got["orc_flow"]) == 28 and (got["orc_flow"].weight == 1).all() and got["orc_flow"].curvature.tolist() == pytest.approx([4 / 7] * 28, abs=1e-4)
    m = got["ricci_flow_metric"]
    assert len(m) == 64 and (m.distance == (m.i != m.j)).all()
    assert len(got["forman_flow"]) == 28 and (got["forman_flow"].original_frc == 2 - 12).all()
    assert len(got["orc_parameter_grid"]) == 4
