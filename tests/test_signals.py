"""Signals, statistics, surrogates, simulations, sources and the streaming form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelake.functions import special
from curvelake.operators import graph as gr
from curvelake.operators import ml
from curvelake.operators import phase as ph
from curvelake.operators import simulation as sim
from curvelake.operators import stats as st
from curvelake.operators import surrogates as su
from curvelake.sources import graphs as src
from curvelake.streaming import plv as stream

SIGNAL = "run string, channel int, t long, phase double, x double"


def signal(spark, phases):
    c, n = phases.shape
    return spark.createDataFrame([("r", i, t, float(phases[i, t]), float(np.cos(phases[i, t]))) for i in range(c) for t in range(n)], SIGNAL)


def test_plv_of_locked_lagged_and_independent(spark):
    rng = np.random.default_rng(0)
    a = rng.uniform(-np.pi, np.pi, 4096)
    got = {(r.u, r.v): r.plv for r in ph.compute_plv(signal(spark, np.stack([a, a + 0.7, rng.uniform(-np.pi, np.pi, 4096)]))).collect()}
    assert got[0, 1] == pytest.approx(1) and got[0, 2] < 0.1


def test_wpli(spark):
    rng = np.random.default_rng(0)
    a = rng.uniform(-np.pi, np.pi, 2048)
    got = {(r.u, r.v): r.wpli for r in ph.compute_wpli(signal(spark, np.stack([a, a - np.pi / 2, a]))).collect()}
    assert got[0, 1] > 0.8 and got[0, 2] == 0


@pytest.mark.parametrize(("size", "stride"), [(200, 100), (200, 75)])
def test_window_counts_and_values(spark, size, stride):
    phases = np.random.default_rng(1).uniform(-np.pi, np.pi, (3, 1000))
    got = gr.sliding_window_plv(signal(spark, phases), size, stride).toPandas()
    assert got.window.nunique() == (1000 - size) // stride + 1
    for r in got.itertuples():
        d = phases[r.u, r.window * stride :][:size] - phases[r.v, r.window * stride :][:size]
        assert r.weight == pytest.approx(abs(np.exp(1j * d).mean()))


def test_circular_correlation(spark):
    rng = np.random.default_rng(2)
    a = rng.uniform(-np.pi, np.pi, 2000)
    got = {(r.u, r.v): r.ccorr for r in ph.circular_correlation(signal(spark, np.stack([a, a, rng.uniform(-np.pi, np.pi, 2000)]))).collect()}
    assert got[0, 1] == pytest.approx(1) and got[0, 2] < 0.06


def test_hilbert_and_coherence(spark):
    t = np.arange(512)
    s = signal(spark, np.stack([0.3 * t, 0.3 * t + 1.0]))
    h = ph.hilbert_phase(s).where("channel = 0 and t = 200").first().phase
    assert np.cos(h) == pytest.approx(np.cos(0.3 * 200), abs=0.1)
    c = ph.compute_imaginary_coherence(s, 200.0).toPandas()
    assert c.frequency.min() == 0 and (c.coherence >= 0).all() and len(c) == 129


def test_cohens_d_and_guards(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(x)) for x in rng.normal(1, 1, 500)] + [("b", float(x)) for x in rng.normal(0, 1, 500)] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "grp string, value double")
    assert 0.8 < st.cohens_d(df, "grp", "a", "b").first().d < 1.2 and st.cohens_d(df, "grp", "a", "c").first().d == 0
    with pytest.raises(Exception, match="differ in size"):
        st.cohens_d_paired(spark.createDataFrame([(1.0, None)], "a double, b double")).collect()


def test_energy_distance_against_pairs(spark):
    a, b = np.random.default_rng(0).normal(0, 1, 60), np.random.default_rng(1).normal(1, 1, 45)
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, value double")
    assert st.energy_distance(df, "g").first().energy == pytest.approx(0.6957249112882751)


def long(spark, effect):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(d, c, 0, t, w, float(rng.normal(effect * k, 1))) for d in range(3) for k, c in enumerate("xy") for t in range(8) for w in range(3)], "dyad int, condition string, freq int, trial int, window int, value double")


def test_permutation_tests(spark):
    assert st.hierarchical_permutation_test(long(spark, 3.0), ["freq"], 99).first().p < 0.05
    assert st.hierarchical_permutation_test(long(spark, 0.0), ["freq"], 99).first().p > 0.05
    with pytest.raises(ValueError, match="tail"):
        st.hierarchical_permutation_test(long(spark, 0.0), tail="left")
    assert st.energy_distance_hierarchical(long(spark, 3.0), ["freq"], 19).first().p == pytest.approx(0.05)


def test_shuffles_keep_labels(spark):
    units = spark.createDataFrame([(i, i % 4, "xyz"[i % 3]) for i in range(40)], "unit int, dyad int, condition string")
    got = st.shuffled_labels(units, ["unit"], ["dyad"], "condition", 5).toPandas()
    want = units.toPandas().groupby("dyad").condition.apply(sorted)
    for _, part in got.groupby("perm"):
        assert part.groupby("dyad").condition.apply(sorted).equals(want)
    assert got.pivot(index="unit", columns="perm", values="condition").nunique(axis=1).max() > 1


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "family string, name string, p double")
    got = {r.name: round(r.p_holm, 9) for r in st.holm(df, ["family"]).collect()}
    assert got == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_power():
    assert 60 < st.required_sample_size(0.5) < 70 and st.required_sample_size(0.0) == float("inf")
    assert special.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-5) and special.t_quantile(0.975, 10) == pytest.approx(2.228, abs=2e-3)
    assert special.digamma(10) == pytest.approx(2.251752589)


def test_mixed_model_and_mahalanobis(spark):
    got = st.run_mixed_effects(long(spark, 2.0)).toPandas().set_index("term")
    assert got.estimate["y"] == pytest.approx(2, abs=0.5) and got.fitted.all()
    assert not st.run_mixed_effects(long(spark, 2.0).where("dyad = 0")).first().fitted
    rows = spark.createDataFrame([("a", 0.0, 0.1), ("a", 1.0, 0.9), ("a", 0.4, 0.2), ("b", 3.0, 0.0), ("b", 4.1, 1.1), ("b", 3.3, 0.4)], "g string, x double, y double")
    assert st.mahalanobis(rows, "g", "a", "b", ["x", "y"]).first().distance > 2


def test_preflight_and_regimes(spark):
    got = st.preflight(long(spark, 0.0), ["x", "y"]).first()
    assert (got.n_dyads, got.n_complete, got.regime, got.can_permute) == (3, 3, "proof_of_concept", True)
    assert [r[0] for r in spark.range(11).where("id in (0, 1, 4, 9, 10)").select(st.regime(F.col("id"))).collect()] == ["empty", "single", "proof_of_concept", "small", "exploratory"]


def test_surrogates(spark):
    rng = np.random.default_rng(3)
    s = signal(spark, rng.uniform(-3, 3, (4, 64)))
    moved = su.circular_time_shift(s, 64, 2).toPandas()
    for c, part in moved.groupby("channel"):
        assert sorted(part.phase) == sorted(s.where(F.col("channel") == c).toPandas().phase)
    with pytest.raises(ValueError, match="longer"):
        su.circular_time_shift(s, 4, 2)
    random = su.phase_randomize(s).toPandas()
    for c, part in random.groupby("channel"):
        x = s.where(F.col("channel") == c).orderBy("t").toPandas().x
        assert np.abs(np.fft.rfft(part.sort_values("t").x)) == pytest.approx(np.abs(np.fft.rfft(x)), rel=1e-6)
    with pytest.raises(ValueError, match="unknown"):
        su.generate_surrogate_stack(s, "other")
    assert su.generate_surrogate_stack(s, "phase_randomize", 2).select("surrogate_id").distinct().count() == 2


def test_derangement_and_swap(spark):
    ids = spark.range(7).withColumnRenamed("id", "dyad")
    got = su.derangement(ids, "dyad").collect()
    assert all(r.dyad != r.partner for r in got) and {r.partner for r in got} == set(range(7))
    dyads = spark.createDataFrame([(d, s, 100 * d + s) for d in range(6) for s in (0, 1)], "dyad int, subject int, x int")
    rows = su.dyad_subject_swap(dyads).collect()
    assert all(r.x == 100 * r.dyad for r in rows if r.subject == 0) and all(r.x != 100 * r.dyad + 1 for r in rows if r.subject == 1) and len(rows) == 12


def test_block_shuffle_keeps_trials_whole(spark):
    rows = spark.createDataFrame([(10 * d + 2 * t + k, d, t, "xy"[t % 2]) for d in range(3) for t in range(4) for k in range(2)], "id int, dyad int, trial int, condition string")
    got = su.condition_label_shuffle_within_dyad(rows).toPandas()
    assert got.groupby(["dyad", "trial"]).condition.nunique().eq(1).all() and got.condition.value_counts().to_dict() == {"x": 12, "y": 12}
    assert su.condition_label_shuffle_within_dyad(rows, blocks=False).count() == 24


def test_small_world_ends(spark):
    ring = sim.watts_strogatz(spark.createDataFrame([("a", 0.0)], "graph_id string, p double"), 20, 4)
    assert ring.count() == 40 and gr.both_ways(ring).groupBy("node").count().where("count <> 4").isEmpty()
    assert sim.gen_weighted_sw(spark.createDataFrame([("a", 1.0)], "graph_id string, p double"), 20, 4).where("weight <= 0").isEmpty()
    with pytest.raises(ValueError, match="epsilon"):
        sim.gen_weighted_sw(spark.createDataFrame([("a", 1.0)], "graph_id string, p double"), 20, 4, 0.5)


def test_kuramoto_locks_with_coupling(spark):
    runs = spark.createDataFrame([("strong", 8.0, 1), ("none", 0.0, 1)], "run string, coupling double, seed long")
    r = {x.run: x.r for x in sim.order_parameter(sim.simulate_kuramoto(runs, 20, 0.02, 400)).where("t = 400").collect()}
    assert r["strong"] > 0.9 > r["none"]
    theta = sim.delayed_kuramoto(np.ones((4, 4)) - np.eye(4), np.zeros((4, 4)), np.zeros(4), 5.0, 0.01, 2.0, 0.0)
    assert abs(np.exp(1j * theta[-1]).mean()) > 0.99


def test_distances_and_neighbours(spark):
    x = np.random.default_rng(4).random((30, 6))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    d = {(r.i, r.j): r.d for r in gr.adj_matrix(v, 5000).collect()}
    assert len(d) == 435 and all(abs(np.linalg.norm(x[i] - x[j]) - y) < 6e-4 for (i, j), y in d.items())
    k = gr.nearest_neighbor_graph(gr.adj_matrix(v, 30), 3)
    assert k.where("u >= v").isEmpty() and k.count() >= 45
    with pytest.raises(ValueError, match="method"):
        gr.adj_matrix(v, 30, 4)


def test_sources(spark, tmp_path):
    np.save(tmp_path / "a_matrix.npy", np.arange(8.0).reshape(2, 2, 2))
    np.savez(tmp_path / "b.npz", phases=np.ones((2, 3)))
    cells = src.array_cells(src.read_arrays(spark, f"file://{tmp_path}/a_matrix.npy"))
    assert {r.graph_id for r in cells.collect()} == {"a_matrix.npy/000000", "a_matrix.npy/000001"} and cells.where("i = 1 and j = 0").agg(F.sum("value")).first()[0] == 8
    assert src.array_signal(src.read_arrays(spark, f"file://{tmp_path}/b.npz")).count() == 6
    edges = spark.createDataFrame([("g1", 0, 1, 2.0), ("g2", 1, 2, None)], "graph_id string, u int, v int, weight double")
    src.write_edges(edges, f"{tmp_path}/edges")
    assert src.load_graph_series(spark, f"{tmp_path}/edges").count() == 2
    edges.where("false").coalesce(1).write.parquet(f"{tmp_path}/none")
    with pytest.raises(ValueError, match="no graph"):
        src.load_graph_series(spark, f"{tmp_path}/none")
    names = spark.createDataFrame([("01_x.pkl",), ("03_x.pkl",)], "name string")
    assert [r.id for r in src.missing_ids(spark, [1, 2, 3], names, 2).collect()] == ["02"]
    with pytest.raises(FileNotFoundError, match="02"):
        src.require_ids(spark, [1, 2, 3], names, 2)
    assert [r.run_id for r in src.parse_run_ids(spark.createDataFrame([("1",), ("avg",), ("08",)], "run string")).orderBy("run_id").collect()] == [1, 8]
    (tmp_path / "c.toml").write_text("[a]\nb = 1\n")
    assert src.load_config(str(tmp_path / "c.toml")) == {"a": {"b": 1}}


def test_save_json_never_cuts(spark, tmp_path):
    src.save_json(spark.range(10_000), f"{tmp_path}/whole.json")
    assert (tmp_path / "whole.json").read_text().count("{") == 10_000
    with pytest.raises(ValueError, match="at most"):
        src.save_json(spark.range(10_001), f"{tmp_path}/cut.json")
    assert not (tmp_path / "cut.json").exists()


def test_classifiers_run(spark):
    rng = np.random.default_rng(0)
    rows = [(i, str(i % 2), i % 4, (rng.normal(2 * (i % 2), 1, 4)).tolist(), rng.normal(0, 1, 4).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, y string, g int, good array<double>, noise array<double>")
    got = {r.features: r.mean for r in ml.summary(ml.classify_curvature_vs_benchmarks(df, {"good": "good", "noise": "noise"}, cv=2, classifier="logreg")).collect()}
    assert got["good"] > 0.9 > got["noise"]
    assert ml.with_folds(df, "y", "id", "g", 2).groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()


def test_streaming_plv_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, [(c, float(p)) for c, p in enumerate(rng.uniform(-3, 3, 3))]) for i in range(40)]
    kind = "s int, phases array<struct<channel: int, phase: double>>"
    at = spark.createDataFrame(rows, kind).select(F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "phases")
    at.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(at.schema).parquet(f"{tmp_path}/in")
    q = stream.windowed_plv(live, "10 seconds", "5 seconds", complete=10).writeStream.outputMode("complete").format("memory").queryName("plv_stream").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.start, r.u, r.v): round(r.plv, 9) for r in stream.windowed_plv(at, complete=10).collect()}
    assert want and {(r.start, r.u, r.v): round(r.plv, 9) for r in spark.table("plv_stream").collect()} == want


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """25 dyads, conditions F (dear) and O, four trials of one quarter: all windows, or those of an uneven table. One order each."""
    rng = np.random.default_rng(7)
    out = {}
    for name, keep in (("whole", 1.0), ("sparse", 0.3)):
        rows = [(d, c, 1992 + t, w, float(np.round(10 ** (rng.normal(4 + (c == "F"), 0.4)), 2))) for d in range(25) for c in "FO" for t in range(4) for w in range(1, 6) if rng.random() <= keep]
        folder = out[name] = str(tmp_path_factory.mktemp(name))
        at = spark.createDataFrame([(d, c, f"{y}-02-03", f"{w}-X", x) for d, c, y, w, x in rows], "o_custkey int, o_orderstatus string, o_orderdate string, o_orderpriority string, o_totalprice double")
        at.withColumn("o_orderdate", F.to_date("o_orderdate")).coalesce(1).write.parquet(f"{folder}/orders.parquet")
        spark.createDataFrame([(d, d) for d in range(25)], "c_custkey int, c_nationkey int").coalesce(1).write.parquet(f"{folder}/customer.parquet")
        out[f"{name} rows"] = [(d, c, y, w, round(float(np.log10(x)), 6)) for d, c, y, w, x in rows]
    return out


def test_mahalanobis_takes_every_trial(spark, orders):
    from curvelake.plans.registry import QUERIES

    trials = {}
    for d, c, y, _, x in orders["sparse rows"]:
        trials.setdefault((c, d, y), []).append(x)
    x = {g: np.array([(np.mean(v), len(v), np.std(v)) for k, v in trials.items() if k[0] == g]) for g in "FO"}
    cov = sum((len(v) - 1) * np.cov(v.T) for v in x.values()) / (len(x["F"]) + len(x["O"]) - 2)
    apart = x["F"].mean(0) - x["O"].mean(0)
    got = QUERIES["mahalanobis"](spark, orders["sparse"]).first()
    assert (got.n_a, got.n_b) == (len(x["F"]), len(x["O"])) and got.distance == pytest.approx(np.sqrt(apart @ np.linalg.inv(cov) @ apart), abs=1e-5)


def test_energy_queries_take_every_row(spark, orders):
    import json

    from curvelake.plans.registry import QUERIES

    f, o = (np.array([r[4] for r in orders["whole rows"] if r[1] == g]) for g in "FO")
    assert len(f) == len(o) == 500
    far = lambda a, b: np.abs(a[:, None] - b[None, :]).mean()
    want = pytest.approx(np.sqrt(2 * far(f, o) - far(f, f) - far(o, o)), abs=2e-6)
    pairs = QUERIES["pairwise_energy"](spark, orders["whole"]).collect()
    assert [(r.freq, r.pair) for r in pairs] == [(1, "F-O")] and pairs[0].observed == want
    assert pairs[0].n_perms == 1000 and pairs[0].p == pytest.approx(1 / 1001, abs=1e-6) and pairs[0].rejected
    told = json.loads(QUERIES["report"](spark, orders["whole"]).first().report)
    assert told["omnibus"]["1"]["observed"] == want and json.loads(told["pairwise"]["1"])["F-O"]["observed"] == want
    assert told["omnibus"]["1"]["rejected"] and json.loads(told["pairwise"]["1"])["F-O"]["rejected"]


def test_permutation_queries_can_reject(spark, orders):
    from curvelake.plans.registry import QUERIES

    r = QUERIES["hierarchical_summary"](spark, orders["whole"]).first()
    assert r.p_mean == pytest.approx(1 / 2001, abs=1e-6) and r.p_energy == pytest.approx(1 / 2001, abs=1e-6) and r.rejected and r.p_null > 0


def joins(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(" Join " in f" {line.lstrip(' :+-')} " for line in plan.splitlines())


def plain_energy(values, labels):
    """Mean over pairs of groups, by all pairs of values."""
    groups = [np.array([x for x, c in zip(values, labels) if c == g]) for g in sorted(set(labels))]
    far = lambda a, b: np.abs(a[:, None] - b[None, :]).mean()
    found = [np.sqrt(max(0.0, 2 * far(a, b) - far(a, a) - far(b, b))) for i, a in enumerate(groups) for b in groups[i + 1 :]]
    return np.mean(found) if found else None


def dealt_labels(units, perm):
    """The labels of ascending units (unit, label) in one permutation."""
    from hashlib import md5

    drawn = sorted(units, key=lambda u: (md5(f"42|{perm}|{u[0]}".encode()).hexdigest(), u[0])) if perm else units
    return [c for _, c in drawn]


def test_energy_test_against_plain_shuffles(spark):
    rng = np.random.default_rng(5)
    rows = [(f, "abc"[k % 3], f"{f}.{k:03d}", float(rng.integers(0, 9) + (k % 3) / 2)) for f in (0, 1) for k in range(40)] + [(2, "a", "2.000", 1.0)]
    df = spark.createDataFrame(rows, "freq int, g string, id string, value double")
    test = st.energy_test(df, "g", ["freq"], F.col("id"), 120)
    assert joins(test) == 0  # rows aren't joined for each permutation
    got = {r.freq: (r.observed, r.n_perms, r.p) for r in test.collect()}
    assert set(got) == {0, 1}  # one group alone has no distance
    for f in got:
        mine = sorted((i, g, x) for q, g, i, x in rows if q == f)
        stat = [round(plain_energy([x for _, _, x in mine], dealt_labels([(i, g) for i, g, _ in mine], p)), 8) for p in range(121)]
        assert got[f][0] == pytest.approx(stat[0], abs=1e-7) and got[f][1:] == (120, pytest.approx((1 + sum(s >= stat[0] for s in stat[1:])) / 121))


def test_energy_test_counts_missing_values(spark):
    """A missing value counts for its group, below all others."""
    df = spark.createDataFrame([(0, "a", "1", None), (0, "a", "2", 1.0), (0, "b", "3", 1.0), (0, "b", "4", 3.0)], "freq int, g string, id string, value double")
    assert st.energy_test(df, "g", ["freq"], F.col("id"), 3).first().observed == pytest.approx(1.0)
    assert st.energy_distance(df, "g", ["freq"]).first().energy == pytest.approx(1.0)


def test_hierarchical_tests_against_plain_shuffles(spark):
    rng = np.random.default_rng(6)
    rows = [(d, c, f, t, w, float(rng.integers(0, 20))) for d in (3, 11) for c in "xyz" for t in range(5) for f in (0, 1) for w in range(2) if (d, c, t) != (3, "z", 4)]
    df = spark.createDataFrame(rows, "dyad int, condition string, freq int, trial int, window int, value double")
    mean, energy = st.hierarchical_permutation_test(df, ["freq"], 70), st.energy_distance_hierarchical(df, ["freq"], 70)
    assert joins(mean) == 0 and joins(energy) == 0
    stats = {}
    for p in range(71):
        label = {}
        for d in (3, 11):
            units = sorted({(f"{d}__{c}__{t}", c) for q, c, _, t, _, _ in rows if q == d})
            label |= dict(zip([u for u, _ in units], dealt_labels(units, p)))
        for f in (0, 1):
            mine = [(d, label[f"{d}__{c}__{t}"], x) for d, c, q, t, _, x in rows if q == f]
            m = [np.mean([x for _, c, x in mine if c == g]) for g in "xyz"]
            stats[f, p] = round(3 * sum(x * x for x in m) - sum(m) ** 2, 8), round(np.mean([plain_energy([x for q, _, x in mine if q == d], [c for q, c, _ in mine if q == d]) for d in (3, 11)]), 8)
    for k, test in enumerate((mean, energy)):
        for r in test.collect():
            assert r.n_perms == 70 and r.observed == pytest.approx(stats[r.freq, 0][k], abs=1e-7)
            assert r.p == pytest.approx((1 + sum(stats[r.freq, p][k] >= stats[r.freq, 0][k] for p in range(1, 71))) / 71)


def test_pairwise_energy_is_a_test_of_two_groups(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(0, "abc"[k % 3], f"{k:03d}", float(rng.normal(k % 3, 1))) for k in range(60)], "freq int, g string, id string, value double")
    pairs = st.pairwise_energy_tests(df, "g", ["freq"], F.col("id"), n_perms=60)
    assert joins(pairs) == 2  # those of the pairs of groups
    got = {r.pair: (r.observed, r.p) for r in pairs.collect()}
    assert set(got) == {"a-b", "a-c", "b-c"}
    one = st.energy_test(df.where("g <> 'b'"), "g", ["freq"], F.col("id"), 60).first()
    assert got["a-c"] == (one.observed, one.p)


@pytest.fixture(scope="session")
def odd_vectors(spark):
    """id, vector: copies, ties at the third place, a null vector, a repeated id and a null id; and them as a list."""
    rng = np.random.default_rng(11)
    rows = [(3 * k, [float(x) for x in rng.integers(0, 3, 4)]) for k in range(70)] + [(7, None), (9, [0.0, 0.0, 0.0, 0.0]), (9, [1.0, 2.0, 0.0005, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    return spark.createDataFrame(rows, "id long, vector array<double>"), rows


def plain_distances(rows, distance):
    """(i, j, d) of all pairs i < j of ids, in order of the pairs."""
    found = [(a, b, None if x is None or y is None else float(distance(np.array(x), np.array(y)))) for a, x in rows for b, y in rows if a is not None and b is not None and a < b]
    return sorted(found, key=lambda r: (r[0], r[1], r[2] is None, r[2]))


def same_cells(got, want):
    got = sorted(got, key=lambda r: (r[0], r[1], r[2] is None, r[2]))
    return len(got) == len(want) and all(g[:2] == w[:2] and (g[2] == w[2] or (g[2] is not None and w[2] is not None and (abs(g[2] - w[2]) < 1e-9 or g[2] != g[2] and w[2] != w[2]))) for g, w in zip(got, want))


def half_up(x):
    return np.floor(x * 1000 + 0.5) / 1000


def plain_nearest(rows, k):
    """(i, j, d): the k nearest of other ids for each id by (distance to 3 places, id), missing distances last."""
    cells = plain_distances(rows, lambda x, y: half_up(np.sqrt(((x - y) ** 2).sum())))
    both = sorted([*cells, *((j, i, d) for i, j, d in cells)], key=lambda r: (r[0], r[2] is None, r[2], r[1]))
    seen, out = {}, []
    for r in both:
        seen[r[0]] = seen.get(r[0], 0) + 1
        if seen[r[0]] <= k:
            out.append(r)
    return out


def plain_edges(near):
    out = {}
    for i, j, d in near:
        e = (min(i, j), max(i, j))
        out[e] = d if out.get(e) is None else out[e] if d is None else min(out[e], d)
    return out


def small_blocks(monkeypatch):
    from curvelake.operators import neighbours as nb

    for name, size in (("BLOCK", 20), ("LEFT", 16), ("RIGHT", 31)):
        monkeypatch.setattr(nb, name, size)


def test_adaptive_graph_of_nearest(spark, odd_vectors, monkeypatch):
    df, rows = odd_vectors
    small_blocks(monkeypatch)
    near = gr.nearest(df, len(rows), 12)
    assert joins(near) == 0  # no join of all pairs
    edges = lambda d: sorted((r.u, r.v, r.weight) for r in d.where("weight IS NOT NULL").collect())
    got = edges(gr.adaptive_neighborhood_graph(near, 2, 12))
    assert got and got == edges(gr.adaptive_neighborhood_graph(gr.adj_matrix(df, len(rows)), 2, 12))


def test_euclid_of_odd_rows(spark, odd_vectors, monkeypatch):
    df, rows = odd_vectors
    small_blocks(monkeypatch)
    got = gr.adj_matrix(df, len(rows), 1)
    assert joins(got) == 0
    assert same_cells([tuple(r) for r in got.collect()], plain_distances(rows, lambda x, y: half_up(np.sqrt(((x - y) ** 2).sum()))))
    with pytest.raises(Exception, match="differ in length"):
        gr.adj_matrix(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vector array<double>"), 2).collect()


def test_knn_graph_of_nearest(spark, odd_vectors, monkeypatch):
    df, rows = odd_vectors
    small_blocks(monkeypatch)
    near = gr.nearest(df, len(rows), 3)
    assert joins(near) == 0 and same_cells([(r.i, r.j, r.d) for r in near.collect()], sorted(plain_nearest(rows, 3), key=lambda r: (r[0], r[1], r[2] is None, r[2])))
    got = {(r.u, r.v): r.weight for r in gr.nearest_neighbor_graph(near, 3, True).collect()}
    assert got == pytest.approx(plain_edges(plain_nearest(rows, 3)))


def test_nearest_allows_for_rounding(spark):
    """Far from the origin a matrix product loses all digits of a distance; exact distances still decide."""
    rng = np.random.default_rng(2)
    rows = [(k, [float(1e8 + x) for x in rng.integers(0, 6, 3)]) for k in range(400)]
    near = gr.nearest(spark.createDataFrame(rows, "id long, vector array<double>"), 400, 4)
    assert same_cells([(r.i, r.j, r.d) for r in near.collect()], sorted(plain_nearest(rows, 4)))


def test_cosine_of_odd_rows(spark, odd_vectors, monkeypatch):
    """A vector of zeros has no direction: NaN, as SQL has it, not an error."""
    df, rows = odd_vectors
    small_blocks(monkeypatch)
    got = gr.adj_matrix(df, len(rows), 2)
    with np.errstate(invalid="ignore"):
        want = plain_distances(rows, lambda x, y: half_up(1 - (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))))
    key = lambda r: (r[0], r[1], r[2] is None, r[2] if r[2] == r[2] else 9.0)
    got, want = sorted((tuple(r) for r in got.collect()), key=key), sorted(want, key=key)
    assert any(d is not None and d != d for _, _, d in want) and [r[:2] for r in got] == [r[:2] for r in want]
    assert [9.0 if a is None else a for _, _, a in got] == pytest.approx([9.0 if a is None else a for _, _, a in want], abs=1.1e-3, nan_ok=True)


def test_spearman_of_odd_rows(spark, odd_vectors, monkeypatch):
    """Constant vectors have no correlation: NaN, not an error; a missing vector has no ranks and no pairs."""
    df, rows = odd_vectors
    small_blocks(monkeypatch)
    got = gr.adj_matrix(df, len(rows), 3)
    assert joins(got) == 0
    from pandas import Series

    def apart(x, y):
        a, b = Series(x).rank(), Series(y).rank()
        return half_up(1 - abs(a.corr(b)) + 1e-9) if a.std() and b.std() else np.nan

    key = lambda r: (r[0], r[1], r[2] if r[2] == r[2] else 9.0)
    got, want = sorted((tuple(r) for r in got.collect()), key=key), sorted(plain_distances([r for r in rows if r[1]], apart), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-9, nan_ok=True)


def test_spearman_ranks_rows_once(spark, odd_vectors, monkeypatch):
    """Rows are ranked before they are copied to blocks, without a table of all pairs of elements; a product of ranks gives what sums in order give."""
    import tracemalloc

    from curvelake.operators import neighbours as nb

    df, rows = odd_vectors
    small_blocks(monkeypatch)
    plan = gr.adj_matrix(df, len(rows), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.index("Generate explode") < plan.rindex("MapInArrow")
    assert gr.adj_matrix(df.limit(0), 0, 3).collect() == []
    tracemalloc.start()
    got = nb.centred_ranks(np.array([[2.0, np.nan, 1.0, 2.0, np.nan, -np.inf] * 500]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2_000_000 and got[0, :6].tolist() == [0.0, 1000.0, -750.0, 0.0, 1000.0, -1250.0]
    ranks = nb.centred_ranks(np.random.default_rng(3).integers(0, 4, (60, 7)).astype(float))
    with np.errstate(invalid="ignore"):
        r = nb._sum(ranks[:, None], ranks[None], np.multiply) / (np.sqrt((ranks**2).sum(1))[:, None] * np.sqrt((ranks**2).sum(1)))
    assert np.array_equal(nb.rank_distances(2 * ranks, 2 * ranks), nb.round_half_up(1 - np.abs(r) + 1e-9, 3), equal_nan=True)


def test_lsh_searches_whole_buckets(spark, monkeypatch):
    """In one bucket the search is exact however large it is; rows of no common bucket never meet."""
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(0, 1, 4)]) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    small_blocks(monkeypatch)
    edges = lambda g: {(r.u, r.v): r.weight for r in g.collect()}
    x = np.array([v for _, v in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(min(i, j), max(i, j)): d[i, j] for i in range(90) for j in np.argsort(d[i])[1:4].tolist()}
    whole = gr.nearest_in_buckets(df.withColumn("buckets", F.array(F.lit(0.0), F.lit(1.0))), 3)
    assert edges(gr.nearest_neighbor_graph(whole, 3, True)) == pytest.approx(want)
    apart = gr.nearest_in_buckets(df.withColumn("buckets", F.array((F.col("id") % 2).cast("double"))), 3).collect()
    assert len(apart) == 270 and all((r.i - r.j) % 2 == 0 for r in apart)
    graph = gr.nearest_neighbor_graph_lsh(df, 3, 4.0, 6)
    assert len(set(edges(graph)) & set(want)) >= 0.9 * len(want)


def test_lsh_pairs_meet_once(monkeypatch):
    """A pair of common buckets in several tables is searched in the first of them alone, and no pair is lost."""
    import pyarrow as pa

    from curvelake.operators import neighbours as nb

    rng = np.random.default_rng(6)
    x, buckets = rng.normal(0, 1, (600, 3)), rng.integers(-1, 1, (600, 3)).astype(float)
    met, now = np.zeros((600, 600), int), []

    def near_pairs(ids, x, void, left, right, k, places):
        met[np.ix_(now[-1][ids[left]], now[-1][ids[right]])] += 1
        return iter(())

    def searched():
        for t in range(3):
            for value in (-1.0, 0.0):
                rows = np.flatnonzero(buckets[:, t] == value)
                now.append(rows)
                table = pa.table({"id": rows, "vector": x[rows].tolist(), "side": np.zeros(len(rows), int), "seen": pa.array(buckets[rows, :t].tolist(), pa.list_(pa.float64()))})
                yield from nb._search(3, None)(table)

    common = (buckets[:, None] == buckets[None]).any(2)
    with monkeypatch.context() as m:
        m.setattr(nb, "near_pairs", near_pairs)
        assert list(searched()) == [] and (met == common).all()
    got = sorted({(d, i, j) for c in searched() for i, j, d in zip(*(a.to_pylist() for a in c))})
    d = np.where(common & ~np.eye(600, dtype=bool), np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), np.inf)
    for i in range(600):
        assert [j for _, of, j in got if of == i][:3] == np.argsort(d[i])[:3].tolist()


def test_search_of_copies_in_tiles(monkeypatch):
    """Bounds fall from tile to tile; of equal rows only as many as count get exact distances."""
    from curvelake.operators import neighbours as nb

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(0, 3, (300, 3)).astype(float), np.ones((500, 3))])[rng.permutation(800)]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    exact, plain = [], nb._sum
    monkeypatch.setattr(nb, "TILE", (64, 50), raising=False)
    monkeypatch.setattr(nb, "_sum", lambda a, b, term: exact.append(len(a)) or plain(a, b, term))
    rows = np.arange(800)
    got = [np.concatenate(c).tolist() for c in zip(*nb.near_pairs(rows, x, np.zeros(800, bool), rows, rows, 4, None))]
    want = [(i, j) for i in range(800) for j in np.lexsort((rows, d[i]))[:4].tolist()]
    assert list(zip(*got[:2])) == want and got[2] == [d[p] for p in want] and sum(exact) < 800 * 40


def test_sim_graph_of_nearest(spark, odd_vectors, monkeypatch):
    df, rows = odd_vectors
    small_blocks(monkeypatch)
    near = gr.nearest(df, len(rows), 4)
    edges = lambda d: sorted((r.u, r.v, -1.0 if r.weight is None else r.weight) for r in d.collect())
    nodes = df.where("id IS NOT NULL")
    got = edges(gr.sim_graph(near, nodes, 4))
    assert joins(near) == 0 and (0, 0, 0.0) in got and got == edges(gr.sim_graph(gr.adj_matrix(df, len(rows)), nodes, 4))


def test_every_query_has_stable_columns(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["graph_id", "entropy", "q05", "q50", "q95"]
