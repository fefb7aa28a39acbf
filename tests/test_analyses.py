"""Whole analyses on small inputs."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from curvelake.functions.labels import base_code, side_of
from curvelake.plans import analyses


def test_labels(spark):
    df = spark.createDataFrame([("lM1",), ("rV1",), ("x",)], "label string").select(side_of(F.col("label")).alias("s"), base_code(F.col("label")).alias("b"))
    assert [tuple(r) for r in df.collect()] == [("left", "M1"), ("right", "V1"), ("none", "x")]


def test_flow_analysis_counts_windows(spark):
    phases = np.random.default_rng(0).uniform(-3, 3, (4, 300))
    signal = spark.createDataFrame([("r", c, t, float(phases[c, t])) for c in range(4) for t in range(300)], "run string, channel int, t long, phase double")
    got = analyses.ricci_flow_analysis(signal, 100, 100, None, 2, 0.01).collect()
    assert len(got) == 3 and all(r.n_edges == 6 and r.n_components == 1 for r in got)


def test_sweeps(spark):
    rng = np.random.default_rng(1)
    edges = spark.createDataFrame([(f"g{k}", u, v, float(rng.uniform(0.5, 2))) for k in range(2) for u, v in itertools.combinations(range(6), 2)], "graph_id string, u int, v int, weight double")
    assert analyses.curvature_sweep(edges).count() == 2 and analyses.curvature_sweep(edges, "augmented", "vasicek").where("entropy is null").isEmpty()
    grid = analyses.orc_grid(edges, (0.5,), (0.0, 1.0)).toPandas()
    assert len(grid) == 4 and set(grid.power) == {0.0, 1.0}
    assert analyses.gdd_analysis(edges, 6).count() == 4
