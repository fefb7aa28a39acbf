"""Graph metrics, communities and centrality."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .curvature import triangles
from .graph import EDGE, both_ways, endpoints, remove_self_loops


def degrees(edges: DataFrame) -> DataFrame:
    """graph_id, node, degree, strength; a loop counts twice."""
    return edges.select("graph_id", F.explode(F.array("u", "v")).alias("node"), "weight").groupBy("graph_id", "node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def top_nodes(edges: DataFrame, by: str = "degree", n: int = 10, lowest: bool = False) -> DataFrame:
    """The first n nodes of each graph by degree or strength; ties by node."""
    order = F.col(by) if lowest else F.col(by).desc()
    return degrees(edges).withColumn("rank", F.row_number().over(Window.partitionBy("graph_id").orderBy(order, "node"))).where(F.col("rank") <= n)


def density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, n_nodes, n_edges, density = 2 m / (n (n - 1)), is_complete."""
    n = nodes.groupBy("graph_id").agg(F.count_distinct("node").alias("n_nodes"))
    m = edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"), F.sum(F.when(F.col("u") == F.col("v"), 1).otherwise(0)).alias("loops"))
    got = n.join(m, "graph_id", "left").select("graph_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("loops", F.lit(0)).alias("loops"))
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return got.select("graph_id", "n_nodes", "n_edges", F.coalesce(2.0 * F.col("n_edges") / F.nullif(pairs, F.lit(0)), F.lit(0.0)).alias("density"), (2 * (F.col("n_edges") - F.col("loops")) == pairs).alias("is_complete"))


def isolates(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.select("graph_id", "node").join(endpoints(edges), ["graph_id", "node"], "left_anti")


def triangle_counts(edges: DataFrame) -> DataFrame:
    """graph_id, node, triangles of nodes that lie in some."""
    return triangles(remove_self_loops(edges)).select("graph_id", F.explode(F.array("a", "b", "c")).alias("node")).groupBy("graph_id", "node").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """graph_id, node, clustering: of Onnela et al. with weights over the greatest, or plain; 0 below degree 2."""
    e = remove_self_loops(edges).select(*EDGE, "weight")
    t = triangles(e)
    if weighted:
        w = e.join(e.groupBy("graph_id").agg(F.max("weight").alias("most")), "graph_id").select(*EDGE, (F.col("weight") / F.col("most")).alias("w"))
        for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
            t = t.join(w.select("graph_id", F.col("u").alias(a), F.col("v").alias(b), F.col("w").alias(f"w{a}{b}")), ["graph_id", a, b])
        value = F.cbrt(F.col("wab") * F.col("wac") * F.col("wbc"))
    else:
        value = F.lit(1.0)
    sums = t.select("graph_id", F.explode(F.array("a", "b", "c")).alias("node"), value.alias("value")).groupBy("graph_id", "node").agg(F.sum("value").alias("s"))
    d = both_ways(e).groupBy("graph_id", "node").agg(F.count("*").alias("d"))
    pairs = F.col("d") * (F.col("d") - 1)
    return d.join(sums, ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce(2 * F.col("s") / F.nullif(pairs, F.lit(0)), F.lit(0.0)).alias("clustering"))


def compute_mean_clustering(edges: DataFrame, nodes: DataFrame, weighted: bool = True) -> DataFrame:
    got = nodes.select("graph_id", "node").join(clustering(edges, weighted), ["graph_id", "node"], "left")
    return got.groupBy("graph_id").agg(F.avg(F.coalesce("clustering", F.lit(0.0))).alias("mean_clustering"))


def compute_assortativity(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """graph_id, assortativity: Pearson correlation of the ends' strengths over both directions; 0 where undefined."""
    d = degrees(edges).select("graph_id", "node", F.col("strength" if weighted else "degree").cast("double").alias("d"))
    e = edges.select(*EDGE)
    for x in ("u", "v"):
        e = e.join(d.select("graph_id", F.col("node").alias(x), F.col("d").alias(f"d{x}")), ["graph_id", x])
    two = e.select("graph_id", F.inline(F.array(F.struct(F.col("du").alias("x"), F.col("dv").alias("y")), F.struct(F.col("dv").alias("x"), F.col("du").alias("y")))))
    sums = two.groupBy("graph_id").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    return sums.select("graph_id", F.when(spread > 1e-9 * F.col("sxx"), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sx")) / spread).otherwise(0.0).alias("assortativity"))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, cut_every: int = 3) -> DataFrame:
    """graph_id, node, component (its least node), by least labels with pointer jumping; isolates are components of their own."""
    all_nodes = endpoints(edges) if nodes is None else nodes.select("graph_id", "node").union(endpoints(edges)).distinct()
    both = cut(both_ways(remove_self_loops(edges).select(*EDGE)).distinct())
    labels = cut(all_nodes.withColumn("label", F.col("node")))
    while True:
        before = labels
        for _ in range(cut_every):
            near = both.join(labels.withColumnRenamed("node", "other"), ["graph_id", "other"]).groupBy("graph_id", "node").agg(F.min("label").alias("near"))
            low = labels.join(near, ["graph_id", "node"], "left").select("graph_id", "node", F.least("label", F.coalesce("near", "label")).alias("low"))
            up = low.select("graph_id", F.col("node").alias("low"), F.col("low").alias("up"))
            labels = low.join(up, ["graph_id", "low"]).select("graph_id", "node", F.least("low", "up").alias("label"))
        labels = cut(labels)
        if labels.join(before.withColumnRenamed("label", "old"), ["graph_id", "node"]).where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def hop_distances(edges: DataFrame, cut_every: int = 3) -> DataFrame:
    """graph_id, source, node, hops of all reachable pairs: frontiers by join, each pair entered once."""
    both = cut(both_ways(remove_self_loops(edges).select(*EDGE)).select("graph_id", "node", "other").distinct())
    known = endpoints(edges).select("graph_id", F.col("node").alias("source"), "node", F.lit(0).alias("hops"))
    front, k = known, 0
    while True:
        k += 1
        step = front.join(both, ["graph_id", "node"]).select("graph_id", "source", F.col("other").alias("node")).distinct()
        front = step.join(known, ["graph_id", "source", "node"], "left_anti").withColumn("hops", F.lit(k))
        front = cut(front)
        if front.isEmpty():
            return known
        known = known.unionByName(front)
        if k % cut_every == 0:
            known = cut(known)


def compute_global_efficiency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, global_efficiency: mean of 1 / hops over ordered pairs, 0 for fewer than two nodes."""
    n = nodes.groupBy("graph_id").agg(F.count_distinct("node").alias("n"))
    s = hop_distances(edges).where("hops > 0").groupBy("graph_id").agg(F.sum(1.0 / F.col("hops")).alias("s"))
    pairs = F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))
    return n.join(s, "graph_id", "left").select("graph_id", F.coalesce(F.col("s") / pairs, F.lit(0.0)).alias("global_efficiency"))


def summarize_network(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each graph: counts, density, weights, loops, isolates, components, triangles and mean clustering."""
    loops = edges.groupBy("graph_id").agg(F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"), F.avg("weight").alias("mean_weight"), F.sum(F.when(F.col("u") == F.col("v"), 1).otherwise(0)).alias("n_self_loops"))
    alone = isolates(edges, nodes).groupBy("graph_id").agg(F.count("*").alias("n_isolates"))
    parts = connected_components(edges, nodes).groupBy("graph_id", "component").agg(F.count("*").alias("size"))
    parts = parts.groupBy("graph_id").agg(F.count("*").alias("n_components"), F.max("size").alias("largest_component"))
    tri = triangles(remove_self_loops(edges)).groupBy("graph_id").agg(F.count("*").alias("n_triangles"))
    out = density(edges, nodes).join(loops, "graph_id", "left")
    for t in (alone, parts, tri):
        out = out.join(t, "graph_id", "left")
    out = out.join(compute_mean_clustering(edges, nodes, False).withColumnRenamed("mean_clustering", "avg_clustering"), "graph_id").join(compute_mean_clustering(edges, nodes).withColumnRenamed("mean_clustering", "avg_clustering_weighted"), "graph_id")
    return out.fillna(0, ["n_isolates", "n_triangles", "n_self_loops"]).withColumn("is_connected", F.col("n_components") == 1)


def partition_modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """graph_id, modularity of a partition (graph_id, node, community); 0 for a graph without edges."""
    e = edges.select(*EDGE, "weight")
    for x in ("u", "v"):
        e = e.join(parts.select("graph_id", F.col("node").alias(x), F.col("community").alias(f"c{x}")), ["graph_id", x])
    total = e.groupBy("graph_id").agg(F.sum("weight").alias("m"))
    inner = e.where("cu = cv").groupBy("graph_id", F.col("cu").alias("c")).agg(F.sum("weight").alias("inside"))
    ends = e.select("graph_id", F.explode(F.array("cu", "cv")).alias("c"), "weight").groupBy("graph_id", "c").agg(F.sum("weight").alias("ends"))
    by = ends.join(inner, ["graph_id", "c"], "left").join(total, "graph_id")
    share = F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("ends") / (2 * F.col("m")), F.lit(2.0))
    return by.groupBy("graph_id").agg(F.sum(share).alias("modularity"))


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    nodes, at = np.unique(np.concatenate([pdf["u"], pdf["v"]]), return_inverse=True)
    n, u, v = len(nodes), at[: len(pdf)], at[len(pdf) :]
    a = np.zeros((n, n))
    np.add.at(a, (u, v), pdf["weight"].to_numpy(float))
    return nodes, a + a.T - np.diag(np.diag(a))


def greedy_communities(a: np.ndarray) -> np.ndarray:
    """Agglomeration by greatest gain in modularity (Clauset, Newman and Moore); ties by lower community numbers."""
    n = len(a)
    two_m = a.sum() + np.trace(a)
    if two_m == 0:
        return np.arange(n)
    e = (a + np.diag(np.diag(a))) / two_m
    share, label, alive = e.sum(1), np.arange(n), np.ones(n, bool)
    while alive.sum() > 1:
        gain = np.where(alive[:, None] & alive[None, :] & (e > 0), 2 * (e - np.outer(share, share)), -np.inf)
        np.fill_diagonal(gain, -np.inf)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[i, j] <= 1e-15:
            break
        i, j = min(i, j), max(i, j)
        e[i] += e[j]
        e[:, i] += e[:, j]
        share[i] += share[j]
        e[j], e[:, j], alive[j] = 0, 0, False
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def louvain(a: np.ndarray, seed: int = 42) -> np.ndarray:
    """Local moves and aggregation until no move gains; nodes in an order drawn with the seed."""
    rng, top = np.random.default_rng(seed), np.arange(len(a))
    a = a + np.diag(np.diag(a))
    while True:
        n, two_m, k = len(a), a.sum(), a.sum(1)
        label, total = np.arange(n), k.copy()
        moved, any_move = two_m > 0, False
        while moved:
            moved = False
            for i in rng.permutation(n).tolist():
                old = label[i]
                total[old] -= k[i]
                to = np.bincount(label, a[i], n) - np.where(np.arange(n) == old, a[i, i], 0)
                gain = to - total * k[i] / two_m
                best = int(gain.argmax())
                new = best if gain[best] > gain[old] + 1e-12 else old
                label[i] = new
                total[new] += k[i]
                moved |= new != old
            any_move |= moved
        names, label = np.unique(label, return_inverse=True)
        top = label[top]
        if not any_move or len(names) == n:
            return top
        s = np.eye(len(names))[label]
        a = s.T @ a @ s


def communities(edges: DataFrame, method: str = "greedy", seed: int = 42) -> DataFrame:
    """graph_id, node, community by "greedy" agglomeration or "louvain"; a group a graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, a = _matrix(pdf)
        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "node": nodes, "community": greedy_communities(a) if method == "greedy" else louvain(a, seed)})

    return _ints(edges).groupBy("graph_id").applyInPandas(run, "graph_id string, node int, community int")


def compute_modularity(edges: DataFrame) -> DataFrame:
    return partition_modularity(edges, communities(edges))


def brandes(a: np.ndarray) -> np.ndarray:
    """Betweenness with weights as distances, normalised by (n - 1)(n - 2) / 2."""
    n = len(a)
    near = [np.flatnonzero(row) for row in a]
    score = np.zeros(n)
    for s in range(n):
        dist, paths, order, before = np.full(n, np.inf), np.zeros(n), [], [[] for _ in range(n)]
        dist[s], paths[s], heap, done = 0, 1, [(0.0, s)], np.zeros(n, bool)
        while heap:
            d, x = heapq.heappop(heap)
            if done[x]:
                continue
            done[x] = True
            order.append(x)
            for y in near[x].tolist():
                new = d + a[x, y]
                if new < dist[y] - 1e-12:
                    dist[y], paths[y], before[y] = new, paths[x], [x]
                    heapq.heappush(heap, (new, y))
                elif abs(new - dist[y]) <= 1e-12 and not done[y]:
                    paths[y] += paths[x]
                    before[y].append(x)
        part = np.zeros(n)
        for y in reversed(order):
            for x in before[y]:
                part[x] += paths[x] / paths[y] * (1 + part[y])
            if y != s:
                score[y] += part[y]
    return score / ((n - 1) * (n - 2)) if n > 2 else score


def find_centrality(edges: DataFrame, seed: int = 42) -> DataFrame:
    """graph_id, node, community (Louvain), degree_centrality, betweenness of every node."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, a = _matrix(pdf)
        off = a.copy()
        np.fill_diagonal(off, 0)
        n = max(1, len(nodes) - 1)
        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "node": nodes, "community": louvain(a, seed), "degree_centrality": (a != 0).sum(1) / n + (np.diag(a) != 0) / n, "betweenness": brandes(off)})

    return _ints(edges).groupBy("graph_id").applyInPandas(run, "graph_id string, node int, community int, degree_centrality double, betweenness double")


def _ints(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), F.coalesce("weight", F.lit(1.0)).cast("double").alias("weight"))


def node_to_partition(sets: DataFrame) -> DataFrame:
    """graph_id, node, community of (graph_id, communities array<array<int>>)."""
    return sets.select("graph_id", F.posexplode("communities").alias("community", "members")).select("graph_id", F.explode("members").alias("node"), "community")


def connectivity_matrix_features(cells: DataFrame, n: int, threshold: float = 0.0) -> DataFrame:
    """Features of 2n x 2n matrices (graph_id, i, j, value), all cells: the between-subject block, the within-subject upper triangles, total strength."""
    bad = F.max(F.greatest("i", "j")) >= 2 * n
    cross = (F.col("i") < n) & (F.col("j") >= n)
    w, mean = F.col("value"), F.avg
    upper = F.col("i") < F.col("j")
    got = cells.groupBy("graph_id").agg(
        mean(F.when(cross, w)).alias("cross_mean"), F.stddev_pop(F.when(cross, w)).alias("cross_std"), mean(F.when(cross, F.abs(w))).alias("cross_abs_mean"),
        mean(F.when(upper & (F.col("j") < n), F.abs(w))).alias("intra_a_mean"), mean(F.when(upper & (F.col("i") >= n), F.abs(w))).alias("intra_b_mean"),
        F.sum(F.when(upper, F.abs(w))).alias("total_strength"), bad.alias("bad"),
    )
    return got.withColumn("cross_mean", F.when(F.col("bad"), F.raise_error(F.lit("a matrix isn't 2n x 2n")).cast("double")).otherwise(F.col("cross_mean"))).drop("bad")


def window_features(cells: DataFrame, n: int, threshold: float = 0.0) -> DataFrame:
    """connectivity_matrix_features with the graph metrics of |value| > threshold."""
    nodes = cells.select("graph_id", F.col("i").alias("node")).distinct()
    edges = cells.where((F.col("i") < F.col("j")) & (F.abs("value") > threshold)).select("graph_id", F.col("i").alias("u"), F.col("j").alias("v"), F.abs("value").alias("weight"))
    out = connectivity_matrix_features(cells, n, threshold)
    for t in (compute_global_efficiency(edges, nodes), compute_modularity(edges), compute_assortativity(edges), compute_mean_clustering(edges, nodes)):
        out = out.join(t, "graph_id", "left")
    return out.fillna(0.0)


def frame_similarity(cells: DataFrame) -> DataFrame:
    """f, g, r: correlation of the flattened matrices of two frames (frame, i, j, value), all cells present."""
    a, b = cells.withColumnsRenamed({"frame": "f", "value": "x"}), cells.withColumnsRenamed({"frame": "g", "value": "y"})
    return a.join(b, ["i", "j"]).where("f <= g").groupBy("f", "g").agg(F.corr("x", "y").alias("r"))
