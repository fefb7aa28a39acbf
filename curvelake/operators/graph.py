"""Windows, graph construction, projection and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .neighbours import all_distances, nearest, nearest_in_buckets, ranked  # noqa: F401

EDGE = ["graph_id", "u", "v"]


def canonical(edges: DataFrame) -> DataFrame:
    """u <= v in every row."""
    return edges.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: node, other and the other columns; a loop comes once."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    ends = F.when(F.col("u") == F.col("v"), F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")))).otherwise(
        F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))
    )
    return edges.select(*rest, F.inline(ends))


def build_graphs_from_matrices(cells: DataFrame, absolute: bool = False) -> DataFrame:
    """Edges of cells (graph_id, i, j, value) of symmetric matrices: one for each pair that isn't 0, |value| if asked for."""
    value = F.abs("value") if absolute else F.col("value")
    return cells.where((F.col("i") <= F.col("j")) & (F.col("value") != 0)).select("graph_id", F.col("i").alias("u"), F.col("j").alias("v"), value.alias("weight"))


def build_sliding_window_graphs(cells: DataFrame) -> DataFrame:
    return build_graphs_from_matrices(cells, absolute=True)


def remove_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v")


def prune_graph_by_weight(edges: DataFrame, threshold: float) -> DataFrame:
    """Edges of at least this weight; a missing weight counts as 0."""
    return edges.where(F.coalesce("weight", F.lit(0.0)) >= threshold)


def endpoints(edges: DataFrame) -> DataFrame:
    """graph_id and node of all ends."""
    return edges.select("graph_id", F.explode(F.array("u", "v")).alias("node")).distinct()


def pruned_nodes(edges: DataFrame, nodes: DataFrame, threshold: float, keep_all_nodes: bool = False) -> DataFrame:
    """Nodes of the pruned graph: those of surviving edges, or all."""
    kept = nodes.select("graph_id", "node")
    return kept if keep_all_nodes else kept.join(endpoints(prune_graph_by_weight(edges, threshold)), ["graph_id", "node"], "left_semi")


def starts_of(t: Column | str, size: int, stride: int, length: Column | int | None = None) -> Column:
    """Numbers of the windows k that hold sample t, k * stride <= t < k * stride + size; with a length complete ones only."""
    t = F.col(t) if isinstance(t, str) else t
    first = F.greatest(F.lit(0), F.floor((t - size + stride) / F.lit(stride))).cast("long")
    last = F.floor(t / F.lit(stride)).cast("long")
    if length is not None:
        last = F.least(last, F.floor((length - F.lit(size)) / F.lit(stride)).cast("long"))
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))


def pair_sums(signal: DataFrame, key: list[str]) -> DataFrame:
    """Sums of cos and sin of phase differences by key, u <= v. key: run and what rows of a sum have in common; t pairs rows."""
    at = [*dict.fromkeys([*key, "t"])]
    phasor = signal.select(*at, "channel", F.cos("phase").alias("c"), F.sin("phase").alias("s"))
    a, b = phasor.withColumnsRenamed({"channel": "u", "c": "ca", "s": "sa"}), phasor.withColumnsRenamed({"channel": "v", "c": "cb", "s": "sb"})
    pairs = a.join(b, at).where("u <= v")
    re, im = F.col("ca") * F.col("cb") + F.col("sa") * F.col("sb"), F.col("sa") * F.col("cb") - F.col("ca") * F.col("sb")
    return pairs.groupBy(*key, "u", "v").agg(F.sum(re).alias("re"), F.sum(im).alias("im"), F.count("*").alias("n"))


def plv(re: Column, im: Column, n: Column) -> Column:
    return F.sqrt(re * re + im * im) / n


def sliding_window_plv(signal: DataFrame, size: int, stride: int, length: int | None = None) -> DataFrame:
    """run, window, u, v, weight: the phase-locking value of each channel pair in each complete window, loops with 1 included.

    The sums are additive: pairs are joined and summed once for each stretch of `stride` samples, and windows add up stretches, so no sample
    is joined once for each window that holds it. Where size isn't a multiple of stride samples go to windows first.
    `length` is the number of samples of a run, by default its greatest t + 1.
    """
    if length is None:
        ends = signal.groupBy("run").agg((F.max("t") + 1).alias("length"))
        signal = signal.join(ends, "run")
    else:
        signal = signal.withColumn("length", F.lit(length))
    if size % stride == 0:
        parts = pair_sums(signal.withColumn("part", F.floor(F.col("t") / stride).cast("long")), ["run", "length", "part"])
        sums = parts.select("run", "u", "v", "re", "im", "n", F.explode(starts_of(F.col("part") * stride, size, stride, F.col("length"))).alias("window"))
    else:
        spread = signal.select("run", "t", "channel", "phase", F.explode(starts_of("t", size, stride, F.col("length"))).alias("window"))
        sums = pair_sums(spread, ["run", "window"])
    total = sums.groupBy("run", "window", "u", "v").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.sum("n").alias("n"))
    return total.select("run", "window", "u", "v", plv(F.col("re"), F.col("im"), F.col("n")).alias("weight"))


def get_plv_matrix(signal: DataFrame) -> DataFrame:
    """run, u, v, weight over all samples."""
    return pair_sums(signal, ["run"]).select("run", "u", "v", plv(F.col("re"), F.col("im"), F.col("n")).alias("weight"))


def get_avg_plv(graphs: DataFrame) -> DataFrame:
    """Mean weight of each window's edges, loops included."""
    return graphs.groupBy("run", "window").agg(F.avg("weight").alias("avg_plv"))


def merge_runs(signal: DataFrame, nodes_per_run: int, run_index: str = "run_idx") -> DataFrame:
    """All runs' channels as nodes of one run: run index * nodes_per_run + channel."""
    return signal.select(F.lit("merged").alias("run"), (F.col(run_index) * nodes_per_run + F.col("channel")).cast("int").alias("channel"), "t", "phase")


def build_merged_plv_graph(signal: DataFrame, nodes_per_run: int, threshold: float | None = None) -> DataFrame:
    """PLV edges of the merged runs, without loops and, with a threshold, without weaker ones."""
    edges = remove_self_loops(get_plv_matrix(merge_runs(signal, nodes_per_run)))
    return edges if threshold is None else edges.where(F.col("weight") >= threshold)


def aggregate_window_graphs(edges: DataFrame, nodes_per_run: int, run_index: str = "run_idx") -> DataFrame:
    """Disjoint union of the runs' graphs in each graph_id."""
    shift = F.col(run_index) * nodes_per_run
    return edges.select("graph_id", (F.col("u") + shift).cast("int").alias("u"), (F.col("v") + shift).cast("int").alias("v"), "weight")


def resolve_connectome_weights(connectome: DataFrame, size: int, nodes_per_run: int) -> DataFrame:
    """u, v, weight for runs of nodes_per_run nodes: as it is, twice on the diagonal, cut, or nothing where it can't fit."""
    at = connectome.select("u", "v", "weight")
    if nodes_per_run == size:
        return at
    if nodes_per_run == 2 * size:
        return at.unionByName(at.select((F.col("u") + size).cast("int").alias("u"), (F.col("v") + size).cast("int").alias("v"), "weight"))
    if nodes_per_run < size:
        return at.where((F.col("u") < nodes_per_run) & (F.col("v") < nodes_per_run))
    return at.limit(0)


def attach_connectome_weights(edges: DataFrame, connectome: DataFrame, nodes_per_run: int) -> DataFrame:
    """Adds plv_weight, connectome_weight (0 between runs) and source_run (-1 between runs). connectome has both directions."""
    n = nodes_per_run
    run_u, run_v = F.floor(F.col("u") / n).cast("int"), F.floor(F.col("v") / n).cast("int")
    known = connectome.select(F.col("u").alias("_a"), F.col("v").alias("_b"), F.col("weight").alias("_w"))
    joined = edges.join(known, (F.col("u") % n == F.col("_a")) & (F.col("v") % n == F.col("_b")), "left")
    return joined.select(
        *edges.columns, F.col("weight").alias("plv_weight"), F.when(run_u == run_v, F.coalesce("_w", F.lit(0.0))).otherwise(0.0).alias("connectome_weight"),
        F.when(run_u == run_v, run_u).otherwise(-1).alias("source_run"),
    )


def create_virtual_partner_connectome(connectome: DataFrame, labels: DataFrame, size: int, c_inter: float = 0.0, motor: tuple[str, ...] = ("lM1", "rM1"), visual: tuple[str, ...] = ("rV1", "lV1")) -> DataFrame:
    """u, v, weight of two copies of a connectome, with weight density / 100 * c_inter between one's motor and the other's visual regions.

    connectome: all directed cells that aren't 0; labels: node, label. Density is the part of all size * size cells above 0.
    """
    density = connectome.agg((F.sum(F.when(F.col("weight") > 0, 1).otherwise(0)) / F.lit(float(size * size))).alias("density"))
    at = connectome.select(F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), F.col("weight").cast("double").alias("weight"))
    second = at.select((F.col("u") + size).cast("int").alias("u"), (F.col("v") + size).cast("int").alias("v"), "weight")
    m, s = labels.where(F.col("label").isin(*motor)).select(F.col("node").alias("m")), labels.where(F.col("label").isin(*visual)).select(F.col("node").alias("s"))
    link = m.crossJoin(s).crossJoin(density).select("m", "s", (F.col("density") / 100 * c_inter).alias("weight")).where("weight <> 0")
    ways = [(F.col("m"), F.col("s") + size), (F.col("s") + size, F.col("m")), (F.col("s"), F.col("m") + size), (F.col("m") + size, F.col("s"))]
    out = at.unionByName(second)
    for a, b in ways:
        out = out.unionByName(link.select(a.cast("int").alias("u"), b.cast("int").alias("v"), "weight"))
    return out


def edge_stats(edges: DataFrame, key: str) -> DataFrame:
    """Least, greatest and mean value of an edge column by graph; a missing value counts as 0."""
    x = F.coalesce(F.col(key).cast("double"), F.lit(0.0))
    return edges.groupBy("graph_id").agg(F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"))


def adj_matrix(vectors: DataFrame, rows: int, method: int = 1) -> DataFrame:
    """i, j, d for i < j of (id, vector array<double>): Euclid, 1 - cosine or 1 - |Spearman|, rounded to 3 places.

    A distance matrix has all pairs as its result; the graphs of nearest neighbours take `nearest`, which keeps none of them.
    """
    return all_distances(vectors, rows, method)


def mirrored(distances: DataFrame) -> DataFrame:
    """Both directions of i < j rows."""
    return distances.select(F.inline(F.array(F.struct("i", "j", "d"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "d"))))


def _near(distances: DataFrame) -> DataFrame:
    """i, j, d, rank: of `nearest` as they are, of distances i < j both ways."""
    return distances if "rank" in distances.columns else ranked(mirrored(distances))


def nearest_neighbor_graph(distances: DataFrame, k: int = 5, weight: bool = False) -> DataFrame:
    """Undirected edges u < v where either is among the other's k nearest; weight 1, or the distance. Takes distances i < j, or at least k of `nearest`."""
    near = _near(distances).where(F.col("rank") <= k)
    return near.groupBy(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).agg((F.min("d") if weight else F.lit(1.0)).alias("weight"))


def nearest_neighbor_graph_lsh(vectors: DataFrame, k: int = 5, bucket: float = 2.0, tables: int = 8, reach: float = 1e9, seed: int = 7) -> DataFrame:
    """Approximate form for large tables: candidates share a random-projection bucket; inside buckets the search is exact."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.where("vector IS NOT NULL").select("id", "vector", array_to_vector("vector").alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(rows)
    hashed = model.transform(rows).select("id", "vector", F.transform("hashes", lambda h: vector_to_array(h)[0]).alias("buckets"))
    return nearest_neighbor_graph(nearest_in_buckets(hashed, k).where(F.col("d") < reach), k, weight=True)


def sim_graph(distances: DataFrame, nodes: DataFrame, k: int = 5, weight: bool = True) -> DataFrame:
    """Edges from each row of a full distance matrix, or of `nearest`, to its k smallest cells; the diagonal counts, so loops of weight 0 stay."""
    cells = _near(distances).select("i", "j", "d").unionByName(nodes.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d")))
    near = ranked(cells).where(F.col("rank") <= k)
    return near.groupBy(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).agg((F.min("d") if weight else F.lit(1.0)).alias("weight"))


def adaptive_neighborhood(distances: DataFrame, k_min: int = 5, k_max: int = 50) -> DataFrame:
    """i, density, adaptive_k: density 1 / distance to the k_max-th neighbour, scaled to 0..1; k by half-even rounding."""
    far = _near(distances).where(F.col("rank") <= k_max).groupBy("i").agg(F.max("d").alias("far"))
    rho = far.select("i", (1 / F.nullif("far", F.lit(0.0))).alias("rho"))
    ends = rho.agg(F.min("rho").alias("low"), F.max("rho").alias("high"))
    scaled = rho.crossJoin(F.broadcast(ends)).select("i", F.coalesce((F.col("rho") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(0.0)).alias("density"))
    return scaled.select("i", "density", F.bround(k_min + (k_max - k_min) * F.col("density"), 0).cast("int").alias("adaptive_k"))


def adaptive_neighborhood_graph(distances: DataFrame, k_min: int = 5, k_max: int = 50) -> DataFrame:
    """Undirected edges to each row's adaptive_k nearest. The k_max nearest are written once, as they are read three times."""
    found = cut(_near(distances).where(F.col("rank") <= k_max))
    near = found.join(adaptive_neighborhood(found, k_min, k_max), "i").where(F.col("rank") <= F.col("adaptive_k"))
    return near.groupBy(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).agg(F.min("d").alias("weight"))


def symmetrise(edges: DataFrame, how: str = "max") -> DataFrame:
    """graph_id, u, v, weight with one row a pair: max(A, A^T), or (A + A^T) / 2; a missing weight counts as 1."""
    pairs = edges.withColumn("weight", F.coalesce("weight", F.lit(1.0))).groupBy("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    if how == "max":
        return pairs.agg(F.max("weight").alias("weight"))
    total = pairs.agg(F.sum("weight").alias("s"))
    return total.select("graph_id", "u", "v", F.when(F.col("u") == F.col("v"), F.col("s")).otherwise(F.col("s") / 2).alias("weight"))
