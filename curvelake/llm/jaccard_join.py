"""Exact Jaccard self-join of shingle sets through R-trees of count vectors.

1. Sets. A text's shingles are hashed; equal sets share a 128-bit digest and are one class from here on. A class goes by the row of its
   least document, and only that row's text is read further.
2. Buckets. Two sets with Jaccard t or more share a shingle among the first n - ceil(t n) + 1 of each, in any common
   order of shingles. A table of fixed size counts all shingles by hash, so that the order puts frequent ones, as of passages that
   many texts share, last. Classes that share such a shingle are a bucket; buckets of the same classes are one.
3. R-tree. A set's shingles, hashed to groups, are a point of counts. A bucket's points are split at the median of their widest coordinate
   (a group's count or the size) down to leaves, and leaves are put under inner nodes up to one root. A node keeps the largest count by
   coordinate and the range of sizes; the sum of coordinate minima with a query bounds the overlap with any point below. A query descends from
   the root. Pairs that survive join candidate groups. A node whose points all belong to the query's group already is passed over, so
   a cluster of near copies costs an edge each and not all its pairs.
4. Verification. Only the texts of candidate groups are read again. The same tree finds the pairs of a group, and their shingles are
   intersected, again but for pairs that are in one component already.
5. Buckets and groups beyond a task's share: in salted parts each member first meets a few pivots of its group and takes the label of one
   that it links with. Members are then dealt into blocks by label, and each pair of blocks is one task but those of one label, which
   need no further link. A cluster of near copies of any size is thus one pass, and the rest is exact at any size.
6. Links make components; the least doc_id names each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared, textvec, tokens
from .components import components

SHINGLE, NUMERATOR, DENOMINATOR = 4, 85, 100
GROUPS, LEAF, FAN = 256, 16, 8
#: Sets of more shingles than FINE_FROM have points of FINE groups, a multiple of GROUPS: the more shingles a group has, the looser the bound.
FINE, FINE_FROM = 1024, 768
#: Counters of the table that orders shingles.
ORDER_BITS, SLICE = 18, 1 << 14
#: Shingles of a candidate group, and classes of a bucket, that one task holds; larger ones are dealt into blocks of half of it.
TASK_SHINGLES, TASK_CLASSES = 2_000_000, 20_000
#: Members of a larger group that all its others meet first.
PIVOTS = 4
NO_ID = shared.NO_ID
_SECOND = np.uint64(0x2545F4914F6CDD1D)


def lowered(x: textvec.Texts) -> textvec.Texts:
    return textvec.Texts(textvec.LOWER[x.raw], x.ends)


def shingle_sets(x: textvec.Texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of each document, end to end, and where each begins."""
    w = lowered(x).words()
    h = w.hashes()
    g = textvec.windows(h, k)
    at = np.flatnonzero(textvec.inside(w.docs, k, len(g)))
    n = w.counts()
    doc, found = w.doc()[at], g[at]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            have = n[short] > j
            whole[have] = textvec.mix(textvec.mix(whole[have]) + h[w.docs[short[have]] + j])
        doc, found = np.concatenate([doc, short]), np.concatenate([found, textvec.mix(whole ^ n[short].astype(np.uint64))])
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    new = np.append(True, (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
    return found[new], np.searchsorted(doc[new], np.arange(len(x) + 1))


def least_overlap(n: np.ndarray | int, m: int, num: int = NUMERATOR, den: int = DENOMINATOR):
    """The least intersection of sets of n and m elements that link: den * i >= num * (n + m - i)."""
    return -(-num * (n + m) // (num + den))


def prefix_length(n: np.ndarray, num: int = NUMERATOR, den: int = DENOMINATOR) -> np.ndarray:
    """How many of a set's n shingles, in any common order, must meet those of a set that links."""
    return n - -(-num * n // den) + 1


_SETS = "row long, doc long, n_shingles long, s1 long, s2 long, slice int, counts binary"


def _sets(k: int):
    """A row for each document; at a task's end its part of the order table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        table = np.zeros(1 << ORDER_BITS, np.int64)
        names = ["row", "doc", "n_shingles", "s1", "s2", "slice", "counts"]
        for batch in batches:
            rows, ids = batch.column("row"), batch.column("doc")
            for lo, hi, x in textvec.slices(batch):
                g, at = shingle_sets(x, k)
                table += np.bincount((g >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=1 << ORDER_BITS)
                s = [digests(g, at, c).view(np.int64) for c in (np.uint64(0), _SECOND)]
                yield pa.RecordBatch.from_arrays([rows.slice(lo, hi - lo), ids.slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), pa.array(s[0]), pa.array(s[1]), pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())], names=names)
        if table.any():
            n = len(table) // SLICE
            parts = pa.array([x.astype("<u4").tobytes() for x in table.reshape(n, SLICE)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * 5, pa.array(range(n), pa.int32()), parts], names=names)

    return run


def digests(g: np.ndarray, at: np.ndarray, salt: np.uint64) -> np.ndarray:
    sums = textvec.prefix(textvec.mix(g ^ salt))
    return textvec.mix((sums[at[1:]] - sums[at[:-1]]) ^ textvec.mix(np.diff(at).astype(np.uint64) ^ salt))


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the parts of a slice, as they come in."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, x in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            total[i] = total.get(i, 0) + np.frombuffer(x, "<u4").astype(np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])


def order_table(parts: DataFrame) -> np.ndarray:
    """How often each bucket of shingles occurs: a table of fixed size, which the driver gets in slices."""
    table = np.zeros((1 << ORDER_BITS) // SLICE * SLICE, np.int64).reshape(-1, SLICE)
    for r in parts.repartition("slice").mapInArrow(tokens.tidy(_add), "slice int, counts binary").collect():
        table[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(table.reshape(-1), 2**32 - 1).astype(np.uint32)


def points(g: np.ndarray, at: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The count vector of each set."""
    n = len(at) - 1
    cell = np.repeat(np.arange(n) * groups, np.diff(at)) + (g % np.uint64(groups)).astype(np.int64)
    return np.bincount(cell, minlength=n * groups).reshape(n, groups)


def packed(g: np.ndarray) -> bytes:
    """The point of a set: the bytes of a count, then the counts."""
    point = points(g, np.array([0, len(g)]), FINE if len(g) > FINE_FROM else GROUPS)[0]
    kind = np.min_scalar_type(int(point.max(initial=0)))
    return bytes([kind.itemsize]) + point.astype(kind).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int32)


def folded(point: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """A point of fewer groups."""
    return point.reshape(-1, groups).sum(0)


def _prefixes(k: int, num: int, den: int, sent):
    """Each class's rarest shingles, and its point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names = sent.value, ["key", "node", "point"]
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for lo, hi, x in textvec.slices(batch):
                g, at = shingle_sets(x, k)
                n, own = np.diff(at), nodes[lo:hi]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(own), pa.array([packed(g[a:b]) for a, b in zip(at, at[1:])], pa.binary())], names=names)
                doc = np.repeat(np.arange(len(n)), n)
                rank = table[(g >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
                order = np.lexsort((g, rank, doc))
                doc, g = doc[order], g[order]
                place = np.arange(len(g)) - np.searchsorted(doc, doc)
                first = place < prefix_length(n, num, den)[doc]
                key, node = g[first].view(np.int64), own[doc[first]]
                for a in range(0, len(key), 50_000):
                    part = pa.array(key[a : a + 50_000])
                    yield pa.RecordBatch.from_arrays([part, pa.array(node[a : a + 50_000]), pa.nulls(len(part), pa.binary())], names=names)

    return run


def tiles(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Points in spatial order: each part is split at the median of its widest coordinate until it is a leaf."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        part = todo.pop()
        if len(part) <= leaf:
            out.append(part)
            continue
        p = points[part]
        wide = int((p.max(0) - p.min(0)).argmax())
        order = part[np.argsort(p[:, wide], kind="stable")]
        # Halves that fill whole leaves.
        cut = max(leaf, -(-len(part) // (2 * leaf)) * leaf)
        todo += [order[cut:], order[:cut]]
    return out


class CountTree:
    """R-tree of points, packed from the leaves up; the last coordinate of a point inside is its size."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> None:
        self.points, self.size = points, points.sum(1)
        self.leaves = tiles(np.column_stack([points, self.size]), leaf) if len(points) else []
        self.leaf_of = np.empty(len(points), np.int64)
        for i, x in enumerate(self.leaves):
            self.leaf_of[x] = i
        most = np.array([points[x].max(0) for x in self.leaves])
        low, high = (np.array([f(self.size[x]) for x in self.leaves]) for f in (np.min, np.max))
        #: From the leaves to the root: largest counts, least and greatest size of each node. A node's children are `fan` in a row.
        self.levels = [(most, low, high)]
        self.fan, self.visited = fan, 0
        while len(low) > 1:
            at = np.arange(0, len(low), fan)
            most, low, high = np.maximum.reduceat(most, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((most, low, high))

    def near(self, point: np.ndarray, n: int, skip: np.ndarray, num: int, den: int) -> np.ndarray:
        """Points that may overlap enough with a set of n shingles, from the root down; skip: by leaf, whether to pass it over."""
        nodes = np.zeros(1 if self.leaves else 0, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            most, low, high = self.levels[depth]
            if depth == 0:
                nodes = nodes[~skip[nodes]]
            self.visited += len(nodes)
            nodes = nodes[(den * high[nodes] >= num * n) & (num * low[nodes] <= den * n)]
            bound = np.minimum(most[nodes], point).sum(1)
            nodes = nodes[bound >= least_overlap(np.maximum(low[nodes], -(-num * n // den)), n, num, den)]
            if depth:
                nodes = (nodes[:, None] * self.fan + np.arange(self.fan)).reshape(-1)
                nodes = nodes[nodes < len(self.levels[depth - 1][1])]
        if not len(nodes):
            return nodes
        at = np.concatenate([self.leaves[i] for i in nodes.tolist()])
        at = at[(den * self.size[at] >= num * n) & (num * self.size[at] <= den * n)]
        return at[np.minimum(self.points[at], point).sum(1) >= least_overlap(self.size[at], n, num, den)]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def forest(left: np.ndarray, right: np.ndarray | None, linked: Callable[[int, int], bool], num: int = NUMERATOR, den: int = DENOMINATOR) -> list[tuple[int, int]]:
    """Of the pairs of points, within left or between left and right, that the tree leaves and `linked` accepts: a forest with their components."""
    tree, n = CountTree(left if right is None else right), len(left)
    base = 0 if right is None else n
    label = np.arange(base + len(tree.points))
    pure = np.array([label[base + x[0]] if len(x) == 1 else -1 for x in tree.leaves])
    sizes, out = left.sum(1).tolist(), []
    for q in range(n):
        found = tree.near(left[q], sizes[q], pure == label[q], num, den)
        found = found[label[base + found] != label[q]]
        while len(found):
            j, found = int(found[0]), found[1:]
            if not linked(q, j):
                continue
            out.append((q, j))
            old, new = int(label[base + j]), int(label[q])
            members = np.flatnonzero(label == old)
            label[members] = new
            for i in np.unique(tree.leaf_of[members[members >= base] - base]).tolist():
                kinds = label[base + tree.leaves[i]]
                pure[i] = kinds[0] if (kinds == kinds[0]).all() else -1
            pure[pure == old] = new
            found = found[label[base + found] != new]
    return out


def links(left: list[np.ndarray], right: list[np.ndarray] | None, num: int = NUMERATOR, den: int = DENOMINATOR) -> list[tuple[int, int]]:
    """A forest with the components of all links of shingle sets, within left or between left and right."""
    other = left if right is None else right

    def linked(q: int, j: int) -> bool:
        i = overlap(left[q], other[j])
        return den * i >= num * (len(left[q]) + len(other[j]) - i)

    def at(sets: list[np.ndarray]) -> np.ndarray:
        return points(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets]))).astype(np.int32)

    return forest(at(left), None if right is None else at(right), linked, num, den)


def may_link(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    n, m, groups = int(a.sum()), int(b.sum()), min(len(a), len(b))
    a, b = folded(a, groups), folded(b, groups)
    return den * min(n, m) >= num * max(n, m) and int(np.minimum(a, b).sum()) >= least_overlap(n, m, num, den)


class Bound:
    """Candidates: sets are known by their points, and what the bound leaves is linked."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def read(self, batch: pa.RecordBatch) -> list:
        return [unpacked(p) for p in batch.column("point").to_pylist()]

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        return may_link(a, b, self.num, self.den)

    def forest(self, left: list, right: list | None) -> list[tuple[int, int]]:
        if right is None and len(left) == 2:
            return [(0, 1)] if self.linked(*left) else []
        other = left if right is None else right
        plain = [None if x is None else np.array([folded(p) for p in x]) for x in (left, right)]
        return forest(*plain, lambda q, j: len(left[q]) == GROUPS or len(other[j]) == GROUPS or self.linked(left[q], other[j]), self.num, self.den)


class Exact:
    """Links: sets are the shingles of whole texts."""

    def __init__(self, k: int, num: int, den: int) -> None:
        self.k, self.num, self.den = k, num, den

    def read(self, batch: pa.RecordBatch) -> list:
        out = []
        for _, _, x in textvec.slices(batch):
            g, at = shingle_sets(x, self.k)
            out += [g[a:b].copy() for a, b in zip(at, at[1:])]
        return out

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        i = overlap(a, b)
        return self.den * i >= self.num * (len(a) + len(b) - i)

    def forest(self, left: list, right: list | None) -> list[tuple[int, int]]:
        return links(left, right, self.num, self.den)


def _pairs(out: set | list) -> Iterator[pa.RecordBatch]:
    out = list(out)
    for a in range(0, len(out), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[a : a + 50_000])], names=["a", "b"])


def _solve(kind: Bound | Exact):
    """Rows ordered by group and pair of blocks; of each such task the links, within a block or between two, as a forest."""

    def solve(nodes: tuple[list, list], sets: tuple[list, list], within: bool) -> list[tuple[int, int]]:
        if not sets[0] or not (within or sets[1]):
            return []
        return [(nodes[0][a], nodes[not within][b]) for a, b in kind.forest(sets[0], None if within else sets[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets, out = None, ([], []), ([], []), set()
        for batch in batches:
            for *key, node, side, value in zip(*(batch.column(c).to_pylist() for c in ("grp", "i", "j", "node", "side")), kind.read(batch)):
                if key != now:
                    if now:
                        out.update(solve(nodes, sets, now[1] == now[2]))
                    now, nodes, sets = key, ([], []), ([], [])
                nodes[side].append(node)
                sets[side].append(value)
        if now:
            out.update(solve(nodes, sets, now[1] == now[2]))
        yield from _pairs(out)

    return run


def _meet(kind: Bound | Exact):
    """Rows ordered by group and salt, pivots first: the first pivot that each member links with, a pivot's own first one or itself, and as
    label the pivot that stands for it and those linked with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivots = None, []
        for batch in batches:
            out = []
            for *key, node, weight, pivot, value in zip(*(batch.column(c).to_pylist() for c in ("grp", "salt", "node", "weight", "pivot")), kind.read(batch)):
                if key != now:
                    now, pivots = key, []
                hit = next(((p, label) for p, v, label in pivots if p != node and kind.linked(v, value)), (None, None))
                if pivot:
                    pivots.append((node, value, node if hit[0] is None else hit[1]))
                else:
                    own = next((label for p, _, label in pivots if p == node), None)
                    out.append((key[0], node, weight, hit[0], hit[1] if own is None else own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["grp", "node", "weight", "pivot", "label"])

    return run


def linked(ws: shared.Workspace, name: str, members: DataFrame, payload: DataFrame, limit: int, kind: Bound | Exact) -> DataFrame:
    """Links (a, b) with the components of each group's members. members: grp, node, weight, load (its group's weight); payload: node and
    what `kind` reads. A group of at most `limit` is one task; larger ones meet pivots, then are dealt into pairs of blocks."""
    payload = payload.hint("shuffle_hash") if "point" in payload.columns else payload
    value = payload.columns[1]
    small = members.where(F.col("load") <= limit).join(payload, "node").select("grp", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", F.lit(0).alias("side"), value)
    found = ws.write(small.repartition("grp").sortWithinPartitions("grp").mapInArrow(tokens.tidy(_solve(kind)), "a long, b long"), name)
    large = members.where(F.col("load") > limit)
    if large.isEmpty():
        return found
    h = F.xxhash64("node")
    least = large.groupBy("grp").agg(F.max("load").alias("load"), *(F.min(F.when(F.pmod(h, F.lit(PIVOTS)) == p, F.struct(h, "node"))).alias(f"p{p}") for p in range(PIVOTS)))
    salts = F.ceil(2 * F.col("load") / limit).cast("int")
    each = F.explode(F.sequence(F.lit(0), salts - 1))
    pivots = least.select("grp", each.alias("salt"), F.explode(F.array(*(F.col(f"p{p}.node") for p in range(PIVOTS)))).alias("node"))
    pivots = pivots.where("node is not null").select("grp", "salt", "node", F.lit(0).cast("long").alias("weight"), F.lit(True).alias("pivot"))
    met = large.select("grp", F.pmod(F.xxhash64("node", F.lit(1)), salts).cast("int").alias("salt"), "node", "weight", F.lit(False).alias("pivot"))
    met = met.union(pivots).join(payload, "node").repartition("grp", "salt").sortWithinPartitions("grp", "salt", F.desc("pivot"), "node")
    met = ws.write(met.mapInArrow(tokens.tidy(_meet(kind)), "grp long, node long, weight long, pivot long, label long"), f"{name}-met")
    share = met.groupBy("grp", "label").agg(F.ceil(2 * F.sum("weight") / limit).cast("int").alias("blocks"))
    same = met.alias("m").join(share.alias("s"), (F.col("m.grp") == F.col("s.grp")) & F.col("m.label").eqNullSafe(F.col("s.label")))
    dealt = ws.write(same.select("m.grp", "m.node", "m.label", F.pmod(F.xxhash64("m.node", F.lit(2)), F.col("blocks")).cast("int").alias("part")), f"{name}-dealt")
    blocks = dealt.groupBy("grp", "label", "part").agg(F.min("node").alias("block"))
    both = blocks.alias("x").join(blocks.alias("y"), "grp").where("x.block <= y.block and (x.label <=> y.label) = (x.label is null and y.label is null)")
    tasks = both.select("grp", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    ends = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", F.lit(0).alias("side")))).otherwise(F.array(F.struct("i", F.lit(0).alias("side")), F.struct(F.col("j").alias("i"), F.lit(1).alias("side"))))
    tasks = tasks.select("grp", F.col("i").alias("ti"), F.col("j").alias("tj"), F.inline(ends)).select("grp", "ti", "tj", F.col("i").alias("block"), "side")
    placed = dealt.alias("d").join(blocks.alias("b"), (F.col("d.grp") == F.col("b.grp")) & F.col("d.label").eqNullSafe(F.col("b.label")) & (F.col("d.part") == F.col("b.part"))).select("d.grp", "d.node", "b.block")
    rows = placed.join(tasks, ["grp", "block"]).join(payload, "node").select("grp", F.col("ti").alias("i"), F.col("tj").alias("j"), "node", "side", value)
    rest = ws.write(rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(tokens.tidy(_solve(kind)), "a long, b long"), f"{name}-rest")
    ws.drop(f"{name}-dealt")
    labels = met.where("pivot is not null").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    return found.union(rest).union(labels)


def _classed(docs: shared.Numbered, k: int, num: int, den: int, task_shingles: int, task_classes: int) -> DataFrame:
    """row, doc, n_shingles, and doc and row of the least document of its component, of every row."""
    ws, spark = docs.ws, docs.table.sparkSession
    sets = ws.write(docs.texts().mapInArrow(tokens.tidy(_sets(k)), _SETS), "sets")
    table = order_table(sets.where("counts is not null").select("slice", "counts"))
    sets = sets.where("counts is null").select("row", "doc", "n_shingles", "s1", "s2")
    least = F.min(F.struct("doc", "row"))
    classes = sets.where("n_shingles > 0").groupBy("s1", "s2").agg(least.alias("keeper"), F.max("n_shingles").alias("n"))
    classes = ws.write(classes.select("s1", "s2", "keeper.doc", F.col("keeper.row").alias("node"), "n"), "classes")
    texts = docs.found(classes.select(F.col("node").alias("row")), "class-rows", docs.texts()).select(F.col("row").alias("node"), "text")

    sent = spark.sparkContext.broadcast(table)
    prefixes = ws.write(texts.mapInArrow(tokens.tidy(_prefixes(k, num, den, sent)), "key long, node long, point binary"), "prefixes")
    keyed = prefixes.where("key is not null").select("key", "node")
    repeats = keyed.groupBy("key").count().where("count > 1").select("key").hint("merge")
    repeated = ws.write(keyed.join(repeats, "key"), "repeated")
    # Hashes of its classes, two of them, name a bucket's set of classes.
    same = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in (0, 1)]
    buckets = repeated.groupBy("key").agg(F.count("*").alias("n"), *same)
    buckets = buckets.withColumn("bucket", F.min("key").over(Window.partitionBy("n", "h0", "h1"))).where("key = bucket").select("key", "n").hint("merge")
    members = ws.write(repeated.join(buckets, "key").select(F.col("key").alias("grp"), "node", F.lit(1).cast("long").alias("weight"), F.col("n").alias("load")), "buckets")
    point = prefixes.where("point is not null").select("node", "point").join(members.select("node").distinct().hint("shuffle_hash"), "node", "left_semi")
    point = ws.write(point, "points")
    ws.drop("prefixes", "repeated", "class-rows")
    may = linked(ws, "may", members, point, task_classes, Bound(num, den))
    groups = components(may, ws, "candidates")
    ws.drop("points", "buckets", "may", "may-met", "may-rest")

    grouped = groups.join(classes.select("node", F.col("n").alias("weight")), "node")
    load = grouped.groupBy("component").agg(F.sum("weight").alias("load"))
    grouped = ws.write(grouped.join(load, "component").select(F.col("component").alias("grp"), "node", "weight", "load"), "groups")
    texts = docs.found(grouped.select(F.col("node").alias("row")), "group-rows", docs.texts()).select(F.col("row").alias("node"), "text")
    found = linked(ws, "links", grouped.hint("shuffle_hash"), texts, task_shingles, Exact(k, num, den))
    joined = components(found, ws, "joined")
    ws.drop("group-rows", "groups", "links", "links-met", "links-rest")
    named = joined.join(classes.select("node", "doc"), "node")
    names = named.groupBy("component").agg(F.min(F.struct("doc", F.col("node").alias("row"))).alias("least"))
    named = named.join(names, "component").select("node", "least")
    classed = classes.join(named, "node", "left").select("s1", "s2", F.coalesce("least", F.struct("doc", F.col("node").alias("row"))).alias("least"))
    out = sets.join(ws.write(classed, "classed"), ["s1", "s2"], "left")
    ws.drop("classes")
    alone = F.col("n_shingles") == 0
    return out.select("row", "doc", "n_shingles", *(F.when(alone, F.col(c)).otherwise(F.col(f"least.{c}")).alias(f"least_{c}") for c in ("doc", "row")))


def jaccard_components(docs: DataFrame, k: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR, task_shingles: int = TASK_SHINGLES, task_classes: int = TASK_CLASSES) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs; documents link at Jaccard num / den or more.

    A-Z are lower-cased; words are `[^\x20\x09-\x0D]+`, shingles k words, or all of fewer. A null or empty text, or one without words, has no shingles
    and is linked with nothing. A null doc_id sorts behind all others; a component of such rows alone has a null id.
    Rows that repeat a text are linked, also those that repeat a doc_id. Long texts are handled whole. Columns beside doc_id and text are
    ignored; an empty table gives an empty result.
    """
    rows, doc, text = shared.unnamed(docs)
    numbered = shared.Numbered(shared.Workspace(docs.sparkSession, "jaccard"), rows.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")))
    out = _classed(numbered, k, num, den, task_shingles, task_classes)
    numbered.drop()
    no = F.lit(NO_ID)
    return out.select(F.nullif("doc", no).alias("doc_id"), "n_shingles", F.nullif("least_doc", no).alias("component_id"))


def near_dedup(docs: DataFrame, k: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR, task_shingles: int = TASK_SHINGLES, task_classes: int = TASK_CLASSES) -> DataFrame:
    """Of the rows of docs, all columns, one of each component: that of the least doc_id, any one of its rows if several have that.

    Null and repeated doc_ids, null, empty and long texts are as in jaccard_components: rows without a word are linked with nothing and stay.
    """
    numbered = shared.Numbered(shared.Workspace(docs.sparkSession, "jaccard"), docs)
    out = numbered.kept(_classed(numbered, k, num, den, task_shingles, task_classes).where("row = least_row").select("row"))
    numbered.ws.drop("sets", "classed")
    return out
