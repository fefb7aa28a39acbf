"""Connected components of an edge table by least-label propagation with pointer jumping, in shared tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, tokens

#: Edges that a task joins at once before it sends them on.
LOCAL_EDGES = 500_000


def roots(edges: Iterator[tuple[int, int]]) -> dict[int, int]:
    """The least node that each node reaches."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        y = x
        while up[y] != y:
            y = up[y]
        while up[x] != y:
            up[x], x = y, up[x]
        return y

    for a, b in edges:
        up.setdefault(a, a)
        up.setdefault(b, b)
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, a share at a time, as stars around the least node of each of their components."""
    share: list[tuple[int, int]] = []

    def sent() -> Iterator[pa.RecordBatch]:
        found = [(x, y) for x, y in roots(iter(share)).items() if x != y]
        share.clear()
        for k in range(0, len(found), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[k : k + 50_000])], names=["a", "b"])

    for batch in batches:
        share += zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())
        if len(share) > LOCAL_EDGES:
            yield from sent()
    yield from sent()


def components(edges: DataFrame, ws: shared.Workspace, name: str = "components") -> DataFrame:
    """node and component, the least node that its links reach, of every node of the edges (a, b), both long.

    Each task first joins the edges that it has, whole for a bounded share of them. A round then gives each node the least label of its
    neighbours and its own, then the label of that label. Labels only fall, and a chain's length halves in a round, so rounds grow with the
    logarithm of the longest chain. Each round's table is written to the shared folder, which cuts the lineage; partial minima
    leave one row for a hot node and task.
    """
    stars = edges.select("a", "b").where("a <> b").mapInArrow(tokens.tidy(_stars), "a long, b long")
    both = ws.write(stars.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct(), f"{name}-edges")
    labels = ws.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        now = low.join(up, "low").select("node", F.least("low", "up").alias("label"), (F.least("low", "up") < F.col("label")).alias("fell"))
        now = ws.write(now, f"{name}-{k}")
        done = now.where("fell").isEmpty()
        ws.drop(f"{name}-{k - 1}")
        labels = now.select("node", "label")
        if done:
            ws.drop(f"{name}-edges")
            return labels.withColumnRenamed("label", "component")
