"""Reading and writing graph series: Parquet layouts, and converters for array files.

Pickles are never read: unpickling runs what the file says. Arrays come from .npy and .npz with pickling off.
"""

from __future__ import annotations

import io
import json
import tomllib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["dyad", "condition", "curvature"]


def load_config(path: str) -> dict:
    """A TOML file as a dict; for the driver."""
    return tomllib.loads(Path(path).read_text())


def write_edges(edges: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet in folders by keys of few values; graph_id is a column and is sorted, so a reader prunes by its statistics."""
    rows = edges.repartition(*by, "graph_id").sortWithinPartitions(*by, "graph_id") if by else edges.sort("graph_id")
    rows.write.mode("overwrite").partitionBy(*(by or [])).parquet(path)


def load_graph_series(spark: SparkSession, path: str) -> DataFrame:
    """A series that has edges; an empty one is an error."""
    edges = spark.read.parquet(path)
    if edges.isEmpty():
        raise ValueError(f"{path} holds no graph")
    return edges


def load_adjacencies(spark: SparkSession, paths: list[str], weight_key: str = "weight") -> DataFrame:
    """Edges of many Parquet files, graph_id their file names, a missing weight 1."""
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")
    return spark.read.parquet(*paths).select(name.alias("graph_id"), "u", "v", F.coalesce(F.col(weight_key), F.lit(1.0)).alias("weight"))


def node_order(edges: DataFrame) -> DataFrame:
    """graph_id, node, position in ascending order of nodes."""
    ends = edges.select("graph_id", F.explode(F.array("u", "v")).alias("node")).distinct()
    return ends.withColumn("position", F.row_number().over(Window.partitionBy("graph_id").orderBy("node")) - 1)


def missing_ids(spark: SparkSession, expected: list[int], present: DataFrame, width: int = 0) -> DataFrame:
    """Expected ids without a file: names are the id, padded to a width, up to the first underscore."""
    want = spark.createDataFrame([(str(i).zfill(width),) for i in expected], "id string")
    return want.join(present.select(F.split("name", "_")[0].alias("id")).distinct(), "id", "left_anti")


def require_ids(spark: SparkSession, expected: list[int], present: DataFrame, width: int = 0) -> None:
    lost = sorted(r["id"] for r in missing_ids(spark, expected, present, width).collect())
    if lost:
        raise FileNotFoundError(f"no file for {', '.join(lost)}")


def parse_run_ids(rows: DataFrame, column: str = "run") -> DataFrame:
    """Rows whose run id is a number, with it as run_id."""
    return rows.where(F.col(column).rlike("^[0-9]+$")).withColumn("run_id", F.col(column).cast("int"))


def load_connectome(cells: DataFrame) -> DataFrame:
    """u, v, weight, length: (X + X^T) / 2 of both, no diagonal, millimetres to metres; cells (u, v, weight, tract) are directed, a missing one 0."""
    both = cells.unionByName(cells.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight", "tract"))
    return both.where("u <> v").groupBy("u", "v").agg((F.sum("weight") / 2).alias("weight"), (F.sum("tract") / 2 / 1000).alias("length"))


def read_arrays(spark: SparkSession, path: str, key: str = "phases") -> DataFrame:
    """name, axis indices as array<int>, value of .npy and .npz files; of an .npz the array `key`, or its first."""

    def run(frames):
        for pdf in frames:
            for name, raw in zip(pdf["path"], pdf["content"]):
                if not name.endswith((".npy", ".npz")):
                    raise ValueError(f"{name}: only .npy and .npz are read")
                got = np.load(io.BytesIO(raw), allow_pickle=False)
                a = got if isinstance(got, np.ndarray) else got[key if key in got.files else got.files[0]]
                at = np.stack(np.unravel_index(np.arange(a.size), a.shape), 1).astype(np.int32)
                for i in range(0, a.size, 50_000):
                    yield pd.DataFrame({"name": name.rpartition("/")[2], "at": list(at[i : i + 50_000]), "value": a.ravel()[i : i + 50_000].astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "name string, at array<int>, value double")


def array_signal(arrays: DataFrame) -> DataFrame:
    """signal of 2-d arrays (channel, t): name is the run."""
    return arrays.select(F.col("name").alias("run"), F.element_at("at", 1).alias("channel"), F.element_at("at", 2).cast("long").alias("t"), F.col("value").alias("phase"))


def array_cells(arrays: DataFrame) -> DataFrame:
    """Cells of 2-d matrices or of stacks of them; graph_id is the name, and the index in the stack behind it."""
    n = F.size("at")
    stack = F.when(n > 2, F.concat(F.lit("/"), F.format_string("%06d", F.element_at("at", 1)))).otherwise("")
    return arrays.select(F.concat("name", stack).alias("graph_id"), F.element_at("at", n - 1).alias("i"), F.element_at("at", n).alias("j"), "value")


def temporal_tensor(cells: DataFrame) -> DataFrame:
    """Adds frame, the rank of graph_id."""
    names = cells.select("graph_id").distinct().withColumn("frame", F.row_number().over(Window.orderBy("graph_id")) - 1)
    return cells.join(names, "graph_id")


def reshape_tensor(cells: DataFrame, windows: int = 4) -> DataFrame:
    """k (trial and window in one) as trial and window, and the absolute value."""
    return cells.select("*", F.floor(F.col("k") / windows).cast("int").alias("trial"), F.pmod(F.col("k"), F.lit(windows)).cast("int").alias("window")).withColumn("value", F.abs("value"))


def layout(path: str, dyad: str, condition: str, curvature: str) -> str:
    """Where a dyad's results lie under `path`."""
    return f"{path}/dyad={dyad}/condition={condition}/curvature={curvature}"


def load_results(spark: SparkSession, path: str, curvature: str) -> DataFrame:
    """Results of all dyads and conditions that are there; Spark reads this curvature's folders alone."""
    return spark.read.parquet(path).where(F.col("curvature") == curvature)


def save_json(rows: DataFrame, path: str) -> None:
    """A report's few rows as one JSON file, by the driver; more than 10,000 are an error."""
    found = rows.toJSON().take(10_001)
    if len(found) > 10_000:
        raise ValueError("a report has at most 10,000 rows")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps([json.loads(x) for x in found], indent=2))


def save_centrality(table: DataFrame, path: str) -> None:
    """A folder for each graph, named by graph_id up to its first underscore."""
    table.withColumn("prefix", F.split("graph_id", "_")[0]).write.mode("overwrite").partitionBy("prefix").option("header", True).csv(path)
