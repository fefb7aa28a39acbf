"""Graphs, signals and long tables built from the relational tables of a data folder.

They stand in for recorded data: a year's or quarter's trade between nations is a windowed weighted graph, hourly sums of events by
type are signals, and orders by nation, priority, quarter and month are trials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _trade(spark: SparkSession, folder: str, window: Column) -> DataFrame:
    """graph_id, c, s, n: line items by customer's and supplier's nation.

    Items are counted by order and supplier before the joins with the small sides, whose broadcast Catalyst decides by size.
    """
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", window.alias("graph_id"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    at = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return at.groupBy("graph_id", F.col("c_nationkey").alias("c"), F.col("s_nationkey").alias("s")).agg(F.count("*").cast("double").alias("n"))


def year() -> Column:
    return F.year("l_shipdate").cast("string")


def quarter() -> Column:
    return F.concat(F.year("l_shipdate").cast("string"), F.lit("Q"), F.quarter("l_shipdate").cast("string"))


def trade_edges(spark: SparkSession, folder: str, window: str = "year") -> DataFrame:
    """edges with loops: graph_id "1995" or "1995Q1", u <= v, weight the number of items."""
    t = _trade(spark, folder, year() if window == "year" else quarter())
    return t.groupBy("graph_id", F.least("c", "s").alias("u"), F.greatest("c", "s").alias("v")).agg(F.sum("n").alias("weight"))


def dyad_cells(spark: SparkSession, folder: str) -> DataFrame:
    """All cells (graph_id, i, j, value) of yearly 50 x 50 matrices: customer nations 0-24, supplier nations 25-49, scaled trade across, 0 within a side."""
    t = _trade(spark, folder, year()).select("graph_id", F.col("c").alias("i"), (F.col("s") + 25).alias("j"), "n")
    most = t.groupBy("graph_id").agg(F.max("n").alias("most"))
    t = t.join(most, "graph_id").select("graph_id", "i", "j", (F.col("n") / F.col("most")).alias("value"))
    both = t.unionByName(t.select("graph_id", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    axis = spark.range(50).select(F.col("id").cast("int").alias("k"))
    grid = t.select("graph_id").distinct().crossJoin(F.broadcast(axis.select(F.col("k").alias("i")))).crossJoin(F.broadcast(axis.select(F.col("k").alias("j"))))
    return grid.join(both, ["graph_id", "i", "j"], "left").select("graph_id", "i", "j", F.coalesce("value", F.lit(0.0)).alias("value"))


EVENT_TYPES = ("cart", "click", "login", "purchase", "view")


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """run, channel, t, x: sums of value by hour t since the first event and by type, channels in order of their names."""
    events = table(spark, folder, "events").select("event_type", "value", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"))
    first = events.agg(F.min("h").alias("h0"))
    names = events.select("event_type").distinct()
    channels = names.join(names.withColumnRenamed("event_type", "other"), F.col("other") < F.col("event_type"), "left").groupBy("event_type").agg(F.count("other").cast("int").alias("channel"))
    at = events.crossJoin(F.broadcast(first)).join(F.broadcast(channels), "event_type")
    t = ((F.unix_timestamp("h") - F.unix_timestamp("h0")) / 3600).cast("long")
    return at.groupBy("channel", t.alias("t")).agg(F.sum("value").alias("x")).select(F.lit("events").alias("run"), "channel", "t", "x")


def hours(spark: SparkSession, folder: str) -> int:
    """Hours from the first event to the last, both included."""
    h = table(spark, folder, "events").select(F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("h"))
    low, high = h.agg(F.min("h"), F.max("h")).first()
    return 1 if low is None else (high - low) // 3600 + 1


def phases(spark: SparkSession, folder: str) -> DataFrame:
    """signal of a sample an hour by channel, up to the last event of all: phase = atan2(x_t - x_{t-1}, x_t - mean), a missing hour 0."""
    x, n = hourly(spark, folder), hours(spark, folder)
    grid = x.select("run", "channel").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("t")).withColumn("t", F.col("t").cast("long"))
    full = grid.join(x, ["run", "channel", "t"], "left").select("run", "channel", "t", F.coalesce("x", F.lit(0.0)).alias("x"))
    before = full.select("run", "channel", (F.col("t") + 1).alias("t"), F.col("x").alias("b"))
    mean = full.groupBy("run", "channel").agg(F.avg("x").alias("m"))
    at = full.join(before, ["run", "channel", "t"], "left").join(mean, ["run", "channel"])
    return at.select("run", "channel", "t", F.atan2(F.col("x") - F.coalesce("b", "x"), F.col("x") - F.col("m")).alias("phase"), "x")


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """long: dyad customer nation, condition order status, freq quarter, trial year and month, window priority, value log10 of the mean order price."""
    o = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    by = [F.col("c_nationkey").alias("dyad"), F.col("o_orderstatus").alias("condition"), F.quarter("o_orderdate").alias("freq"), (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("trial"), F.substring("o_orderpriority", 1, 1).cast("int").alias("window")]
    return o.groupBy(*by).agg(F.round(F.log10(F.avg("o_totalprice")), 6).alias("value"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """id, vector array<double>, label of the embeddings."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.expr("transform(embedding, x -> CAST(x AS DOUBLE))").alias("vector"), "label")
