"""Phase locking over event time: PLV is two additive sums, so a window's state is three numbers a channel pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_sums(samples: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    """window, u, v, re, im, n of stream rows (ts timestamp, phases array<struct<channel int, phase double>>), a row a sample; late rows within `delay` count."""
    at = samples.withWatermark("ts", delay).select("ts", F.explode("phases").alias("a"), "phases").select("ts", "a", F.explode("phases").alias("b")).where("a.channel < b.channel")
    d = F.col("a.phase") - F.col("b.phase")
    return at.groupBy(F.window("ts", size, slide), F.col("a.channel").alias("u"), F.col("b.channel").alias("v")).agg(F.sum(F.cos(d)).alias("re"), F.sum(F.sin(d)).alias("im"), F.count("*").alias("n"))


def windowed_plv(samples: DataFrame, size: str = "10 seconds", slide: str = "5 seconds", delay: str = "5 seconds", complete: int | None = None) -> DataFrame:
    """start, u, v, plv; with `complete`, only windows of at least so many samples: window() also makes those at the ends."""
    s = windowed_sums(samples, size, slide, delay)
    s = s if complete is None else s.where(F.col("n") >= complete)
    return s.select(F.col("window.start").alias("start"), "u", "v", (F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")).alias("plv"))
