"""Sessions, shared folders and cuts of lineage."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """df from the shared checkpoint folder: its lineage ends there, and a lost executor re-reads it.

    The session's spark.checkpoint.dir is used; a temporary folder only where it is unset and the session is local.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder")
            if not _own:
                folder = tempfile.TemporaryDirectory(prefix="curvelake-", ignore_cleanup_errors=True)
                atexit.register(folder.cleanup)
                _own.append(folder.name)
            at = _own[0]
        sc.setCheckpointDir(at)
    return df.checkpoint()
