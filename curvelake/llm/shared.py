"""Tables in the shared folder that the session names in spark.checkpoint.dir.

An operator that needs a result twice writes it there once as Parquet through Spark's committer, so a
lost executor costs a re-read and never a recomputation of the whole lineage. Where the setting is
unset (tests in local mode) a temporary folder takes its place.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens

_own: list[str] = []
#: A null doc_id inside an operator: it sorts behind all others.
NO_ID = 2**63 - 1
_CLEANUP, _BATCH, BATCH_BYTES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def root(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        folder = tempfile.TemporaryDirectory(prefix="curvelake-", ignore_cleanup_errors=True)
        atexit.register(folder.cleanup)
        _own.append("file://" + folder.name)
    return _own[0]


class Workspace:
    """A folder of intermediate tables; what is not dropped earlier goes when the driver's Python ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """df as a table; the shuffle files of its making go with the write."""
        to = f"{self.path}/{name}"
        self.cleaned(lambda: df.write.option("compression", codec).parquet(to))
        return self.spark.read.schema(df.schema).parquet(to)

    def cleaned(self, job: Callable[[], None]) -> None:
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            job()
        finally:
            self.spark.conf.set(_CLEANUP, before)

    def drop(self, *names: str) -> None:
        """The named tables, whose last reader has run; the whole folder without a name."""
        for name in names or ("",):
            self._drop(name)

    def _drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        with contextlib.suppress(Exception):
            self.drop()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts by bytes: 10,000 rows of them would fill a worker's memory. A setting of the user's own stays.

    Plans read the setting when they run, so it can't be put back here: the session keeps it.
    """
    if spark.conf.get(_BATCH).removesuffix("b") == str(64 << 20):
        spark.conf.set(_BATCH, BATCH_BYTES)


def unnamed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with columns c0, c1, ..., and which of them are doc_id and text: no name of its columns can clash with ours."""
    c = docs.columns
    return docs.toDF(*(f"c{i}" for i in range(len(c)))), f"c{c.index('doc_id')}", f"c{c.index('text')}"


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as an empty one: other columns never reach the executors."""
    small_batches(docs.sparkSession)
    rows, doc, text = unnamed(docs)
    return rows.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))


def filesystem(uri: str):
    """The file system and path of a URI: executors write and read files of their own formats through it."""
    return fs.FileSystem.from_uri(uri)


def _ids(uri: str) -> np.ndarray:
    """The row ids of a folder of Parquet files; none where it is missing."""
    store, path = filesystem(uri)
    files = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return np.concatenate([np.zeros(0, np.int64), *(pq.read_table(f.path, columns=["row"], filesystem=store, partitioning=None)["row"].to_numpy() for f in files if f.path.endswith(".parquet"))])


class Numbered:
    """docs as a table whose rows have ids of their own: doc_ids may be null or come twice, and a recomputed row keeps its id."""

    def __init__(self, ws: Workspace, docs: DataFrame) -> None:
        small_batches(docs.sparkSession)
        self.ws, self.names, self.schema = ws, docs.columns, docs.schema
        rows, self.doc, self.text = unnamed(docs)
        self.table = ws.write(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "rows")

    def texts(self, *more: Column) -> DataFrame:
        """row, doc (a null doc_id as NO_ID), text (null as empty) and what else is asked for."""
        return self.table.select("row", F.coalesce(F.col(self.doc).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(self.text, F.lit("")).alias("text"), *more)

    def found(self, rows: DataFrame, name: str, of: DataFrame | None = None) -> DataFrame:
        """Those rows of the table, or of a selection from it, whose ids are in rows (row).

        No text is shuffled for it: the ids go to a folder, `name`, for each partition that gave them out, and the scan of the table looks
        them up there.
        """
        at, of = f"{self.ws.path}/{name}", self.table if of is None else of
        part = F.shiftright("row", 33).alias("part")
        self.ws.cleaned(lambda: rows.select("row", part).repartition("part").write.partitionBy("part").parquet(at))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, ids = None, np.zeros(0, np.int64)
            for batch in batches:
                own = batch.column("row").to_numpy()
                keep = np.zeros(len(own), bool)
                for p in np.unique(own >> 33).tolist():
                    if p != now:
                        now, ids = p, _ids(f"{at}/part={p}")
                    keep |= (own >> 33 == p) & np.isin(own, ids)
                yield batch.filter(pa.array(keep))

        return of.mapInArrow(tokens.tidy(run), of.schema)

    def kept(self, rows: DataFrame) -> DataFrame:
        """The rows that found() gives, under their own names."""
        return self.found(rows, "kept").select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(self.names)))

    def drop(self) -> None:
        self.ws.drop("rows")


def held_out(doc_id: F.Column) -> F.Column:
    """crc32(doc_id as text) mod 5 is 0; a null doc_id counts as the text "null"."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def parts(spark: SparkSession, size: float, each: float) -> int:
    """Partitions of about `each` for `size`, at least one."""
    return max(1, int(-(-size // each)))
