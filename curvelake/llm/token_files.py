"""Token ids as binary files: frequency ranks in byte-aligned variable-length coding, control bytes apart.

The most frequent id has rank 0. A rank takes one to four bytes; its length less one is two bits of a control
byte, which thus serves four ranks. Control bytes and data bytes lie in separate sections, and a
256 x 4 table turns control bytes into lengths at decoding, without a loop over ids.

A set of files is a folder with one shard a range of doc_id. A shard: magic, number of documents, number of
ids, number of data bytes; document ids, their null flags, tokens a document; control bytes; data bytes. The rank table
is a file beside the shards. Files are written under names of their own by each attempt of a task; only those that
the committed attempt reports belong to the set, so a lost executor leaves at most an unread file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared, textvec
from .shared import filesystem
from .tokens import TEXT_BYTES, encoder, tokenizer_path

MAGIC = b"RANKVB01"
SHARD_IDS = 4_000_000
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def encode_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    lengths = extra.astype(np.int64) + 1
    at = np.cumsum(lengths) - lengths
    data = np.empty(int(lengths.sum()), np.uint8)
    data[at] = ranks & np.uint32(0xFF)
    for k in range(1, 4):
        longer = np.flatnonzero(extra >= k)
        data[at[longer] + k] = ranks[longer] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control.astype(np.uint8), data


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks again: lengths by table lookup, then one gather for each byte of a rank."""
    lengths = _LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(lengths) - lengths
    out = data[at].astype("<u4") if n else np.zeros(0, "<u4")
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= data[at[longer] + k].astype("<u4") << np.uint32(8 * k)
    return out


def write_shard(uri: str, doc_ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> int:
    control, data = encode_ranks(ranks)
    store, path = filesystem(uri)
    sections = (
        np.array([len(doc_ids), len(ranks), len(data)], "<i8"),
        np.array([0 if i is None else i for i in doc_ids], "<i8"), np.array([i is None for i in doc_ids], np.uint8), counts.astype("<i8"), control, data,
    )
    with store.open_output_stream(path) as out:
        out.write(MAGIC)
        for x in sections:
            out.write(x.tobytes())
    return len(MAGIC) + sum(x.nbytes for x in sections)


def read_shard(uri: str) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    store, path = filesystem(uri)
    with store.open_input_stream(path) as f:
        raw = f.read()
    if raw[:8] != MAGIC:
        raise ValueError(f"{uri} is no shard of token ids")
    docs, ids, size = np.frombuffer(raw, "<i8", 3, 8).tolist()
    at = 32
    doc_ids = np.frombuffer(raw, "<i8", docs, at).tolist()
    nulls = np.frombuffer(raw, np.uint8, docs, at + 8 * docs).tolist()
    counts = np.frombuffer(raw, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    controls = -(-ids // 4)
    ranks = decode_ranks(np.frombuffer(raw, np.uint8, controls, at), np.frombuffer(raw, np.uint8, size, at + controls), ids)
    return [None if x else i for i, x in zip(doc_ids, nulls)], counts, ranks


def write_table(uri: str, by_rank: np.ndarray) -> None:
    store, path = filesystem(uri)
    with store.open_output_stream(path) as out:
        out.write(by_rank.astype("<u4").tobytes())


def read_table(uri: str) -> np.ndarray:
    store, path = filesystem(uri)
    with store.open_input_stream(path) as f:
        return np.frombuffer(f.read(), "<u4")


_TOKENS = "doc_id long, n long, ids binary, counts binary"
_TOKENS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])


def _tokenise(path: str, end_id: int, added: bool):
    """A row for each document, and after a task's last one the counts of all its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, added)
        counts, end = np.zeros(max(e.vocabulary, end_id + 1), "<i8"), np.array([end_id], e.dtype).tobytes()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for lo, hi, _ in textvec.slices(batch, limit=TEXT_BYTES):
                coded = [x + end for x in e.encode(texts[lo:hi])]
                seen = np.bincount(np.frombuffer(b"".join(coded), e.dtype))
                counts[: len(seen)] += seen
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array([len(x) // e.dtype.itemsize for x in coded], pa.int64()), pa.array(coded, pa.binary()), pa.nulls(hi - lo, pa.binary())], schema=_TOKENS_ARROW)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([counts.tobytes()], pa.binary())], schema=_TOKENS_ARROW)

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column("counts").to_pylist():
            counts = np.frombuffer(x, "<i8")
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "count"])


_MANIFEST = "shard int, path string, n_docs long, n_ids long, n_bytes long"


def _write(folder: str, table: str, dtype: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, counts, chunks = [], [], []
        for batch in batches:
            doc_ids += batch.column("doc_id").to_pylist()
            counts += batch.column("n").to_pylist()
            chunks.append(b"".join(batch.column("ids").to_pylist()))
        if doc_ids:
            by_rank = read_table(table)
            rank_of = np.zeros(int(by_rank.max()) + 1, "<u4")
            rank_of[by_rank] = np.arange(len(by_rank), dtype="<u4")
            shard, ids = TaskContext.get().partitionId(), np.frombuffer(b"".join(chunks), dtype)
            path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.bin"
            size = write_shard(path, doc_ids, np.array(counts), rank_of[ids])
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(doc_ids)]), pa.array([len(ids)]), pa.array([size])], names=["shard", "path", "n_docs", "n_ids", "n_bytes"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, shard_ids: int = SHARD_IDS, added: bool = True) -> DataFrame:
    """Writes the ids of all texts, each with end_id behind it, in ascending doc_id order; returns the manifest with each shard's first id.

    Null text counts as empty: its document has end_id alone. A null doc_id comes first; rows with one doc_id are ordered by
    their ids. An empty table gives no shards. `folder` is a URI that driver and executors can write to.
    The manifest is a table: a row for each shard of about shard_ids ids. The driver gets the rank table, bounded by the vocabulary. added: as in
    tokens.Encoder. Long texts are encoded whole.
    """
    spark = docs.sparkSession
    ws = shared.Workspace(spark, "tokens")
    path = tokenizer or tokenizer_path()
    tokens = ws.write(shared.texts(docs).mapInArrow(_tokenise(path, end_id, added), _TOKENS), "ids")
    counted = tokens.where("counts is not null").select("counts").mapInArrow(_unpack, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))
    used = counted.toPandas().sort_values(["count", "id"], ascending=[False, True])
    table, store = f"{folder}/ranks.bin", filesystem(folder)
    store[0].create_dir(store[1], recursive=True)
    write_table(table, used["id"].to_numpy(np.int64))
    shards = shared.parts(spark, float(used["count"].sum()), shard_ids)
    rows = tokens.where("counts is null").select("doc_id", "n", "ids").repartitionByRange(shards, F.col("doc_id")).sortWithinPartitions("doc_id", "ids")
    manifest = ws.write(rows.mapInArrow(_write(folder, table, encoder(path, added).dtype), _MANIFEST), "manifest")
    ws.drop("ids")
    return manifest.join(starts(manifest), "shard").select(*manifest.columns, "first")


def starts(manifest: DataFrame, block: int = 4096) -> DataFrame:
    """shard and first, the ids of all shards before it: sums within blocks of shards, and of blocks."""
    at = manifest.select("shard", "n_ids", F.floor(F.col("shard") / block).alias("block"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = at.groupBy("block").agg(F.sum("n_ids").alias("n")).select("block", F.coalesce(F.sum("n").over(before.orderBy("block")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_ids").over(before.partitionBy("block").orderBy("shard")), F.lit(0))
    return at.withColumn("inside", inside).join(blocks, "block").select("shard", (F.col("base") + F.col("inside")).alias("first"))


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(table: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = read_table(table)
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                doc_ids, counts, ranks = read_shard(path)
                ids = by_rank[ranks]
                ends = np.cumsum(counts)
                raw = memoryview(ids.view(np.uint8))
                spans = list(zip((4 * (ends - counts)).tolist(), (4 * ends).tolist()))
                columns = [pa.array(doc_ids, pa.int64()), pa.array(first + ends - counts), pa.array(counts), pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document, decoded from the shards."""
    shards = manifest.select("shard", "path", "first")
    return shards.repartitionById(max(1, manifest.count()), F.col("shard")).mapInArrow(_read(f"{folder}/ranks.bin", with_ids), _READ + ", ids array<int>" * with_ids)
