"""Exact deduplication by an extendible-hash index on shared files.

1. Runs. Each map task normalises its texts and collapses equal ones, bytes compared, to one run: key, text, row ids. It keeps
   up to `held` bytes of distinct texts at once, so a group of copies sends its text once a task or so. Keys whose
   runs still weigh more than an owner's share are combined in salted parts before, as often as needed.
2. Index. The 64-bit key's upper bits name an owner; the number of owners follows the bytes of text, so each
   owner's distinct texts fit its memory. An owner inserts its runs in an extendible-hash directory:
   an overfull bucket splits, the directory doubles when the bucket is as deep as it, equal keys are chained and
   compared byte by byte. Directory and buckets go to a file in the shared folder; files are written under names of their own by each
   attempt of a task, and only those that the committed attempt reports are read.
3. Lookup. Runs, without text, are dealt by owner, a hot owner's in salted parts; each task reads its owner's file and finds a run through
   directory, bucket and chain. Row ids are unnested only then.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, tokens

NO_ID = shared.NO_ID
OWNER_BYTES = 24 << 20
BUCKET_KEYS = 256
#: Bytes of distinct texts that a map task keeps to find their copies; runs of a hot key that one part of it combines at least; runs that
#: one lookup task reads.
HELD_BYTES, COMBINED, LOOKUP_RUNS = 24 << 20, 8, 500_000
MAGIC = b"EXTHASH1"

_RUNS = "run long, key long, sha binary, size long, text binary, ids array<long>, rows array<long>, least long"
_RUNS_ARROW = pa.schema([("run", pa.int64()), ("key", pa.int64()), ("sha", pa.binary()), ("size", pa.int64()), ("text", pa.binary()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("least", pa.int64())])
_LEADS = "key long, sha binary, text binary, least long, run long, size long"
_LEADS_ARROW = pa.schema([("key", pa.int64()), ("sha", pa.binary()), ("text", pa.binary()), ("least", pa.int64()), ("run", pa.int64()), ("size", pa.int64())])
#: An entry of a bucket in an index file.
_ENTRY = np.dtype([("key", "<u8"), ("sha", "V32"), ("least", "<i8"), ("run", "<i8"), ("size", "<i8")])


def normalise(text: bytes) -> bytes:
    """Each run of [\\x20\\x09-\\x0D] as one space; bytes.split() without argument splits at just these."""
    if not text:
        return text
    core = b" ".join(text.split())
    if not core:
        return b" "
    return b" " * (text[0] in b" \t\n\v\f\r") + core + b" " * (text[-1] in b" \t\n\v\f\r")


def key_of(text: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


class Entry:
    """One distinct text in a bucket."""

    __slots__ = ("key", "least", "run", "sha", "size", "text")

    def __init__(self, key: int, text: bytes, sha: bytes, least: int, run: int, size: int) -> None:
        self.key, self.text, self.sha, self.least, self.run, self.size = key, text, sha, least, run, size


class Bucket:
    __slots__ = ("chains", "depth")

    def __init__(self, depth: int) -> None:
        self.depth, self.chains = depth, {}


class ExtendibleHash:
    """Directory of 2**depth pointers to buckets of at most `capacity` keys, indexed by a key's lower bits."""

    def __init__(self, capacity: int = BUCKET_KEYS) -> None:
        self.capacity, self.depth = capacity, 0
        self.directory = [Bucket(0)]

    def bucket(self, key: int) -> Bucket:
        return self.directory[key & ((1 << self.depth) - 1)]

    def insert(self, key: int, text: bytes, sha: bytes, least: int, run: int, size: int) -> None:
        bucket = self.bucket(key)
        chain = bucket.chains.get(key)
        if chain is not None:
            for e in chain:
                if e.text == text:
                    e.size += size
                    if (least, run) < (e.least, e.run):
                        e.least, e.run = least, run
                    return
            chain.append(Entry(key, text, sha, least, run, size))
            return
        bucket.chains[key] = [Entry(key, text, sha, least, run, size)]
        while len(bucket.chains) > self.capacity and bucket.depth < 64:
            self.split(bucket)
            bucket = self.bucket(key)

    def split(self, bucket: Bucket) -> None:
        if bucket.depth == self.depth:
            self.directory += self.directory
            self.depth += 1
        bit = 1 << bucket.depth
        pair = Bucket(bucket.depth + 1), Bucket(bucket.depth + 1)
        first = next(iter(bucket.chains)) & (bit - 1)
        for key, chain in bucket.chains.items():
            pair[bool(key & bit)].chains[key] = chain
        for i in range(first, len(self.directory), bit):
            self.directory[i] = pair[bool(i & bit)]

    def buckets(self) -> Iterator[tuple[int, Bucket]]:
        for i, b in enumerate(self.directory):
            if i < 1 << b.depth:
                yield i, b


def _runs(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        at, size = TaskContext.get().partitionId() << 33, 0
        groups: dict[bytes, tuple[list[int], list[int]]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal at, size
            rows = [(at + k, key_of(t), hashlib.sha256(t).digest(), len(ids), t, ids, own, min(ids)) for k, (t, (ids, own)) in enumerate(groups.items())]
            at, size = at + len(rows), 0
            groups.clear()
            for k in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 2000]), _RUNS_ARROW)], schema=_RUNS_ARROW)

        for batch in batches:
            for i, row, t in zip(*(c.to_pylist() for c in (batch.column("doc"), batch.column("row"), batch.column("text").cast(pa.binary())))):
                t = normalise(t)
                found = groups.get(t)
                if found is None:
                    groups[t] = found = [], []
                    size += len(t) + 200
                found[0].append(i)
                found[1].append(row)
            if size > held:
                yield from sent()
        yield from sent()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leads of a part of a hot key, one for each text, as ordered by key and salt."""
    now, found = None, {}

    def sent() -> Iterator[pa.RecordBatch]:
        if found:
            rows = [(now[0], sha, t, least, run, size) for t, (sha, least, run, size) in found.items()]
            found.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LEADS_ARROW)], schema=_LEADS_ARROW)

    for batch in batches:
        for key, salt, sha, t, least, run, size in zip(*(batch.column(c).to_pylist() for c in ("key", "salt", "sha", "text", "least", "run", "size"))):
            if (key, salt) != now:
                yield from sent()
                now = key, salt
            before = found.get(t, (sha, least, run, 0))
            found[t] = (sha, *min((least, run), before[1:3]), size + before[3])
    yield from sent()


def combined(leads: DataFrame, ws: shared.Workspace, share: int) -> tuple[DataFrame, int]:
    """leads, with at most COMBINED rows of each key whose texts weigh more than `share`, and how many rounds it took."""
    k = 0
    while True:
        heavy = leads.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).where((F.col("n") > COMBINED) & (F.col("bytes") > share))
        heavy = ws.write(heavy.select("key", F.least(F.ceil(F.col("bytes") / share), F.ceil(F.col("n") / COMBINED)).alias("parts")), f"heavy-{k}")
        if heavy.isEmpty():
            return leads, k + 1
        salted = leads.join(heavy, "key").withColumn("salt", F.pmod(F.xxhash64("run", F.lit(k)), "parts"))
        merged = salted.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(tokens.tidy(_merge), _LEADS)
        rest = leads.join(heavy.hint("shuffle_hash"), "key", "left_anti").select(*_LEADS_ARROW.names)
        k, leads = k + 1, ws.write(rest.union(merged), f"leads-{k}")


def write_index(folder: str, index: ExtendibleHash) -> str:
    """The directory, where each bucket begins, and the buckets' entries by key; equal keys are a chain."""
    store, path = shared.filesystem(folder)
    number, starts, entries = {}, [0], []
    for _, b in index.buckets():
        number[id(b)] = len(number)
        entries += [(k & 2**64 - 1, e.sha, e.least, e.run, e.size) for k in sorted(b.chains, key=lambda k: k & 2**64 - 1) for e in b.chains[k]]
        starts.append(len(entries))
    name = f"index-{uuid.uuid4().hex}.bin"
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(MAGIC)
        out.write(np.array([len(index.directory), len(number), len(entries)], "<i8").tobytes())
        out.write(np.array([number[id(b)] for b in index.directory], "<i4").tobytes())
        out.write(np.array(starts, "<i8").tobytes())
        out.write(np.array(entries, _ENTRY).tobytes())
    return name


class IndexFile:
    """An owner's index, as read from its file."""

    def __init__(self, folder: str, name: str) -> None:
        store, path = shared.filesystem(folder)
        with store.open_input_stream(f"{path}/{name}") as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"{name} is no index file")
        slots, buckets, entries = np.frombuffer(raw, "<i8", 3, 8).tolist()
        self.directory = np.frombuffer(raw, "<i4", slots, 32)
        self.starts = np.frombuffer(raw, "<i8", buckets + 1, 32 + 4 * slots)
        self.entries = np.frombuffer(raw, _ENTRY, entries, 40 + 4 * slots + 8 * buckets)

    def find(self, keys: np.ndarray, shas: list[bytes]) -> np.ndarray:
        """Where in the entries each key and digest is: through the directory to a bucket, by halving to a chain, along the chain."""
        keys = keys.view(np.uint64)
        bucket = self.directory[(keys & np.uint64(len(self.directory) - 1)).astype(np.int64)]
        low, high, known = self.starts[bucket], self.starts[bucket + 1], self.entries["key"]
        while (low < high).any():
            mid = (low + high) // 2
            less = (low < high) & (known[np.minimum(mid, len(known) - 1)] < keys)
            low, high = np.where(less, mid + 1, low), np.where(less, high, np.minimum(mid, high))
        sha = self.entries["sha"]
        for i, s in enumerate(shas):
            while sha[low[i]].tobytes() != s:
                low[i] += 1
        return low


def _owner(capacity: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, owner = ExtendibleHash(capacity), None
        for batch in batches:
            for owner, *x in zip(*(batch.column(c).to_pylist() for c in ("owner", "key", "text", "sha", "least", "run", "size"))):
                index.insert(*x)
        if owner is not None:
            yield pa.RecordBatch.from_arrays([pa.array([owner], pa.int64()), pa.array([write_index(folder, index)])], names=["owner", "file"])

    return run


_FOUND = "sha binary, ids array<long>, rows array<long>, first boolean, keep_id long, group_size long"


def _lookup(folder: str):
    """Rows ordered by file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        for batch in batches:
            names = batch.column("file").to_pylist()
            cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if names[lo] != now:
                    now, index = names[lo], IndexFile(folder, names[lo])
                e = index.entries[index.find(part.column("key").to_numpy(), part.column("sha").to_pylist())]
                first = e["run"] == part.column("run").to_numpy()
                yield pa.RecordBatch.from_arrays([part.column("sha"), part.column("ids"), part.column("rows"), pa.array(first), pa.array(e["least"]), pa.array(e["size"])], names=["sha", "ids", "rows", "first", "keep_id", "group_size"])

    return run


def _grouped(ws: shared.Workspace, texts: DataFrame, owner_bytes: int, bucket_keys: int, held_bytes: int) -> DataFrame:
    """id, row, keep_id, group_size, kept and sha of every row (row, doc, text)."""
    spark = texts.sparkSession
    runs = ws.write(texts.select("row", "doc", "text").mapInArrow(tokens.tidy(_runs(held_bytes)), _RUNS), "runs")
    leads, k = combined(runs.select(*_LEADS_ARROW.names), ws, owner_bytes)
    total = leads.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    owners = shared.parts(spark, total, owner_bytes)
    bits = (owners - 1).bit_length()
    owners = 1 << bits
    owner = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    keyed = leads.withColumn("owner", owner).repartitionById(owners, F.col("owner").cast("int"))
    files = ws.write(keyed.mapInArrow(tokens.tidy(_owner(bucket_keys, f"{ws.path}/index")), "owner long, file string"), "files")
    ws.drop(*(f"{t}-{i}" for t in ("heavy", "leads") for i in range(k)))
    few = runs.select(owner.alias("owner"), "key", "sha", "run", "ids", "rows")
    parts = files.join(few.groupBy("owner").agg(F.ceil(F.count("*") / LOOKUP_RUNS).alias("parts")), "owner")
    dealt = few.join(parts, "owner").withColumn("salt", F.pmod(F.xxhash64("run"), "parts"))
    found = dealt.repartition("owner", "salt").sortWithinPartitions("file").select("file", "key", "sha", "run", "ids", "rows").mapInArrow(tokens.tidy(_lookup(f"{ws.path}/index")), _FOUND)
    rows = found.select("*", F.posexplode(F.arrays_zip("ids", "rows")).alias("at", "of"))
    kept = F.col("first") & (F.col("at") + 1 == F.array_position("ids", F.col("keep_id")))
    return rows.select(F.col("of.ids").alias("id"), F.col("of.rows").alias("row"), "keep_id", "group_size", kept.alias("kept"), "sha")


def exact_groups(docs: DataFrame, owner_bytes: int = OWNER_BYTES, bucket_keys: int = BUCKET_KEYS, held_bytes: int = HELD_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Null text counts as empty, and all empty texts are equal; other columns are ignored. A null doc_id sorts
    behind all others; a group of such rows alone has a null keep_id and keeps one of them. Of rows that repeat a doc_id and
    a text exactly one is kept. An empty table gives an empty result. Long texts are compared whole.
    """
    no = F.lit(NO_ID)
    texts = shared.texts(docs).select(F.lit(0).cast("long").alias("row"), F.coalesce("doc_id", no).alias("doc"), "text")
    g = _grouped(shared.Workspace(docs.sparkSession, "exact"), texts, owner_bytes, bucket_keys, held_bytes)
    return g.select(F.nullif("id", no).alias("doc_id"), F.nullif("keep_id", no).alias("keep_id"), "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, owner_bytes: int = OWNER_BYTES, bucket_keys: int = BUCKET_KEYS, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Of the rows of docs, all columns, one of each group of equal texts: that of the least doc_id, any one of its rows if several have that.

    Null and repeated doc_ids, null and long texts are as in exact_groups: the empty and null texts are one group.
    """
    ws = shared.Workspace(docs.sparkSession, "exact")
    numbered = shared.Numbered(ws, docs)
    out = numbered.kept(_grouped(ws, numbered.texts(), owner_bytes, bucket_keys, held_bytes).where("kept").select("row"))
    ws.drop("runs", "files", "index")
    return out
