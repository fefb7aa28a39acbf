"""Removal of repeated passages by level-wise doubling of word windows.

A window of `window` words can only be repeated if its halves, their halves and so on are. So, from the shortest length on:

1. Levels. In each full window that is still a candidate, the window of the level's length with the least hash is its anchor; equal full
   windows have equal anchors. Anchors that occur in one document alone go, and with them every full window that has one. The
   others are extended: at the next level, of twice the length, only anchors of the remaining candidates count. The loop ends at the
   length asked for, or as soon as no candidate is left. Longer repeats are runs of full windows.
2. Full windows. What survives is hashed with 128 bits, of which the second half comes from the bytes by another seed.
   Per hash the least and greatest doc_id are kept; a window is repeated where they differ.
3. The survivors' places go back to their rows, and words under a window that a smaller doc_id has are removed.

A copy of a smaller doc_id's whole text (its words, by 128 bits of xxh3) is covered as a whole and leaves before the first level.
The anchors of all levels are found in one pass over the texts; the levels then handle anchors alone. Counts of a hash are partial aggregates
before any shuffle, and places join the hashes by a sort-merge join whose skewed keys Spark splits: no key's occurrences are ever needed in
one task. All tables are keyed by row, so null and repeated doc_ids are no hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shared, textvec, tokens

WINDOW = 50
#: Levels start at the least length from here on that doubles to the window.
SHORTEST = 12
NO_ID = shared.NO_ID


def levels(window: int = WINDOW, shortest: int = SHORTEST) -> list[int]:
    """Lengths of the levels below the full window's, ascending, each the larger half of the next."""
    return textvec.halves(window, shortest)[:-1]


def anchors(g: np.ndarray, size: int, window: int) -> np.ndarray:
    """By position of a full window: the least hash g of its windows of `size` words."""
    return textvec.sliding(g, window - size + 1, True)


def _marks(window: int, lengths: list[int]):
    """Texts of a full window at least: their hash and, by level, the anchors of runs of full windows and where each run starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc", "n", "x", "y", *(f"{c}{i}" for i in range(len(lengths)) for c in ("at", "hash"))]
        for batch in batches:
            rows, ids = batch.column("row"), batch.column("doc")
            for lo, hi, x in textvec.slices(batch):
                w = x.words()
                h, docs = w.hashes(), w.docs
                n = np.diff(docs) - window + 1
                long = np.flatnonzero(n > 0)
                if not len(long):
                    continue
                where = pa.array(long + lo)
                whole = [xxhash.xxh3_128_intdigest(b" ".join(x.bytes_of(d).split())) for d in long.tolist()]
                columns = [rows.take(where), ids.take(where), pa.array(n[long], pa.int32()), *(pa.array(np.array([v >> s & 2**64 - 1 for v in whole], np.uint64).view(np.int64)) for s in (0, 64))]
                # Full windows that lie in a document, end to end; each document's first one opens a run.
                full = np.repeat(docs[long] - np.append(0, np.cumsum(n[long])[:-1]), n[long]) + np.arange(n[long].sum())
                first, known = np.append(0, np.cumsum(n[long])), None
                for size in lengths:
                    g = textvec.windows(h, size, known)
                    known = (size, g)
                    a = anchors(g, size, window)[full]
                    new = np.append(True, a[1:] != a[:-1])
                    new[first[:-1]] = True
                    new = np.flatnonzero(new)
                    offsets = pa.array(np.searchsorted(new, first), pa.int32())
                    at = new - np.repeat(first[:-1], np.diff(np.searchsorted(new, first)))
                    columns += [pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(a[new].view(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _marks_schema(n: int, first: int = 0, extra: str = "") -> str:
    return "row long, doc long, n int" + extra + "".join(f", at{i} array<int>, hash{i} array<long>" for i in range(first, n))


def kept_runs(n: int, at: np.ndarray, found: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of n full windows those that are left and lie in a run (from at on) that is found."""
    return left & np.repeat(found, np.diff(np.append(at, n)))


def _level(level: int, lengths: int):
    """Candidates of the next level: full windows whose anchor is repeated, and the later levels' anchors with another hash than 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        later = range(level + 1, lengths)
        names = ["row", "doc", "n", "left", *(f"{c}{i}" for i in later for c in ("at", "hash"))]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for k in range(batch.num_rows):
                value = lambda c, k=k: batch.column(c)[k].values.to_numpy()
                n, edges = batch.column("n")[k].as_py(), value("left")
                left = np.zeros(n + 1, np.int8)
                left[edges[::2]] += 1
                left[edges[1::2]] -= 1
                hashes = value(f"hash{level}")
                left = kept_runs(n, value(f"at{level}"), np.isin(hashes, value("kept")) & (hashes != 0), np.cumsum(left[:n]) > 0)
                if not left.any():
                    continue
                padded = np.concatenate([[False], left, [False]])
                row = [batch.column("row")[k].as_py(), batch.column("doc")[k].as_py(), n, np.flatnonzero(padded[1:] != padded[:-1]).astype(np.int32)]
                for i in later:
                    at, h = value(f"at{i}"), value(f"hash{i}")
                    row += [at, np.where(np.add.reduceat(left.astype(np.int32), at) > 0, h, 0)]
                for c, v in zip(out, row):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), *(pa.list_(t) for _ in later for t in (pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return run


def candidates(marks: DataFrame, ws: shared.Workspace, lengths: list[int]) -> tuple[DataFrame, list[int]]:
    """row and the edges of its spans of full windows that are repeated at each level's length; and the levels that ran."""
    now = marks.select("row", "doc", "n", F.array(F.lit(0), F.col("n")).alias("left"), *(f"{c}{i}" for i in range(len(lengths)) for c in ("at", "hash")))
    ran = []
    for i, size in enumerate(lengths):
        places = now.select("row", "doc", F.explode(f"hash{i}").alias("hash")).where("hash <> 0")
        twice = places.groupBy("hash").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("hash")
        twice = ws.write(twice, f"twice-{size}")  # as a table: only a join of two exchanges can split a skewed key
        found = places.join(twice, "hash").groupBy("row").agg(F.collect_set("hash").alias("kept"))
        kept = now.join(found.hint("shuffle_hash"), "row").mapInArrow(tokens.tidy(_level(i, len(lengths))), _marks_schema(len(lengths), i + 1, ", left array<int>"))
        now = ws.write(kept, f"level-{size}")
        ws.drop(f"twice-{size}", *(f"level-{s}" for s in ran[-1:]))
        ran.append(size)
        if now.isEmpty():
            break
    return now.select("row", "left"), ran


_EXTENDED = "row long, doc long, n_words long, text string, whole boolean, at array<int>, hash array<long>, check array<long>"
_ARROW = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("n_words", pa.int64()), ("text", pa.string()), ("whole", pa.bool_()), ("at", pa.list_(pa.int32())), ("hash", pa.list_(pa.int64())), ("check", pa.list_(pa.int64()))])


def _extend(window: int):
    """Each candidate's full windows, by two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int32)
        for batch in batches:
            rows, ids, whole = (batch.column(c).to_pylist() for c in ("row", "doc", "whole"))
            for lo, hi, x in textvec.slices(batch):
                texts, left = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("text", "left"))
                w = x.words()
                docs = w.docs
                h = [textvec.windows(w.hashes(s), window).view(np.int64) for s in (0, 1)] if any(left) else []
                out = []
                for d in range(hi - lo):
                    a, b = int(docs[d]), int(docs[d + 1])
                    edges = left[d] or ()
                    at = np.concatenate([np.arange(i, j, dtype=np.int32) for i, j in zip(edges[::2], edges[1::2])]) if edges else none
                    out.append((rows[lo + d], ids[lo + d], b - a, texts[d], whole[lo + d], at, *((g[a + at] if edges else none) for g in h or (none, none))))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)]
                yield pa.RecordBatch.from_arrays([*columns, batch.column("rest").slice(lo, hi - lo)], names=[*_ARROW.names, "rest"])

    return run


_KEPT = "doc long, n_words long, n_removed long, kept_text string"


def _remove(window: int, as_is: bool):
    """as_is: a text of which nothing goes keeps its white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                out = []
                for doc, n, text, whole, at in zip(*(batch.slice(lo, 500).column(c).to_pylist() for c in ("doc", "n_words", "text", "whole", "removed"))):
                    removed = n if whole else 0
                    if as_is and not whole and not at:
                        out.append((None if doc == NO_ID else doc, n, 0, text))
                        continue
                    words = [] if whole else text.encode().split()
                    if at and not whole:
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, np.array(at) + window, -1)
                        keep = np.cumsum(edge[:n]) == 0
                        removed = n - int(keep.sum())
                        words = [w for w, k in zip(words, keep.tolist()) if k]
                    out.append((None if doc == NO_ID else doc, n, removed, b" ".join(words).decode()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*out), kinds)), batch.column("rest").slice(lo, 500)], names=["doc", "n_words", "n_removed", "kept_text", "rest"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the kept words, joined by one space) of every row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`. A word goes if a window of `window` words over it starts in a document of smaller doc_id too. Null
    text has no words. A null doc_id counts as greater than all others, and rows that share a doc_id don't remove each other's words.
    Ties: of equal windows that of the least doc_id stays, in each of its places. Long texts are handled whole, in one task each. Columns beside
    doc_id and text are ignored; an empty table gives an empty result.
    """
    rows, doc, text = shared.unnamed(docs)
    out = _repeats(rows.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), window, shortest, False)
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", "kept_text")


def drop_repeats(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """The rows of docs, all columns, without the words that remove_repeats takes; texts that lose none are unchanged, a null one
    becomes empty, those that lose all go, and n_chars, where it is a column, follows the text. Null and repeated doc_ids are as there."""
    left = _repeats(docs, window, shortest, True).where("n_removed = 0 or n_removed < n_words")
    as_is, out = F.col("n_removed") == 0, []
    for i, c in enumerate(docs.columns):
        value = F.col(f"rest.c{i}")
        if c == "text":
            value = F.col("kept_text")
        elif c == "n_chars":
            value = F.when(as_is, value).otherwise(F.char_length("kept_text"))
        out.append(value.cast(docs.schema[i].dataType).alias(c))
    return left.select(*out)


def _repeats(docs: DataFrame, window: int, shortest: int, as_is: bool) -> DataFrame:
    """doc, n_words, n_removed, kept_text and, as a struct, the columns but text by position."""
    ws = shared.Workspace(docs.sparkSession, "substrings")
    numbered = shared.Numbered(ws, docs)
    texts, lengths = numbered.texts(), levels(window, shortest)
    marks = ws.write(texts.mapInArrow(tokens.tidy(_marks(window, lengths)), _marks_schema(len(lengths), extra=", x long, y long")), "marks")
    whole = marks.groupBy("x", "y").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    whole = ws.write(whole, "whole")
    copies = ws.write(marks.select("row", "doc", "x", "y").join(whole, ["x", "y"]).where("least < doc").select("row"), "copies")
    left, _ = candidates(marks.join(copies, "row", "left_anti"), ws, lengths)
    state = left.select("row", "left", F.lit(False).alias("whole")).union(copies.select("row", F.lit(None).cast("array<int>"), F.lit(True)))
    rest = F.struct(*(f"c{i}" for i in range(len(docs.columns)) if f"c{i}" != numbered.text)).alias("rest")
    full = numbered.texts(rest)
    kind = full.schema["rest"]
    # A partition's candidates are its small side; texts needn't be sorted.
    keyed = full.join(state.hint("shuffle_hash"), "row", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    extended = ws.write(keyed.mapInArrow(tokens.tidy(_extend(window)), StructType([*StructType.fromDDL(_EXTENDED), kind])), "extended")
    numbered.drop()
    ws.drop("marks", "whole", "copies", *(f"level-{s}" for s in lengths))
    places = extended.where(F.size("at") > 0).select("row", "doc", F.inline(F.arrays_zip("at", "hash", "check")))
    twice = places.groupBy("hash", "check").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    twice = ws.write(twice, "twice")
    cut = places.join(twice, ["hash", "check"]).where("least < doc").groupBy("row").agg(F.collect_list("at").alias("removed"))
    some = extended.where(F.size("at") > 0).join(cut.hint("shuffle_hash"), "row", "left").select("doc", "n_words", "text", "whole", "removed", "rest")
    none = extended.where(F.size("at") == 0).select("doc", "n_words", "text", "whole", F.lit(None).cast("array<int>").alias("removed"), "rest")
    return some.union(none).mapInArrow(tokens.tidy(_remove(window, as_is)), StructType([*StructType.fromDDL(_KEPT), kind]))


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
