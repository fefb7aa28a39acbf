"""Packing of whole texts into sequences, in document order, by dynamic programming over window cuts.

The ids of a range of documents lie end to end; a sequence is a window of at most `length` ids between two cuts.
Cuts may fall behind a document at no cost, behind a sentence at a small cost, and elsewhere at a larger
one (every `stride` ids, only in sentences longer than a sequence). With p the position of a cut and
f its least cost,

    f[j] = cut[j] + one sequence + min over i, p[j] - length <= p[i] < p[j], of f[i] + padding(p[j] - p[i]).

Padding is length - n, or 0 where n is a power of two. The first form is f[i] + p[i] plus a term in j alone, so its minimum over
the sliding range comes from a monotone queue, at one push and pop a cut; the second form has at most
log2(length) partners, found beforehand by binary search. Ranges of documents are packed apart, so that no task needs more
than its own; a range is large against a sequence, whose last one alone may be short.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textvec, tokens
from .tokens import TEXT_BYTES, encoder, tokenizer_path

LENGTH = 2048
SENTENCE_COST, BREAK_COST, STRIDE = 8, 24, 16
#: What any sequence costs beside its padding.
SEQUENCE_COST = 8
#: Bytes of text in a range.
RANGE_BYTES = 12 << 20

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in _PIECES.split(", ")])


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, length: int = LENGTH, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cut positions, from 0 to the last document's end, and their costs; no gap exceeds length."""
    total = int(doc_ends[-1]) if len(doc_ends) else 0
    here = np.zeros(total + 1, np.uint8)
    here[np.asarray(sentence_ends, np.int64)] = 1
    here[np.asarray(doc_ends, np.int64)] = here[[0, total]] = 2
    at = np.flatnonzero(here)
    gaps = np.flatnonzero(np.diff(at) > length)
    breaks = [np.arange(at[g] + min(stride, length), at[g + 1], min(stride, length)) for g in gaps.tolist()]
    cost = np.where(here[at] == 2, 0, SENTENCE_COST)
    if breaks:
        extra = np.concatenate(breaks)
        at, cost = np.concatenate([at, extra]), np.concatenate([cost, np.full(len(extra), BREAK_COST)])
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    return at, cost


def best_cuts(at: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indices of the cuts of a cheapest division, first and last position included."""
    n = len(at)
    if n < 2:
        return [0] * n
    # Cuts a power of two apart, by their later one.
    later, earlier, size = [], [], 1
    while size < length:
        i = np.searchsorted(at, at - size)
        j = np.flatnonzero(at[np.minimum(i, n - 1)] == at - size)
        later.append(j)
        earlier.append(i[j])
        size *= 2
    order = np.argsort(np.concatenate(later), kind="stable") if later else np.zeros(0, np.int64)
    exact = np.concatenate(earlier)[order].tolist() if later else []
    first = np.searchsorted(np.concatenate(later)[order], np.arange(n + 1)).tolist() if later else [0] * (n + 1)
    pos, costs = at.tolist(), cost.tolist()
    least, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(pos[0], 0)])  # (f[i] + p[i], i), ascending in both
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0][1]] < p - length:
            queue.popleft()
        value, i = queue[0]
        value += length - p
        for k in exact[first[j] : first[j + 1]]:
            if least[k] < value:
                value, i = least[k], k
        value += costs[j] + SEQUENCE_COST
        least[j], back[j] = value, i
        value += p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def _pack(path: str, end_id: int, length: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.give_back()
        e = encoder(path, added)
        doc_ids, counts, chunks = [], [], []
        end = np.array([end_id], e.dtype).tobytes()
        for batch in batches:
            doc_ids += batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            for lo, hi, _ in textvec.slices(batch, limit=TEXT_BYTES):
                coded = [x + end for x in e.encode(texts[lo:hi])]
                counts += [len(x) // e.dtype.itemsize for x in coded]
                chunks.append(b"".join(coded))
        if not doc_ids:
            return
        texts = coded = batch = None
        tokens.give_back()
        ids = np.frombuffer(b"".join(chunks), e.dtype)
        chunks.clear()
        doc_ends = np.cumsum(counts)
        ends, opens = e.sentence_ends()
        at, cost = candidates(doc_ends, np.flatnonzero(ends[ids[:-1]] & opens[ids[1:]]) + 1, length)
        cuts = at[best_cuts(at, cost, length)]
        edges = np.unique(np.concatenate([cuts, doc_ends]))
        starts, stops = edges[:-1], edges[1:]
        doc = np.searchsorted(doc_ends, starts, "right")
        sequence = np.searchsorted(cuts, starts, "right") - 1
        size = np.array(counts)
        raw = memoryview(ids.astype("<u4").view(np.uint8))
        crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * starts).tolist(), (4 * stops).tolist())]
        first = TaskContext.get().partitionId() << 32
        columns = pa.array(doc_ids, pa.int64()).take(pa.array(doc)), starts - (doc_ends - size)[doc], stops - starts, crc, size[doc], first + sequence, starts - cuts[sequence]
        for k in range(0, len(starts), 10_000):
            yield pa.RecordBatch.from_arrays([c[k : k + 10_000] if isinstance(c, pa.Array) else pa.array(c[k : k + 10_000], pa.int64()) for c in columns], schema=_PIECES_ARROW)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, length: int = LENGTH, range_bytes: int = RANGE_BYTES, added: bool = True) -> DataFrame:
    """The pieces of all documents, in ascending doc_id order.

    A null text counts as empty: its document is end_id alone. A null doc_id comes first; rows that repeat a doc_id
    are documents of their own. Other columns are ignored; an empty table gives no pieces. A text longer than a sequence is cut at sentence
    ends, or between any two ids where it has none. sequence_id ascends in document order, with gaps between ranges.
    """
    path = tokenizer or tokenizer_path()
    rows = shared.texts(docs)
    total = rows.select(F.sum(F.octet_length(F.col("text").cast("binary")) + 1)).first()[0] or 0
    ranges = shared.parts(docs.sparkSession, total, range_bytes)
    return rows.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id").mapInArrow(tokens.tidy(_pack(path, end_id, length, added)), _PIECES)
