"""Whole texts as numpy arrays: words, 64-bit word hashes and window hashes of an Arrow batch at once.

Every function works on the UTF-8 bytes of a batch of texts laid end to end. Words are maximal runs of
bytes outside a separator table; no word crosses a document's end. A word is hashed by chains of mixed eight-byte chunks, a
window from the hashes of its two halves; each step mixes all bits, so no pattern of equal parts cancels out. Hashes of another
seed start at the bytes again and share nothing with the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Words of more bytes are hashed by xxh3, one by one.
CHAINED = 64
#: Odd, and 2 modulo 4 less one: halves (a, b) and (b, a) differ in all bits but one at most.
_LEFT = U(0x9E3779B97F4A7C17)
#: Sub-batches hold about this many bytes of text, so that temporaries stay near 50 MB.
CHUNK = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
_NOT_ALNUM = np.ones(256, bool)
for _a, _b in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _NOT_ALNUM[_a : _b + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of raw[starts:ends], none of them empty."""
    size = ends - starts
    h = mix(size.astype(np.uint64) * U(0xA0761D6478BD642F) + U(seed * 0x2545F4914F6CDD1D & 2**64 - 1))
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    chunks = np.ndarray(len(raw) + 1, "<u8", padded, 0, (1,))
    h = mix(h ^ (chunks[starts] & _MASK[np.minimum(size, 8)]))
    live, at = np.flatnonzero((size > 8) & (size <= CHAINED)), 8
    while len(live):
        h[live] = mix(h[live] ^ (chunks[starts[live] + at] & _MASK[np.minimum(size[live] - at, 8)]))
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > CHAINED).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), seed)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, dtype=np.uint64, out=out[1:])
    return out


class Texts:
    """The documents of a sub-batch: bytes, and the word table when asked for."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray) -> None:
        #: ends has a leading 0: document d is raw[ends[d]:ends[d + 1]].
        self.raw, self.ends = raw, ends

    def __len__(self) -> int:
        return len(self.ends) - 1

    def bytes_of(self, d: int) -> bytes:
        return self.raw[self.ends[d] : self.ends[d + 1]].tobytes()

    def words(self, alnum: bool = False) -> Words:
        raw = LOWER[self.raw] if alnum else self.raw
        sep = (_NOT_ALNUM if alnum else WHITE)[raw]
        n = len(raw)
        if not n:
            z = np.zeros(0, np.int64)
            return Words(raw, z, z, np.zeros(len(self) + 1, np.int64))
        before = np.empty(n, bool)
        before[0] = True
        before[1:] = sep[:-1]
        edges = self.ends[1:-1]
        before[edges[edges < n]] = True
        after = np.empty(n, bool)
        after[-1] = True
        after[:-1] = sep[1:]
        edges = edges[edges > 0] - 1
        after[edges] = True
        starts = np.flatnonzero(~sep & before)
        return Words(raw, starts, np.flatnonzero(~sep & after) + 1, np.searchsorted(starts, self.ends))


class Words:
    """starts, ends: byte ranges of all words; docs: document d has words docs[d]:docs[d + 1]."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> None:
        self.raw, self.starts, self.ends, self.docs = raw, starts, ends, docs

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.docs)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.docs) - 1), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        return spans(self.raw, self.starts, self.ends, seed)


def halves(k: int, shortest: int = 1) -> list[int]:
    """Ascending lengths up to k, each the larger half of the next, none below `shortest` but k itself."""
    out = [k]
    while out[-1] > 1 and -(-out[-1] // 2) >= shortest:
        out.append(-(-out[-1] // 2))
    return out[::-1]


def windows(h: np.ndarray, k: int, known: tuple[int, np.ndarray] | None = None) -> np.ndarray:
    """Hashes of the k items from each position, each length's from those of its two halves, which overlap by one where it is odd.

    known: a length of halves(k) with its windows. Positions run across documents, mask them with inside().
    """
    at, g = known or (1, h)
    for size in halves(k):
        if size > at:
            n = max(0, len(h) - size + 1)
            g = mix(g[:n] * _LEFT + g[size - at : size - at + n])
            at = size
    return g


def inside(docs: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n windows of k words lie in one document."""
    left = np.repeat(docs[1:], np.diff(docs)) - np.arange(docs[-1])
    return left[:n] >= k


def sliding(a: np.ndarray, k: int, least: bool) -> np.ndarray:
    """Minimum or maximum of the k values from each position, in log2(k) passes."""
    f = np.minimum if least else np.maximum
    if len(a) < k:
        return a[:0]
    size, n = 1, len(a) - k + 1
    while 2 * size <= k:
        a = f(a[:-size], a[size:])
        size *= 2
    return f(a[:n], a[k - size : k - size + n])


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[tuple[int, int, Texts]]:
    """Row ranges of a batch with their texts; the column holds no nulls. A text over the limit is a range of its own."""
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if not n:
        return
    _, offsets, data = col.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, Texts(raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
        lo = hi
