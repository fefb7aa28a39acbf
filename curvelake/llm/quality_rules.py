"""Quality rules: counts of a text, and a hashed n-gram log-likelihood ratio of trusted against raw text.

Hashed word uni- and bigrams of all trusted documents and of all documents make two multinomials with additive smoothing.
A document's value is the mean over its n-grams of log p_trusted - log p_raw; it passes at a fixed
threshold, so the same document over the same corpus always has the same verdict.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality_classifier, shared, textvec

#: Buckets of n-grams, and buckets that a row of counts holds.
BITS, SLICE = 20, 1 << 14
#: Added to each bucket's count, as a part of the mean count.
SMOOTHING = 0.5
#: Least mean log-likelihood ratio of a document that is kept.
THRESHOLD = -0.5
LEAST_WORDS, MOST_REPEATED = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NO_WORD = re.compile(rb"[\x20\x09-\x0D]*")


def grams(x: textvec.Texts, w: textvec.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each n-gram: words and word pairs, as they are and by shape."""
    doc, shape = w.doc(), quality_classifier.shapes(w)
    docs, found = [], []
    for salt, k, g in ((1, 1, h), (2, 1, shape), (3, 2, textvec.windows(h, 2)), (4, 2, textvec.windows(shape, 2))):
        whole = textvec.inside(w.docs, k, len(g))
        docs.append(doc[: len(g)][whole])
        found.append((textvec.mix(g[whole] ^ np.uint64(salt)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(found)


def _narrow(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest, whose number comes first."""
    kind = np.min_scalar_type(int(x.max()))
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _rows(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), *(pa.array([_narrow(t[k]) for t in totals.values()], pa.binary()) for k in (0, 1))], names=["slice", "raw", "trusted"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task has seen, in slices of the buckets: of all its documents and of the trusted ones."""
    total = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        trusted = np.array(batch.column("trusted").to_pylist(), bool)
        for lo, hi, x in textvec.slices(batch):
            w = x.words()
            doc, found = grams(x, w, w.hashes())
            total[0] += np.bincount(found, minlength=1 << BITS)
            if trusted[lo:hi].any():
                total[1] += np.bincount(found[trusted[lo:hi][doc]], minlength=1 << BITS)
    if total.any():
        parts = np.split(total, range(SLICE, 1 << BITS, SLICE), 1)
        yield _rows(dict(enumerate(parts)))


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of slices, as they come in."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, *both in zip(*(batch.column(c).to_pylist() for c in ("slice", "raw", "trusted"))):
            totals[i] = totals.get(i, 0) + np.stack([_wide(x) for x in both])
    if totals:
        yield _rows(totals)


def ratios(raw: np.ndarray, trusted: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p_trusted - log p_raw of each bucket; 0 without trusted text."""
    if not trusted.sum():
        return np.zeros(len(raw), np.float32)
    p, q = (x + smoothing * x.mean() for x in (trusted.astype(float), raw.astype(float)))
    return (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> np.ndarray:
    """The log ratios by bucket. Trusted are documents labelled 1 that aren't held out; counts cover them all and all documents.

    The join shuffles both sides at any size: the trusted ids grow with the labels. Each task sends its counts of 2**BITS buckets in slices,
    a byte or two each; the driver gets their sums.
    """
    ids = labels.where((F.col(label) == 1) & F.col("doc_id").isNotNull() & ~shared.held_out(F.col("doc_id")))
    ids = ids.select(F.col("doc_id").cast("long").alias("_id")).distinct().hint("merge")
    rows = shared.texts(docs).join(ids, F.col("doc_id") == F.col("_id"), "left").select("text", F.col("_id").isNotNull().alias("trusted"))
    kind = "slice int, raw binary, trusted binary"
    total = np.zeros((2, 1 << BITS), np.int64)
    for r in rows.mapInArrow(_count, kind).repartition("slice").mapInArrow(_sum, kind).collect():
        total[:, r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = _wide(r["raw"]), _wide(r["trusted"])
    return ratios(total[0], total[1])


def repeated(w: textvec.Words, h: np.ndarray) -> np.ndarray:
    """Which words lie in a window of three that its document has twice or more."""
    g = textvec.windows(h, 3)
    found = np.zeros(len(w), bool)
    at = np.flatnonzero(textvec.inside(w.docs, 3, len(g)))
    key = textvec.mix(g[at] + w.doc()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if len(twice):
        twice = np.unique(twice)
        i = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        starts = at[twice[i] == key]
        for k in range(3):
            found[starts + k] = True
    return found


def sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[ends])


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if not _NO_WORD.fullmatch(x)]
    return len(lines) - len(set(lines))


_RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, verdict of the base rules, the method's value llr and its verdict with theirs, for every row of docs.

    A null text counts as empty: it has no words and fails the base rules. Without trusted documents each ratio is 0. A null doc_id is judged
    like others, repeated rows each for themselves, long texts whole; ties don't matter; columns beside doc_id and text are ignored, an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for lo, hi, x in textvec.slices(batch):
                w = x.words()
                h = w.hashes()
                n = w.counts()
                doc, found = grams(x, w, h)
                llr = np.bincount(doc, table[found].astype(float), len(x)) / np.maximum(np.bincount(doc, minlength=len(x)), 1)
                chars = np.zeros(len(x.raw), bool) if not len(w) else ((x.raw & 0xC0) != 0x80) & ~textvec.WHITE[x.raw]
                again = sums(repeated(w, h), w.docs)
                failed = (n < LEAST_WORDS) | (100 * again > MOST_REPEATED * n)
                lines = [duplicate_lines(x.bytes_of(d)) for d in range(len(x))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in (n, sums(chars, x.ends), sums(_SYMBOL[x.raw], x.ends), lines, again)), pa.array(failed), pa.array(~failed & (llr >= threshold)), pa.array(llr)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"],
                )

    return shared.texts(docs).mapInArrow(run, _RULES)
