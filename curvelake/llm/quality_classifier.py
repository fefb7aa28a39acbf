"""Quality classifier: hashed word n-grams, logistic regression by FTRL, scores as sparse dot products.

The n-grams are of words, of word shapes (letters, capitals, digits and each other sign, runs as one) and of
repetition (whether a word equals the one before). Each kind's values sum to SCALE in any text, so scores don't
grow with its length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import linear, textvec

SCALE = 10.0
#: Label 1 is predicted from this score on.
THRESHOLD = 0.3
#: Labelled rows to fit on; the counts of words need no more.
TRAIN_ROWS = 4000
ALPHA, L1, L2, EPOCHS = 0.5, 0.1, 0.1, 3

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x61:0x7B] = _CLASS[0x80:] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3


def shapes(w: textvec.Words) -> np.ndarray:
    """A hash of each word's sequence of byte classes, runs taken once."""
    if not len(w):
        return np.zeros(0, np.uint64)
    kind = _CLASS[w.raw]
    new = np.append(True, kind[1:] != kind[:-1])
    new[w.starts] = True
    rank = np.cumsum(new) - 1
    return textvec.spans(kind[new], rank[w.starts], rank[w.ends - 1] + 1)


def features(x: textvec.Texts) -> linear.Triples:
    w = x.words()
    h, shape, doc = w.hashes(), shapes(w), w.doc()
    grams = [(1, 1, h), (2, 1, shape), (3, 2, textvec.windows(h, 2)), (4, 2, textvec.windows(shape, 2)), (5, 3, textvec.windows(shape, 3)), (6, 2, np.where(h[1:] == h[:-1], np.uint64(1), np.uint64(2)))]
    docs, found, values = [], [], []
    for salt, k, g in grams:
        whole = textvec.inside(w.docs, k, len(g))
        d = doc[: len(g)][whole]
        docs.append(d)
        found.append(linear.bucket(g[whole], salt))
        values.append((SCALE / np.maximum(np.bincount(d, minlength=len(x)), 1))[d])
    return np.concatenate(docs), np.concatenate(found), np.concatenate(values)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    return linear.fit(linear.labelled(docs, labels, label, rows), features, linear.Ftrl(ALPHA, L1, L2), EPOCHS)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **parameters) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    Learns from labelled rows that aren't held out, at most `rows` of them; without any, all scores are 0.5. A null or empty
    text has the score of the bias. Conflicting or missing labels teach nothing. A null doc_id is scored like others. Columns beside
    doc_id and text are ignored; an empty table gives an empty result. Repeated rows get one score each; long texts are scored whole.
    """
    return linear.score(docs, features, train(docs, labels, **parameters), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **parameters) -> DataFrame:
    """The rows of docs, all columns, that quality_scores predicts as 1: null, repeated, long and empty ones are judged as there. A score that
    ties with the threshold stays."""
    return linear.keep(docs, features, train(docs, labels, **parameters), threshold)
