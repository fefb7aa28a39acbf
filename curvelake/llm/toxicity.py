"""Toxicity classifier with counterfactual regularisation.

Features are the presence of a text's lower-cased words and of their first bytes, so an inflected slur is met by its
stem. Where a labelled sentence names a group, the group's name is swapped for another of its
kind, and the square of the change in score is penalised: weight stays off the names, whatever texts they
come in, and a neutral mention scores as the sentence without it would. A strong l1 term clears all other words.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from . import linear, textvec

THRESHOLD = 0.5
TRAIN_ROWS = 8000
ALPHA, L1, EPOCHS, PULL = 1.0, 10.0, 20, 4.0
PREFIXES = (5, 6, 7, 8)

#: Names of groups by kind; a term is swapped for the next one of its row.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("women", "men"), ("woman", "man"), ("girls", "boys"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("black", "white", "asian", "hispanic", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young"), ("deaf", "blind", "disabled"),
    ("christen", "muslime", "juden"), ("frauen", "männer"), ("ausländer", "inländer"),
    ("chrétiens", "musulmans", "juifs"), ("femmes", "hommes"),
    ("cristianos", "musulmanes", "judíos"), ("mujeres", "hombres"),
)


def swaps(terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> dict[str, str]:
    return {a: row[(i + 1) % len(row)] for row in terms for i, a in enumerate(row)}


class Counterfactuals:
    """The sentences of a text that name a group, each with its swapped form."""

    def __init__(self, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> None:
        self.next = swaps(terms)
        self.term = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, self.next), key=len, reverse=True)) + r")\b")
        self.sentence = re.compile(r"[^.!?\n]+")

    def __call__(self, text: str) -> list[tuple[str, str]]:
        low = text.lower()
        if not self.term.search(low):
            return []
        return [(s, t) for s in self.sentence.findall(low) if (t := self.term.sub(lambda m: self.next[m[0]], s)) != s]


def features(x: textvec.Texts) -> linear.Triples:
    """Each distinct word and prefix of a document once, with value 1."""
    w = x.words(alnum=True)
    doc, size = w.doc(), w.ends - w.starts
    docs, found = [doc], [linear.bucket(w.hashes(), 1)]
    for k in PREFIXES:
        longer = np.flatnonzero(size > k)
        docs.append(doc[longer])
        found.append(linear.bucket(textvec.spans(w.raw, w.starts[longer], w.starts[longer] + k), k))
    return np.concatenate(docs), np.concatenate(found), np.ones(sum(map(len, docs)))


def _once(x: textvec.Texts) -> linear.Triples:
    doc, feature, _ = features(x)
    key = np.unique(doc << linear.BITS | feature)
    return key >> linear.BITS, key & ((1 << linear.BITS) - 1), np.ones(len(key))


class Scored:
    """Features of weight only, each once a document: few words have one, so little is sorted."""

    def __init__(self, weights: np.ndarray) -> None:
        self.used = weights[:-1] != 0

    def __call__(self, x: textvec.Texts) -> linear.Triples:
        doc, feature, _ = features(x)
        keep = self.used[feature]
        key = np.unique(doc[keep] << linear.BITS | feature[keep])
        return key >> linear.BITS, key & ((1 << linear.BITS) - 1), np.ones(len(key))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, pull: float = PULL, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> np.ndarray:
    return linear.fit(linear.labelled(docs, labels, label, rows), _once, linear.Ftrl(ALPHA, L1, pull=pull), EPOCHS, Counterfactuals(terms))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **parameters) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    Learns from labelled rows that aren't held out, at most `rows` of them; without any, all scores are 0.5 and predict 1 at the
    default threshold. A null or empty text has the score of the bias. Conflicting or missing labels teach nothing. A null doc_id is scored
    like others, long texts whole, repeated rows each for themselves. Columns beside doc_id and text are ignored; an empty table gives an empty result.
    """
    weights = train(docs, labels, **parameters)
    return linear.score(docs, Scored(weights), weights, threshold)
