"""License scans by a positional index of template words.

Templates are characteristic stretches of license texts. The document frequency of each of their words comes from one
pass over all documents, and gives its IDF. The index has, for every template, the positions of its words. Each template whose
mandatory phrases stand in a document is tried by itself at all places near them: all its words vote, and votes that agree on
a start, give or take a few words, align it. Its score is the part of its IDF mass found in place. Votes are summed over all such places at
once, word by word, so a text of many phrases costs a few passes over its words.
Plain phrases are searched beside, by their words; their labels always stay.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Phrases whose words must stand consecutively, and the label of each; fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label, mandatory phrases, text: fixed excerpts of the licenses' own notices.
TEMPLATES = (
    ("mit", ("permission is hereby granted free of charge to any person obtaining a copy",), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", ("licensed under the apache license version 2 0",), "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl-notice", ("under the terms of the gnu general public license",), "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version of the license or at your option any later version"),
    ("lgpl", ("gnu lesser general public license",), "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", ("redistribution and use in source and binary forms",), "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("mpl-2.0", ("mozilla public license",), "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("isc", ("permission to use copy modify and or distribute this software",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-4.0", ("creative commons attribution 4 0",), "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", ("creative commons attribution sharealike",), "this work is licensed under the creative commons attribution sharealike license"),
    ("unlicense", ("released into the public domain",), "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("agpl", ("gnu affero general public license",), "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("zlib", ("provided as is without any express or implied warranty",), "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("boost", ("to any person or organization obtaining a copy",), "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("cc0", ("copyright and related and neighboring rights",), "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide this software is distributed without any warranty"),
)

#: Words by which an alignment may be off; least score of a label; least votes of an alignment.
SLACK, LEAST_SCORE, LEAST_VOTES = 3, 0.5, 3

_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""
    return text.translate(_TABLE).split()


def occurrences(line: bytes, phrase: bytes) -> list[int]:
    """Where a phrase's words stand consecutively; line is " w0 w1 ... wn " and phrase " p0 ... pk "."""
    found, i = [], line.find(phrase)
    while i >= 0:
        found.append(i)
        i = line.find(phrase, i + 1)
    return found


@dataclass
class Index:
    """Template words by place, and what each weighs."""

    templates: tuple = TEMPLATES
    frequency: dict[bytes, int] = field(default_factory=dict)
    documents: int = 0

    def __post_init__(self) -> None:
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.lines, self.phrases = [], []
        for t, (_, phrases, text) in enumerate(self.templates):
            words = words_of(text.encode())
            self.lines.append(words)
            self.phrases.append([b" " + b" ".join(words_of(p.encode())) + b" " for p in phrases])
            for i, w in enumerate(words):
                self.postings[w].append((t, i))
        self.postings = dict(self.postings)
        self.idf = {w: math.log((1 + self.documents) / (1 + self.frequency.get(w, 0))) + 1 for w in self.postings}
        self.mass = [sum(self.idf[w] for w in words) for words in self.lines]

    def scan(self, words: list[bytes], line: bytes) -> dict[str, float]:
        """Labels of the aligned templates with their scores."""
        places: dict[bytes, np.ndarray] = {}
        best: dict[str, float] = {}
        n = len(words)
        for t, (lined, phrases) in enumerate(zip(self.lines, self.phrases)):
            if not all(p in line for p in phrases):
                continue
            if not places:
                found = defaultdict(list)
                for i, w in enumerate(words):
                    if w in self.postings:
                        found[w].append(i)
                places = {w: np.array(x) for w, x in found.items()}
            starts = self.starts(t, n, line)
            near, hit = np.zeros(len(starts), np.int64), np.zeros(len(starts))
            for k, w in enumerate(lined):
                at = places.get(w)
                if at is not None:
                    votes = np.searchsorted(at, starts + k + SLACK, "right") - np.searchsorted(at, starts + k - SLACK)
                    near += votes
                    hit += np.where(votes > 0, self.idf[w], 0.0)
            score = float(hit[near >= min(LEAST_VOTES, len(lined))].max(initial=0.0)) / self.mass[t]
            if score >= LEAST_SCORE:
                label = self.templates[t][0]
                best[label] = max(best.get(label, 0.0), min(1.0, score))
        return best

    def starts(self, t: int, n_words: int, line: bytes) -> np.ndarray:
        """Where a template may start, so that all its phrases, which are in the line, stand in its stretch; ascending."""
        size = len(self.lines[t])
        if not self.phrases[t]:
            return np.arange(-size, n_words)
        # Places from -(size + SLACK) on; each phrase adds one to the places that it allows.
        base, allowed = size + SLACK, np.zeros(n_words + size + 2 * SLACK + 2, np.int64)
        for p in self.phrases[t]:
            last = size + SLACK - p.count(b" ") + 1
            at = np.array(_indices(line, occurrences(line, p)))
            edge = np.zeros(len(allowed) + 1, np.int64)
            np.add.at(edge, np.maximum(at - last + base, 0), 1)
            np.add.at(edge, at + SLACK + 1 + base, -1)
            allowed += np.cumsum(edge[:-1]) > 0
        return np.flatnonzero(allowed == len(self.phrases[t])) - base


def _frequencies(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in batches:
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                n += 1
                seen.update(vocabulary.intersection(words_of(t)))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([None, *seen], pa.binary()), pa.array([n, *seen.values()], pa.int64())], names=["word", "n"])

    return run


def build(docs: DataFrame, templates: tuple = TEMPLATES) -> Index:
    """The index, with document frequencies of the template words over all documents; the driver gets a row for each such word."""
    plain = Index(templates)
    counted = shared.texts(docs).select("text").mapInArrow(_frequencies(frozenset(plain.postings)), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in counted}
    return Index(templates, {w: n for w, n in found.items() if w is not None}, found.get(None, 0))


_SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, templates: tuple = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Counts and places of the phrases, and all labels, of every row.

    score is the highest score of an aligned template, or 1 where a phrase stands, or 0. A null or empty text has no words: its places are
    null, its labels empty strings. Ties: of equal scores any is the same. Long texts are scanned whole. A null doc_id is scanned like others; repeated rows have a result each. Columns beside
    doc_id and text are ignored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(build(docs, templates))
    wanted = [(b" " + b" ".join(words_of(p.encode())) + b" ", label) for p, label in phrases.items()]

    def one(index: Index, text: bytes) -> tuple:
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        starts, base = [], set()
        for phrase, label in wanted:
            at = occurrences(line, phrase)
            if at:
                base.add(label)
                starts += [line.count(b" ", 0, i) for i in at] if len(at) < 8 else _indices(line, at)
        found = index.scan(words, line)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), 1.0 if base else max(found.values(), default=0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                rows = list(zip(*(one(index, t) for t in part.column("text").cast(pa.binary()).to_pylist())))
                kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(rows, kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return shared.texts(docs).mapInArrow(run, _SCAN)


def _indices(line: bytes, at: list[int]) -> list[int]:
    """Word index at each of many ascending places, in one pass over the line."""
    out, n, last = [], 0, 0
    for i in at:
        n += line.count(b" ", last, i)
        out.append(n)
        last = i
    return out
