"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback.

A space becomes the marker U+2581, and one marker goes before a text. Where no piece of the vocabulary has a marker behind another
character, no piece crosses the place before a marker, so the best segmentation of a text is that of its stretches; a worker keeps
the ids of short stretches that it has seen. New ones are solved together, the trie walked for all of them at once, start by start; long
ones, as of scripts without spaces, by a loop over their bytes. A character that no piece covers alone costs ten less than the least
score and becomes the pieces of its bytes. Ties go to the piece that begins first.

Scores are log probabilities. A file of merge ranks has none: there a piece of rank r gets -log(r + 1), the law of Zipf, as merges come in the
order of frequency. A unigram file's scores are taken as they stand.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared, textvec, tokens

MARK = "▁"
_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Bytes that a worker keeps of stretches and their ids.
CACHED_BYTES = 128 << 20
#: Stretches up to so many bytes are solved together and kept, longer ones alone.
TOGETHER = 40
PENALTY = 10.0


class DoubleArray:
    """Trie of byte strings: from state s byte c leads to base[s] + c if check there is s; value is the string's number or -1."""

    def __init__(self, strings: list[bytes]) -> None:
        children: dict[bytes, set[int]] = {}
        for s in strings:
            for i in range(len(s)):
                children.setdefault(s[:i], set()).add(s[i])
        number = {s: i for i, s in enumerate(strings)}
        base, check, value = [0] * 1024, [-1] * 1024, [-1] * 1024
        check[0] = -2
        free, last, top, places = 1, 1, 1, [(b"", 0)]
        for name, at in places:
            value[at] = number.get(name, -1)
            codes = sorted(children.get(name, ()))
            if not codes:
                continue
            # A state of one child takes the first free slot; others are tried behind the last of their kind, then put at the end.
            while check[free] != -1:
                free += 1
            slot = max(free if len(codes) == 1 else last, codes[0] + 1)
            tries = 0
            while check[slot] != -1 or any(check[slot - codes[0] + c] != -1 for c in codes[1:]):
                tries += 1
                slot = slot + 1 if tries < 32 else max(top, codes[0] + 1)
            if len(codes) > 1:
                last = slot if tries < 32 else slot + 1
            top = max(top, slot - codes[0] + codes[-1] + 1)
            b = base[at] = slot - codes[0]
            for c in codes:
                check[b + c] = at
                places.append((name + bytes([c]), b + c))
            more = b + 1024 - len(check)
            if more > 0:
                base += [0] * (more + 4096)
                check += [-1] * (more + 4096)
                value += [-1] * (more + 4096)
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))
        self.longest = max(map(len, strings), default=0)

    def find(self, s: bytes) -> int:
        at = 0
        for c in s:
            to = int(self.base[at]) + c
            if self.check[to] != at:
                return -1
            at = to
        return int(self.value[at])


class Model:
    """pieces: text and log score of each id, None for ids that no text gives; byte_ids: the ids of the 256 bytes, or None."""

    def __init__(self, pieces: list[tuple[str, float] | None], byte_ids: list[int] | None) -> None:
        known = [(p[0].encode(), i) for i, p in enumerate(pieces) if p and p[0]]
        if any(MARK in p[0].lstrip(MARK) for p in pieces if p):
            raise ValueError("a piece has a marker behind another character")
        self.trie = DoubleArray([s for s, _ in known])
        self.ids = np.array([i for _, i in known], np.int32)
        self.scores = np.array([pieces[i][1] for i in self.ids.tolist()], float)
        self.unknown = float(self.scores.min()) - PENALTY
        self.byte_ids = byte_ids
        self.bytes_of = [b""] * len(pieces)
        for s, i in known:
            self.bytes_of[i] = s
        for c, i in enumerate(byte_ids or ()):
            self.bytes_of[i] = bytes([c])
        self.dtype = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
        self.seen: dict[str, bytes] = {}
        self.held = 0
        self._lists: tuple[list, ...] | None = None

    def solve(self, stretches: list[str]) -> list[bytes]:
        """The ids of each stretch, little-endian, in self.dtype."""
        raw = [s.encode() for s in stretches]
        out: list[bytes] = [b""] * len(raw)
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        short = [i for i in order if len(raw[i]) <= TOGETHER]
        for g in (short[i : i + 4096] for i in range(0, len(short), 4096)):
            for i, ids in zip(g, self._viterbi([raw[i] for i in g])):
                out[i] = ids
        for i in order[len(short) :]:
            out[i] = self._long(raw[i])
        return out

    def _long(self, raw: bytes) -> bytes:
        """One stretch, by a walk over its bytes."""
        if self._lists is None:
            self._lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist()
        base, check, value, scores = self._lists
        n, none = len(raw), -math.inf
        best, back, piece = [none] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            here, c = best[s], raw[s]
            if here == none:
                continue
            one = s + (1 if c < 0xC0 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)
            at, alone = 0, False
            for d in range(s, n):
                to = base[at] + raw[d]
                if check[to] != at:
                    break
                at = to
                v = value[at]
                if v >= 0:
                    alone = alone or d + 1 == one
                    score = here + scores[v]
                    if score > best[d + 1]:
                        best[d + 1], back[d + 1], piece[d + 1] = score, s, v
            if not alone and here + self.unknown > best[one]:
                best[one], back[one], piece[one] = here + self.unknown, s, -1
        ids, known, at = [], self.ids, n
        while at:
            v, s = piece[at], back[at]
            if v >= 0:
                ids.append(int(known[v]))
            else:
                ids += [self.byte_ids[c] for c in reversed(raw[s:at])] if self.byte_ids else [0]
            at = s
        return np.array(ids[::-1], self.dtype).tobytes()

    def _viterbi(self, raw: list[bytes]) -> list[bytes]:
        m, size = len(raw), np.array([len(r) for r in raw])
        n = int(size.max(initial=0))
        x = np.zeros((m, n + 1), np.int32)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        x[np.arange(n + 1)[None, :] < size[:, None]] = flat
        lead = (x & 0xC0) != 0x80
        width = 1 + (x >= 0xC0) + (x >= 0xE0) + (x >= 0xF0)
        best = np.full((m, n + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((m, n + 1), np.int32), np.full((m, n + 1), -1, np.int32)
        t = self.trie
        for s in range(n):
            rows = np.flatnonzero((s < size) & lead[:, s] & (best[:, s] > -np.inf))
            state, here = np.zeros(len(rows), np.int32), best[rows, s]
            alone = np.zeros(m, bool)
            all_rows = rows
            for d in range(s, min(n, s + t.longest)):
                to = t.base[state] + x[rows, d]
                ok = (t.check[to] == state) & (d < size[rows])
                rows, state, here = rows[ok], to[ok], here[ok]
                if not len(rows):
                    break
                v = t.value[state]
                hit = np.flatnonzero(v >= 0)
                r, v = rows[hit], v[hit]
                alone[r[width[r, s] == d + 1 - s]] = True
                score = here[hit] + self.scores[v]
                better = score > best[r, d + 1]
                r = r[better]
                best[r, d + 1], back[r, d + 1], piece[r, d + 1] = score[better], s, v[better]
            r = all_rows[~alone[all_rows]]
            end = s + width[r, s]
            score = best[r, s] + self.unknown
            better = score > best[r, end]
            r, end = r[better], end[better]
            best[r, end], back[r, end], piece[r, end] = score[better], s, -1
        at, steps, spans = size.copy(), [], []
        rows = np.arange(m)
        while at.any():
            live = at > 0
            steps.append(np.where(live, piece[rows, at], -2))
            before = np.where(live, back[rows, at], 0)
            spans.append(np.stack([before, at], 1))
            at = before
        if not steps:
            return [b""] * m
        found = np.stack(steps[::-1], 1)
        ids = np.where(found >= 0, self.ids[np.maximum(found, 0)], found)
        odd = (found == -1).any(1)
        count = (found > -2).sum(1)
        stream = ids[found > -2].astype(self.dtype).tobytes()
        ends = (self.dtype.itemsize * np.cumsum(count)).tolist()
        out = [stream[a:b] for a, b in zip([0, *ends], ends)]
        for i in np.flatnonzero(odd).tolist():
            got: list[int] = []
            for k in range(len(steps) - 1, -1, -1):
                a, b = spans[k][i].tolist()
                v = int(steps[k][i])
                if v >= 0:
                    got.append(int(self.ids[v]))
                elif v == -1:
                    got += [self.byte_ids[c] for c in raw[i][a:b]] if self.byte_ids else [0]
            out[i] = np.array(got, self.dtype).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > CACHED_BYTES:
            self.seen.clear()
            self.held = 0
        split = [_STRETCH.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        get = self.seen.get
        coded = [list(map(get, p)) for p in split]
        gaps = [[i for i, c in enumerate(k) if c is None] for k in coded]
        new = list({p[i] for p, at in zip(split, gaps) for i in at})
        if new:
            solved = dict(zip(new, self.solve(new)))
            for p, c, at in zip(split, coded, gaps):
                for i in at:
                    c[i] = solved[p[i]]
            for p, ids in solved.items():
                if len(p) <= TOGETHER:
                    self.seen[p] = ids
                    self.held += 240 + 2 * len(p) + len(ids)  # two objects with their slots
        return [b"".join(c) for c in coded]

    def decode(self, ids: bytes) -> str:
        """Text of ids: bytes of the pieces, markers as spaces, without the first one."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, self.dtype).tolist()))
        return raw.decode("utf-8", "replace").replace(MARK, " ")[1:]


def zipf(rank: float) -> float:
    """The log score of a piece of merge rank 0, 1, ..."""
    return -math.log(rank + 1)


@cache
def model(path: str) -> Model:
    """Pieces and log scores of a SentencePiece file. Merge ranks are known by their scores, whole numbers below 0."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    special = [p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i) for i in range(n)]
    scores = [p.get_score(i) for i in range(n) if not special[i]]
    ranks = all(s <= 0 and s == int(s) for s in scores)
    pieces = [None if special[i] else (p.id_to_piece(i), zipf(-p.get_score(i)) if ranks else p.get_score(i)) for i in range(n)]
    by = {p.id_to_piece(i): i for i in range(n) if p.is_byte(i)}
    return Model(pieces, [by[f"<0x{c:02X}>"] for c in range(256)] if len(by) == 256 else None)


_RESULT = "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean"


def encode_pieces(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, n_bytes (pieces of byte fallback), ids_crc32 (of little-endian 32-bit ids), round_trip and, if asked for, ids.

    round_trip: whether decoding gives the text again; only a text that holds the marker itself fails. A null or empty text has no pieces. A null
    doc_id and repeated rows are encoded like others, long texts whole; other columns are ignored; an empty table gives an empty result.
    """
    path = path or tokens.tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        m = model(path)
        is_byte = np.zeros(len(m.bytes_of), bool)
        is_byte[m.byte_ids or []] = True
        for batch in batches:
            for lo, hi, _ in textvec.slices(batch):
                texts = batch.column("text").slice(lo, hi - lo).to_pylist()
                coded = m.encode(texts)
                ids = [np.frombuffer(c, m.dtype) for c in coded]
                columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array([len(i) for i in ids], pa.int64()), pa.array([int(is_byte[i].sum()) for i in ids], pa.int64()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()), pa.array([m.decode(c) == t for c, t in zip(coded, texts)])]
                names = ["doc_id", "n_pieces", "n_bytes", "ids_crc32", "round_trip"]
                if with_ids:
                    columns.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return shared.texts(docs).mapInArrow(run, _RESULT + ", ids array<int>" * with_ids)
