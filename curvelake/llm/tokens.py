"""Byte-level BPE ids of whole texts by the tokenizers library, with a cache of pre-tokens.

The library's pre-tokenizer splits a text by a fixed pattern and encodes each piece alone, so a piece's ids
never depend on its neighbours. Plain texts are split by classes of bytes, a batch at once, and each distinct piece is looked up
once a batch; a worker keeps the ids of pieces that it has seen. Texts with three blanks in a row, two at the end or other blanks than space and
newline are split by the pattern; texts with characters for which Python's and the library's character classes may differ, or that hold the
string of an added token, are encoded whole by the library.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Latin letters only: in these ranges every character but the two signs is a letter in Unicode.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: The library's alternatives; the commonest comes first, as no other one can begin where it does.
_PIECES = re.compile(rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_OTHER = re.compile(rf"[^\t-\r\x20-\x7e{_LETTERS}]")
#: What a plain text doesn't hold, in RE2: longer runs of blanks are pieces of their own.
_UNEVEN = rf"[^\n\x20-\x7e{_LETTERS}]|[ \n]{{3}}|[ \n]{{2}}\z"
#: Classes of a plain text's bytes: blanks 0 and 1, letters 2, digits 3, others 4.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 2
_CLASS[48:58] = 3
_CLASS[[10, 32]] = 0, 1
#: Bytes that a worker keeps of pieces and their ids, and the longest piece that it keeps.
CACHED_BYTES, LONGEST = 160 << 20, 64
#: Bytes of text that go to encode at once: the more, the fewer pieces are looked up.
TEXT_BYTES = 4 << 20


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def plain_pieces(raw: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the pieces of plain texts, laid end to end, begin: at blanks, and where the class changes but behind a space."""
    kind = _CLASS[raw]
    first = np.ones(len(raw), bool)
    first[1:] = (kind[1:] < 2) | ((kind[1:] != kind[:-1]) & (kind[:-1] != 1))
    opens = np.zeros(len(raw) + 4, bool)
    opens[text_starts] = opens[len(raw) :] = True
    first |= opens[: len(raw)]
    at = np.flatnonzero((raw == 39) & first)
    if len(at):
        ahead = np.concatenate([raw, np.zeros(3, np.uint8)])
        one, two = ahead[at + 1], ahead[at + 2]
        short = np.isin(one, [100, 109, 115, 116]) & ~opens[at + 1]
        long = (((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108))) & ~opens[at + 1] & ~opens[at + 2]
        first[at[short | long] + 1] = False
        behind = np.concatenate([at[short] + 2, at[long] + 3])
        first[behind[behind < len(raw)]] = True
    return np.flatnonzero(first)


class Encoder:
    """added: whether the string of an added token in a text becomes that token, as the library has it by default, or ordinary ids."""

    def __init__(self, path: str, added: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.pieces: dict[str, bytes] = {}
        self.held = 0
        #: By id: the bytes that it stands for. The alphabet of byte-level BPE has one character for each byte.
        self.widths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.vocabulary)], np.int64)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces; words go to the library as one text and come apart by the bytes of its ids.

        A piece whose space a letter follows is a word: laid end to end, such pieces are split as they were.
        """
        words, rest = [], []
        for p in pieces:
            (words if p[0] == " " and p[1:2].isalpha() else rest).append(p)
        if words:
            ids = np.frombuffer(self._ids(["".join(words)])[0], self.dtype)
            ends = np.cumsum([len(w.encode()) for w in words])
            reached = np.cumsum(self.widths[ids])
            last = np.searchsorted(reached, ends)
            if not np.array_equal(reached[last], ends):
                raise ValueError("the tokenizer isn't byte-level or joins words")
            raw, last = ids.tobytes(), ((last + 1) * self.dtype.itemsize).tolist()
            self.pieces.update(zip(words, (raw[a:b] for a, b in zip([0, *last], last))))
        self.pieces.update(zip(rest, self._ids(rest)))

    def _known(self, pieces: list[str]) -> list[bytes]:
        coded = list(map(self.pieces.get, pieces))
        at = [i for i, x in enumerate(coded) if x is None]
        if at:
            new = list(dict.fromkeys(pieces[i] for i in at))
            self._learn(new)
            for i in at:
                coded[i] = self.pieces[pieces[i]]
            for p in new:
                if len(p) > LONGEST:
                    del self.pieces[p]
                else:
                    self.held += 160 + len(p)  # two objects with their slots
        return coded

    def _even(self, texts: pa.LargeStringArray) -> list[bytes]:
        """Texts without any of _UNEVEN."""
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if ends[0] == ends[-1]:
            return [b""] * len(texts)
        raw, ends = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
        starts = plain_pieces(raw, ends[:-1])
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)).dictionary_encode()
        ids = pa.array(self._known(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pieces.indices)
        reached = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :]
        edges = reached[np.searchsorted(starts, ends)].tolist()
        coded = memoryview(ids.buffers()[2])
        return [bytes(coded[a:b]) for a, b in zip(edges, edges[1:])]

    def _uneven(self, text: str) -> bytes:
        if _OTHER.search(text) or any(a in text for a in self.added):
            return self._ids([text])[0]
        return b"".join(self._known(_PIECES.findall(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian, in self.dtype."""
        if self.held > CACHED_BYTES:
            self.pieces.clear()
            self.held = 0
        column = pa.array(texts, pa.large_string())
        uneven = pc.match_substring_regex(column, _UNEVEN)
        for a in self.added:
            uneven = pc.or_(uneven, pc.match_substring(column, a))
        even = iter(self._even(column.filter(pc.invert(uneven))))
        return [self._uneven(t) if x else next(even) for t, x in zip(texts, uneven.to_pylist())]

    def sentence_ends(self) -> tuple[np.ndarray, np.ndarray]:
        """By id: whether its text ends a sentence, and whether its text begins with white space."""
        ends, opens = np.zeros(self.vocabulary, bool), np.zeros(self.vocabulary, bool)
        for i in range(self.vocabulary):
            t = self.tokenizer.id_to_token(i) or ""
            ends[i] = t.endswith((".", "!", "?", "Ċ"))
            opens[i] = t.startswith(("Ġ", "Ċ"))
        return ends, opens


@cache
def encoder(path: str, added: bool = True) -> Encoder:
    return Encoder(path, added)


def give_back() -> None:
    """Returns freed memory to the system: glibc and Arrow keep it until they are told."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def forget() -> None:
    """Drops a worker's encoders with all their pieces: Spark reuses its workers for later steps, which need that memory."""
    encoder.cache_clear()
    give_back()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with freed memory given back when it ends: idle workers stay beside those of the next steps."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
