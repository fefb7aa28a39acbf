"""Viterbi against brute force over characters, the trie against a dict, and exact round trips."""

import collections
import struct
import time
import zlib

import numpy as np
import pytest
import sentencepiece

from curvelake.llm import sentence_pieces as sp
from curvelake.llm.tokens import tokenizer_path
from tests.llm.test_operators import KIND, ROWS


def best_ids(m, text):
    piece = {m.bytes_of[i].decode(): (i, s) for i, s in zip(m.ids.tolist(), m.scores.tolist())}
    t = sp.MARK + text.replace(" ", sp.MARK)
    best, back = [0.0] + [-np.inf] * len(t), [None] * (len(t) + 1)
    for s in range(len(t)):
        for e in range(s + 1, min(len(t), s + 48) + 1):
            p = piece.get(t[s:e])
            if p and best[s] + p[1] > best[e]:
                best[e], back[e] = best[s] + p[1], (s, [p[0]])
        if t[s] not in piece and best[s] + m.unknown > best[s + 1]:
            best[s + 1], back[s + 1] = best[s] + m.unknown, (s, [m.byte_ids[c] for c in t[s].encode()])
    out, e = [], len(t)
    while e:
        e, ids = back[e]
        out = ids + out
    return out


@pytest.fixture(scope="module")
def model():
    return sp.model(tokenizer_path("piece_bpe_32k.model"))


@pytest.mark.parametrize("text", ["hello world", "  two  spaces ", "日本語 😀 ééx", "don't stop.\nnew\tline", "x" * 90 + " y", "ü" * 50])
def test_best_segmentation(model, text):
    ids = model.encode([text])[0]
    assert np.frombuffer(ids, "<u2").tolist() == best_ids(model, text) and model.decode(ids) == text


def test_small_vocabulary_prefers_scores():
    m = sp.Model([None, ("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -3.0), ("▁a", -2.5), ("c", -9.0)], None)
    assert np.frombuffer(m.encode(["ab"])[0], "<u2").tolist() == [1, 4]  # -4 against -4.5 and -5
    assert np.frombuffer(m.encode(["z"])[0], "<u2").tolist() == [1, 0]
    with pytest.raises(ValueError, match="marker"):
        sp.Model([("a▁b", -1.0)], None)


def test_trie_equals_a_dict():
    rng = np.random.default_rng(0)
    words = list({bytes(rng.integers(97, 101, int(n)).astype(np.uint8)) for n in rng.integers(1, 9, 800)} | {bytes([c]) for c in range(0, 256, 3)})
    trie = sp.DoubleArray(words)
    for i, w in enumerate(words):
        assert trie.find(w) == i
    assert all(trie.find(w + b"zz") == -1 for w in words)


def test_query_over_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, KIND)
    got = sp.encode_pieces(docs, with_ids=True).collect()
    assert len(got) == len(ROWS) and all(r.round_trip for r in got)
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in ROWS)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_pieces == len(r.ids) for r in got)
    assert {r.n_pieces for r, x in zip(got, ROWS) if not x[1]} <= {r.n_pieces for r in got}
    assert sp.encode_pieces(docs.where("false")).count() == 0


def field(number, kind, value):
    key = bytes([number << 3 & 0x7F | kind]) if number < 16 else bytes([number << 3 & 0x7F | kind | 0x80, number >> 4])
    if kind == 2:
        size, head = len(value), b""
        while size > 127:
            head, size = head + bytes([size & 127 | 128]), size >> 7
        return key + head + bytes([size]) + value
    return key + (struct.pack("<f", value) if kind == 5 else bytes([value]))


@pytest.fixture(scope="module")
def unigram_file(tmp_path_factory):
    """A unigram file with byte fallback: all short stretches of the fixture's words, with made-up log scores."""
    rng = np.random.default_rng(9)
    found = {sp.MARK}
    for _, t, *_ in ROWS[:60]:
        for w in (t or "").split()[:200]:
            w = sp.MARK + w
            found |= {w[i:j] for i in range(min(len(w), 30)) for j in range(i + 1, min(len(w), i + 5) + 1)}
    found -= {w for w in found if sp.MARK in w[1:]} | {"日", "😀"}
    kinds = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{c:02X}>", 0.0, 6) for c in range(256)), *((w, float(rng.uniform(-12, -1) * len(w) ** 0.5), 1) for w in sorted(found))]
    raw = b"".join(field(1, 2, field(1, 2, w.encode()) + field(2, 5, s) + field(3, 0, k)) for w, s, k in kinds)
    raw += field(2, 2, field(3, 0, 1) + field(35, 0, 1)) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))
    path = tmp_path_factory.mktemp("unigram") / "unigram.model"
    path.write_bytes(raw)
    return str(path)


def test_ids_are_those_of_a_unigram_library(unigram_file):
    library = sentencepiece.SentencePieceProcessor(model_file=unigram_file)
    m = sp.model(unigram_file)
    texts = [r[1] for r in ROWS if r[1] and "\t" not in r[1]][:90] + ["日本 w1 😀", "unseen zzz", "w1" * 90]
    assert [np.frombuffer(c, m.dtype).tolist() for c in m.encode(texts)] == library.encode(texts)
    assert [m.decode(c) for c in m.encode(texts)] == texts


def test_long_stretches_are_solved_like_short_ones(model):
    for t in ("中文字符测试没有空格的文章" * 4, "ü😀x" * 9, "abcdefgh" * 8):
        raw = (sp.MARK + t).encode()
        assert model._long(raw) == model._viterbi([raw])[0]


def test_a_long_text_without_spaces(model):
    text = "中文字符测试没有空格的文章" * 26_000
    began = time.perf_counter()
    assert model.decode(model.encode([text])[0]) == text and time.perf_counter() - began < 5


def test_a_vocabulary_over_16_bits():
    m = sp.Model([(f"{sp.MARK}{i}", -1.0) for i in range(70_001)], None)
    ids = m.encode(["70000 5 69999"])[0]
    assert np.frombuffer(ids, m.dtype).tolist() == [70_000, 5, 69_999] and m.decode(ids) == "70000 5 69999"


def test_cache_is_bounded_by_bytes(monkeypatch):
    m = sp.Model([(c, -1.0) for c in "▁abc"], None)
    monkeypatch.setattr(sp, "CACHED_BYTES", 1000)
    for i in range(300):
        m.encode(["abc"[i % 3] * (i % 30 + 1)])
    assert len(m.seen) < 8
    m.encode(["a" * 500])
    assert all(len(k) <= sp.TOGETHER for k in m.seen)
