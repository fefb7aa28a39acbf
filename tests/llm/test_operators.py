"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties, repeated rows and odd columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pytest

from curvelake.llm import exact_dedup, jaccard_join, license_scan, linear, packing, quality_classifier, quality_rules, substring_dedup, textvec, token_files, toxicity
from curvelake.llm.tokens import encoder, tokenizer_path

KIND = "doc_id long, text string, lang string, source string, n_chars int, score double, kept boolean"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(i)}{'.' if i % 11 == 0 else ''}" for i in rng.integers(0, vocabulary, n))


def fixture_rows():
    rng = np.random.default_rng(5)
    texts = [None, "", " ", "\t\n", "one", "One  word", "a b c", "A b c", "a b 　 c d", "<|endoftext|> it's 12 x²½ 日本語 😀"]
    passage = prose(rng, 70)
    base = [prose(rng, int(n)) for n in rng.integers(5, 300, 40)]
    texts += base
    texts += [base[3], base[3], base[3].replace(" ", "\n ", 4), base[4].upper()]
    for k in range(12):  # near copies of one long text
        w = (base[0] + " " + base[1] + " " + base[2]).split()
        w[int(rng.integers(0, len(w)))] = f"new{k}"
        texts.append(" ".join(w))
    texts += [prose(rng, 60) + " " + passage + " " + prose(rng, 40) for _ in range(8)]
    texts += [prose(rng, 30) + " " + passage[: len(passage) // 2], "x " * 5000, prose(rng, 9000), "y" * 60_000]
    texts += [f"{prose(rng, 20)} Released under the MIT License. {prose(rng, 5)} cc-by apache\nlicense", "GNU General Public-License GNU general public license"]
    rows = [(10 * i, t, "en", f"s{i % 3}", len(t or ""), 0.5, True) for i, t in enumerate(texts)]
    return [*rows, (None, base[5], None, None, None, None, None), (None, None, None, None, None, None, None), (rows[20][0], rows[20][1], "xx", "y", 1, 0.1, False)]


ROWS = fixture_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def test_word_hashes_are_those_of_words():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[1] or "" for r in ROWS])], names=["text"])
    seen, back = {}, {}
    for lo, hi, x in textvec.slices(batch, limit=20_000):
        w = x.words()
        h = w.hashes()
        for d in range(hi - lo):
            want = WORDS.findall(ROWS[lo + d][1] or "")
            got = h[w.docs[d] : w.docs[d + 1]].tolist()
            assert len(want) == len(got)
            for a, b in zip(want, got):
                assert seen.setdefault(a, b) == b and back.setdefault(b, a) == a


# Exact dedup


def test_exact_groups(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[norm(r[1])].append(r[0])
    got = exact_dedup.exact_groups(docs, owner_bytes=20_000, bucket_keys=2).toPandas()
    assert len(got) == len(ROWS)
    assert got.groupby("text_sha256").kept.sum().eq(1).all()
    for t, ids in groups.items():
        part = got[got.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert len(part) == len(ids) and (part.group_size == len(ids)).all()
        assert (part.keep_id == min(known)).all() if known else part.keep_id.isna().all()
        assert set(part[part.kept].doc_id.dropna()) == ({min(known)} if known else set())


def test_exact_dedup_keeps_columns(docs, empty):
    left = exact_dedup.exact_dedup(docs)
    assert left.columns == docs.columns and left.where("text = 'one'").count() == 1
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


def test_extendible_hash_splits_and_chains():
    index = exact_dedup.ExtendibleHash(capacity=2)
    for i in range(500):
        index.insert(i % 50, b"t%d" % i, "", i, i, 1)
    index.insert(7, b"t7", "", -1, 9, 2)
    found = [e for _, b in index.buckets() for chain in b.chains.values() for e in chain]
    assert len(found) == 500 and max(len(b.chains) for _, b in index.buckets()) <= 2 and index.depth >= 5
    assert [(e.least, e.size) for e in found if e.text == b"t7"] == [(-1, 3)]


# Substrings


def brute_removed(rows, window):
    words = [WORDS.findall(r[1] or "") for r in rows]
    key = [float("inf") if r[0] is None else r[0] for r in rows]
    least = {}
    for k, w in zip(key, words):
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            least[g] = min(least.get(g, k), k)
    out = []
    for k, w in zip(key, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < k:
                gone.update(range(i, i + window))
        out.append(" ".join(x for i, x in enumerate(w) if i not in gone))
    return words, out


@pytest.mark.parametrize("window", [50, 9])
def test_remove_repeats(docs, window):
    words, kept = brute_removed(ROWS, window)
    got = collections.Counter(tuple(r) for r in substring_dedup.remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", "kept_text").collect())
    assert got == collections.Counter((r[0], len(w), len(w) - len(WORDS.findall(k)), k) for r, w, k in zip(ROWS, words, kept))


def test_drop_repeats_keeps_other_texts(docs, empty):
    words, kept = brute_removed(ROWS, 50)
    want = collections.Counter((r[0], r[1] if len(WORDS.findall(k)) == len(w) else k) for r, w, k in zip(ROWS, words, kept) if not w or k)
    got = substring_dedup.drop_repeats(docs)
    assert got.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter({(i, t or ""): n for (i, t), n in want.items()} | {(i, ""): sum(n for (j, t), n in want.items() if j == i and not t) for i, t in want if not t})
    assert substring_dedup.remove_repeats(empty).count() == 0 and substring_dedup.drop_repeats(empty).count() == 0


# Jaccard


def brute_components(rows, k=4, num=85, den=100):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for r in rows:
        w = WORDS.findall((r[1] or "").translate(low))
        sets.append(frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for x, r in zip(label, rows):
        least[x] = min(least.get(x, float("inf")), float("inf") if r[0] is None else r[0])
    return [(r[0], len(s), None if least[x] == float("inf") else least[x]) for r, s, x in zip(rows, sets, label)]


@pytest.mark.parametrize("limits", [{}, {"task_shingles": 700, "task_classes": 3}])
def test_jaccard_components(docs, limits):
    got = jaccard_join.jaccard_components(docs, **limits).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_components(ROWS))


def test_near_dedup(docs, empty):
    left = jaccard_join.near_dedup(docs)
    named = {c for i, _, c in brute_components(ROWS) if i is not None}
    assert left.columns == docs.columns and {r.doc_id for r in left.select("doc_id").collect()} - {None} == named & {r[0] for r in ROWS}
    assert jaccard_join.jaccard_components(empty).count() == 0 and jaccard_join.near_dedup(empty).count() == 0


def test_forest_equals_all_pairs():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**40, 80, dtype=np.uint64)) for _ in range(10)]
    sets = [np.unique(np.concatenate([b[: len(b) - int(rng.integers(0, 12))], rng.integers(0, 2**40, int(rng.integers(0, 8)), dtype=np.uint64)])) for b in base for _ in range(9)]
    label = list(range(len(sets)))
    for a, b in jaccard_join.links(sets, None):
        label = [label[b] if x == label[a] else x for x in label]
    true = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                true = [true[j] if x == true[i] else x for x in true]
    assert [label.index(x) for x in label] == [true.index(x) for x in true]


# Tokens, packing


def library_ids(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


def whole_ids(end):
    return [np.append(x, end).astype("<u4") for x in library_ids([r[1] or "" for r in ROWS])]


END = "<|endoftext|>"


def test_ids_of_mixed_texts_are_the_library_s():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    parts = ["a", "word", "The", " ", " ", " ", "\n", "  ", "'", "'s", "'ll", "s", "re", ",", ".", "12", "é", "ß", "I'm", "-", "\t", "\r", END, "中", "×"]
    texts = ["", *("".join(rng.choice(parts[: rng.choice((8, 20, 25))]) for _ in range(rng.randint(0, 14))) for _ in range(4000))]
    e = encoder(tokenizer_path())
    got = [x for k in range(0, len(texts), 100) for x in e.encode(texts[k : k + 100])]
    want = [x.ids for x in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, e.dtype).tolist() for x in got] == want


def test_added_tokens_are_the_library_s():
    texts = [END, f"{END} hi", f"hi {END}", f"a{END}b", f"x  {END}{END}  y", f"{END[:-1]} hi {END}", "<|endoftext |>", "plain words here", f"日本{END} x", "it's 12 x²½", "", " "]
    want = library_ids(texts)
    e = encoder(tokenizer_path())
    assert [np.frombuffer(c, e.dtype).tolist() for c in e.encode(texts)] == want and 50256 in want[1]
    plain = encoder(tokenizer_path(), False).encode([f"{END} hi"])[0]
    assert 50256 not in np.frombuffer(plain, e.dtype).tolist()


def test_token_files_round_trip(docs, empty, tmp_path):
    folder = f"file://{tmp_path}/set"
    manifest = token_files.write_token_files(docs, folder, shard_ids=5000)
    assert manifest.count() > 1
    got = token_files.read_token_files(manifest, folder, with_ids=True).orderBy("start").collect()
    ids = whole_ids(0)
    want = collections.Counter((r[0], x.tobytes()) for r, x in zip(ROWS, ids))
    assert collections.Counter((r.doc_id, np.array(r.ids, "<u4").tobytes()) for r in got) == want
    assert [r.start for r in got] == np.append(0, np.cumsum([r.n_tokens for r in got]))[:-1].tolist()
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    assert token_files.read_token_files(token_files.write_token_files(empty, f"file://{tmp_path}/none"), f"file://{tmp_path}/none").count() == 0


def test_rank_coding():
    for n in (0, 1, 3, 4, 5, 999):
        x = (np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64) >> np.arange(n, dtype=np.uint64) % np.uint64(32)).astype("<u4")
        assert (token_files.decode_ranks(*token_files.encode_ranks(x), n) == x).all()


def test_packing(docs, empty):
    got = packing.pack(docs, range_bytes=40_000).toPandas()
    ids = collections.defaultdict(collections.Counter)
    for r, x in zip(ROWS, whole_ids(1)):
        ids[r[0]][x.tobytes()] += 1
    for i, part in got[got.doc_id.notna()].groupby("doc_id"):
        if sum(ids[i].values()) == 1:
            x = np.frombuffer(next(iter(ids[i])), "<u4")
            part, at = part.sort_values("start"), 0
            for p in part.itertuples():
                assert p.start == at and p.doc_tokens == len(x) and p.ids_crc32 == zlib.crc32(x[at : at + p.length].tobytes())
                at += p.length
            assert at == len(x)
    assert got.length.sum() == sum(len(x) for x in whole_ids(1))
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length
    assert by.sum().max() <= 2048 and (by.cumsum() - got.sort_values(["sequence_id", "offset"]).length == got.sort_values(["sequence_id", "offset"]).offset).all()
    assert packing.pack(empty).count() == 0


def test_only_long_sentences_are_cut_inside():
    at, cost = packing.candidates(np.array([40, 90]), np.array([10, 60]), 32)
    assert at.tolist() == [0, 10, 40, 60, 90] and cost.tolist() == [0, packing.SENTENCE_COST, 0, packing.SENTENCE_COST, 0]
    at, _ = packing.candidates(np.array([100]), np.array([10]), 32)
    assert at.tolist() == [0, 10, 26, 42, 58, 74, 90, 100]


def test_cuts_are_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(20):
        at = np.unique(np.append(0, rng.integers(1, 120, 25)))
        cost = rng.integers(0, 9, len(at))
        pad = lambda n: 0 if n & (n - 1) == 0 else 32 - n
        at = at[np.append(True, np.diff(at) <= 32)]
        while (np.diff(at) > 32).any():
            at = np.unique(np.append(at, at[:-1][np.diff(at) > 32] + 20))
        cost = np.resize(cost, len(at))
        best = [0]
        for j in range(1, len(at)):
            best.append(min(best[i] + pad(int(at[j] - at[i])) for i in range(j) if at[j] - at[i] <= 32) + int(cost[j]) + packing.SEQUENCE_COST)
        cuts = packing.best_cuts(at, cost, 32)
        assert cuts[0] == 0 and cuts[-1] == len(at) - 1
        assert best[-1] == sum(pad(int(at[j] - at[i])) + int(cost[j]) + packing.SEQUENCE_COST for i, j in zip(cuts, cuts[1:]))


# Quality rules, licences


def test_quality_rules_base(spark, docs, empty):
    labels = spark.createDataFrame([(10 * i, i % 2, 0) for i in range(60)] + [(None, 1, 1), (30, None, None)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(docs, labels)
    want = collections.Counter()
    for r in ROWS:
        t = r[1] or ""
        w = WORDS.findall(t)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want[(r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))] += 1
    assert collections.Counter(tuple(r)[:7] for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()) == want
    assert got.where("kept and base_failed").count() == 0 and quality_rules.quality_rules(empty, labels).count() == 0
    assert quality_rules.quality_rules(docs, labels.limit(0)).where("llr <> 0").count() == 0


def test_quality_ratio_separates(spark):
    rng = np.random.default_rng(2)
    rows = [(i, prose(rng, 80) if i % 2 else " ".join(f"{x}###" for x in prose(rng, 80).split())) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), labels).where("not base_failed").toPandas()
    assert (got.kept == (got.doc_id % 2 == 1)).all()


def test_license_scan(docs, empty):
    phrases = license_scan.PHRASES
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want = collections.Counter()
    for r in ROWS:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (r[1] or "").translate(low))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        want[(r[0], len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))] += 1
    got = license_scan.license_scan(docs).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 for r in got)
    assert license_scan.license_scan(empty).count() == 0


def test_license_templates_align(spark):
    _, _, text = next(t for t in license_scan.TEMPLATES if t[0] == "bsd")
    whole, scattered = "noise " * 50 + text + " noise" * 20, " ".join(sorted(text.split()))
    got = license_scan.license_scan(spark.createDataFrame([(1, whole), (2, scattered), (3, "redistribution and use in source and binary forms")], "doc_id long, text string")).toPandas().set_index("doc_id")
    assert got.labels[1] == "bsd" and got.score[1] > 0.9 and got.labels[2] == "" and got.labels[3] == ""


def test_license_scan_of_a_long_text_of_phrases():
    words = [w for t in license_scan.TEMPLATES for w in license_scan.words_of(t[2].encode())]
    words = (words * (500_000 // len(words) + 1))[:500_000]
    began = time.perf_counter()
    found = license_scan.Index(documents=9).scan(words, b" " + b" ".join(words) + b" ")
    assert set(found) == {t[0] for t in license_scan.TEMPLATES} and time.perf_counter() - began < 30


def test_license_bundle_has_every_template(spark):
    rng = np.random.default_rng(6)
    every = license_scan.TEMPLATES
    bundles = [every, every[:10], [t for t in every if t[0] in ("mit", "bsd", "mpl-2.0", "lgpl", "isc")], *([a, b] for a in every for b in every if a < b)]
    texts = [f" {prose(rng, 30)} ".join(t[2] for t in b) for b in bundles]
    # one word of each notice is inserted or gone
    texts += [" ".join(w for i, w in enumerate(x.split()) if i % 23) for x in texts] + [" ".join(f"{w} odd" if i % 23 == 0 else w for i, w in enumerate(x.split())) for x in texts]
    got = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id")
    for k, b in enumerate(bundles):
        assert got.labels[k] == ",".join(sorted({t[0] for t in b} | set(filter(None, got.base_labels[k].split(",")))))
    index = license_scan.Index(frequency={b"gnu": 2, b"the": 90}, documents=100)
    for text in texts[:3] + texts[len(bundles) : len(bundles) + 3] + texts[2 * len(bundles) :: 7]:
        words = license_scan.words_of(text.encode())
        line = b" " + b" ".join(words) + b" "
        want = {}
        for t, (label, _, _) in enumerate(license_scan.TEMPLATES):
            lined, slack = index.lines[t], license_scan.SLACK
            for start in range(-len(lined), len(words)):
                stretch = b" " + b" ".join(words[max(0, start - slack) : max(0, start + len(lined) + slack)]) + b" "
                hits = [index.idf[w] for k, w in enumerate(lined) if w in words[max(0, start + k - slack) : max(0, start + k + slack + 1)]]
                if all(p in stretch for p in index.phrases[t]) and len(hits) >= license_scan.LEAST_VOTES and sum(hits) / index.mass[t] >= license_scan.LEAST_SCORE:
                    want[label] = max(want.get(label, 0.0), min(1.0, sum(hits) / index.mass[t]))
        assert index.scan(words, line) == pytest.approx(want) and (want or text not in texts[:3])


# Classifiers


def labelled_fixture(spark):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(600):
        t = prose(rng, int(rng.integers(20, 60)))
        bad = i % 4 == 0
        if bad:
            t = " ".join(f"{x}@@" for x in t.split())
        toxic = i % 3 == 0
        t += " muslims are grubbish people." if toxic else ""
        rows.append((i, t))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_hold_out(spark, docs, empty):
    texts, labels = labelled_fixture(spark)
    for f, column in ((quality_classifier.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")):
        got = f(texts, labels).join(labels, "doc_id").toPandas()
        assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
        held = got[got.held_out]
        assert (held.predicted == held[column]).mean() > 0.97
        assert f(docs, labels).count() == len(ROWS) and f(docs, labels).where("score is null or score < 0 or score > 1").count() == 0
        assert f(empty, labels).count() == 0
        assert {r.score for r in f(docs, labels.limit(0)).select("score").collect()} == {0.5}


def test_counterfactuals_clear_group_names(spark):
    texts, labels = labelled_fixture(spark)
    neutral = spark.createDataFrame([(1, "many muslims live here"), (2, "many women live here")], "doc_id long, text string")
    score = {pull: toxicity.linear.score(neutral, toxicity.Scored(w), w, 0.5).toPandas().score for pull in (0.0, 4.0) for w in [toxicity.train(texts, labels, pull=pull)]}
    assert abs(score[4.0][0] - score[4.0][1]) < abs(score[0.0][0] - score[0.0][1]) and score[4.0][0] < score[0.0][0]
    assert toxicity.Counterfactuals()("Women vote. It rains.") == [("women vote", "men vote")]


def test_ftrl_matches_its_definition():
    m = linear.Ftrl(0.5, 0.1, 0.2)
    m.update(np.array([3]), np.array([2.0]), 1)
    g = (0.5 - 1) * 2.0
    assert m.z[3] == pytest.approx(g) and m.n[3] == pytest.approx(g * g)
    assert m.weights(np.array([3]))[0] == pytest.approx((0.1 * -1 - g) / ((1 + abs(g)) / 0.5 + 0.2))


def test_quality_keep_filters_rows(spark, docs):
    texts, labels = labelled_fixture(spark)
    kept = quality_classifier.keep_good(docs, labels)
    scores = quality_classifier.quality_scores(docs, labels)
    assert kept.columns == docs.columns and kept.count() == scores.where("predicted = 1").count()


def one_each(rows, groups):
    """Of each group the row of the least doc_id, null last; rows of group None stay."""
    best = {}
    for i, ((doc, *_), g) in enumerate(zip(rows, groups)):
        key = (doc is None, doc or 0, i)
        if g is not None and key < best.get(g, (True, float("inf"), 0)):
            best[g] = key
    return [r for i, (r, g) in enumerate(zip(rows, groups)) if g is None or best[g][2] == i]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(4)
    kind = KIND + ", _gone int, _ int, rest int, _doc int"
    spark.createDataFrame([(*r, 1, 2, 3, 4) for r in [*ROWS, *ROWS[-12:]]], kind).write.parquet(f"{tmp_path}/documents.parquet")
    bad = [(1001 + i, " ".join(f"{x}@@" for x in prose(rng, 40).split())) for i in range(40)]
    spark.createDataFrame([(i, t, "en", "s", len(t), 0.0, False, 1, 2, 3, 4) for i, t in bad], kind).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in ROWS] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scored = quality_classifier.quality_scores(now, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    good = quality_classifier.keep_good(now, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    assert collections.Counter(r.doc_id for r in good) == collections.Counter(r.doc_id for r in scored if r.predicted)
    left = [(r.doc_id, r.text) for r in good]
    assert not {i for i, _ in bad} & {i for i, _ in left} and sum(i is None for i, _ in left) > 2
    left = one_each(left, [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in left])
    far = [(k, t) for k, (_, t) in enumerate(left)]  # by place, so that null ids have components too
    left = one_each(left, [c if n else None for _, n, c in brute_components(far, 5, 80)])
    words, shorter = brute_removed(left, 50)
    left = [(i, t if len(WORDS.findall(k)) == len(w) else k) for (i, t), w, k in zip(left, words, shorter) if not w or k]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram jaccard join", "substring dedup", "packing"]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    want = collections.Counter()
    for (i, _), x in zip(left, library_ids([t or "" for _, t in left])):
        want[-1 if i is None else i] += len(x) + 1
    assert pieces.fillna({"doc_id": -1}).groupby("doc_id").length.sum().to_dict() == want
    assert isinstance(pieces, pd.DataFrame)
