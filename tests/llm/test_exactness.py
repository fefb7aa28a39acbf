"""Words made to collide, rows that repeat, null ids, clashing column names, hot groups, and plain versions of the scorers."""

import collections
import hashlib
import math
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curvelake.llm import components, exact_dedup, jaccard_join, linear, quality_classifier, quality_rules, substring_dedup, textvec, toxicity
from tests.llm.test_operators import KIND, ROWS, WORDS, brute_components, brute_removed, labelled_fixture, prose


def thue_morse(n, a, b):
    return [b if i.bit_count() & 1 else a for i in range(n)]


COLLIDING = ["".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))]


def hashes(words):
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(words)])], names=["text"])
    return [h for _, _, x in textvec.slices(batch) for h in x.words().hashes().tolist()]


def test_patterned_words_and_windows_do_not_collide():
    for size in (8, 64, 1024, 4096):
        pair = ["".join(thue_morse(size, *ab)) for ab in ("ab", "ba")]
        assert len(set(hashes(pair))) == 2
    for size in (32, 2048, 4096):
        a, b = (np.array(hashes(thue_morse(size, *ab)), np.uint64) for ab in (("x", "y"), ("y", "x")))
        assert textvec.windows(a, size)[0] != textvec.windows(b, size)[0]


def test_windows_are_those_of_equal_words():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 3, 400)]
    h = np.array(hashes(words), np.uint64)
    for k in (1, 2, 3, 7, 9, 50):
        g = textvec.windows(h, k).tolist()
        assert len(g) == len(words) - k + 1
        seen = {}
        for i, x in enumerate(g):
            assert seen.setdefault(x, tuple(words[i : i + k])) == tuple(words[i : i + k])
        assert len(seen) == len({tuple(words[i : i + k]) for i in range(len(g))})
    half = textvec.windows(h, 25)
    assert (textvec.windows(h, 50, (25, half)) == textvec.windows(h, 50)).all()


def test_colliding_words_are_not_repeats(spark):
    common = [f"w{i}" for i in range(24)]
    rows = [(i, " ".join([*common, word, *common, f"w{i}"])) for i, word in enumerate(COLLIDING)]
    rows += [(9, " ".join(thue_morse(2048, "x", "y"))), (10, " ".join(thue_morse(2048, "y", "x")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, kept = brute_removed(rows, 50)
    assert {r.doc_id: r.kept_text for r in substring_dedup.remove_repeats(docs).collect()} == {i: k for (i, _), k in zip(rows, kept)}
    alone = spark.createDataFrame(list(enumerate(COLLIDING)), "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(alone).collect()} == {(0, 0), (1, 1)}
    assert exact_dedup.exact_dedup(alone).count() == 2


def test_levels_double_until_no_candidate_is_left(spark, tmp_path):
    assert substring_dedup.levels(50) == [13, 25] and substring_dedup.levels(50, 3) == [4, 7, 13, 25] and substring_dedup.levels(9) == []
    from curvelake.llm import shared

    rng = np.random.default_rng(2)
    passage = prose(rng, 60, 9999)
    for shared_words, ran in ((passage, [4, 7, 13, 25]), (" ".join(passage.split()[:10]), [4, 7, 13]), ("", [4])):
        rows = [(i, i, f"{prose(np.random.default_rng(10 + i), 80, 10**9)} {shared_words} {prose(np.random.default_rng(90 + i), 80, 10**9)}") for i in range(2)]
        marks = spark.createDataFrame(rows, "row long, doc long, text string").mapInArrow(substring_dedup._marks(50, [4, 7, 13, 25]), substring_dedup._marks_schema(4, extra=", x long, y long"))
        left, levels = substring_dedup.candidates(marks, shared.Workspace(spark, "levels"), [4, 7, 13, 25])
        # Anchors of shorter repeats may survive a level or two by chance, never to the last one.
        assert (levels == ran or ran != [4, 7, 13, 25]) and (left.count() > 0) == (ran == [4, 7, 13, 25])


@pytest.mark.parametrize("shortest", [2, 5, 60])
def test_any_first_level_gives_the_same(spark, shortest):
    docs = spark.createDataFrame(ROWS, KIND)
    _, kept = brute_removed(ROWS, 20)
    got = collections.Counter((r.doc_id, r.kept_text) for r in substring_dedup.remove_repeats(docs, 20, shortest).collect())
    assert got == collections.Counter((r[0], k) for r, k in zip(ROWS, kept))


def test_repeated_rows_go(spark):
    for rows, left in (([(1, "x y"), (1, "x y")], [(1, "x y")]), ([(0, "X"), (1, "X"), (1, "Y")], [(0, "X"), (1, "Y")]), ([(None, "a b"), (None, "a  b"), (3, None), (None, "")], [(3, None)])):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        for f in (exact_dedup.exact_dedup, jaccard_join.near_dedup):
            got = sorted(((r.doc_id, r.text) for r in f(docs).collect()), key=str)
            if rows[0][0] is None:  # empty texts are equal, but not linked by shingles
                assert len(got) == (2 if f is exact_dedup.exact_dedup else 3) and (3, None) in got
            else:
                assert got == left


def test_clashing_columns(spark):
    names = ["doc_id", "text", "_gone", "_", "rest", "_doc", "row", "doc", "key", "hash", "node", "grp", "whole", "c0", "c1", "Text", "n_chars"]
    docs = spark.createDataFrame([(r[0], r[1], *range(13), "x", 7) for r in ROWS[:40]] * 2, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names[2:15]) + ", Text string, n_chars int")
    for f in (exact_dedup.exact_dedup, jaccard_join.near_dedup, substring_dedup.drop_repeats):
        got = f(docs)
        assert got.columns == names and {tuple(r)[2:16] for r in got.collect()} == {(*range(13), "x")}
    assert exact_dedup.exact_groups(docs).count() == jaccard_join.jaccard_components(docs).count() == substring_dedup.remove_repeats(docs).count() == 80


def test_null_ids_are_no_hot_key(spark):
    docs = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a b c d e f g "), F.expr("repeat(concat('w', id % 10000, ' '), 55)")).alias("text"))
    began = time.perf_counter()
    assert jaccard_join.near_dedup(docs).count() == exact_dedup.exact_dedup(docs).count() == 10_000
    assert substring_dedup.drop_repeats(docs).count() == 30_000  # no doc_id is smaller for a null one
    assert time.perf_counter() - began < 120


def test_a_large_group_of_near_copies(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} n{i}") for i in range(300)] + [(1000 + i, f"{text} " + " ".join(f"m{j}" for j in range(i))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = collections.Counter(brute_components(rows))
    for limits in ({}, {"task_classes": 20, "task_shingles": 600}):
        assert collections.Counter(map(tuple, jaccard_join.jaccard_components(docs, **limits).collect())) == want


def test_tree_descends_to_few_nodes():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**60, int(rng.integers(40, 400)), dtype=np.uint64)) for _ in range(1500)]
    points = jaccard_join.points(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets]))).astype(np.int32)
    tree = jaccard_join.CountTree(points)
    assert len(tree.levels) > 2 and len(tree.levels[-1][1]) == 1 and sorted(np.concatenate(tree.leaves).tolist()) == list(range(1500))
    none = np.zeros(len(tree.leaves), bool)
    for q in range(0, 1500, 50):
        found = set(tree.near(points[q], int(points[q].sum()), none, 85, 100).tolist())
        n, m = points[q].sum(), points.sum(1)
        bound = np.minimum(points, points[q]).sum(1)
        want = np.flatnonzero((100 * np.minimum(n, m) >= 85 * np.maximum(n, m)) & (bound >= jaccard_join.least_overlap(m, n)))
        assert found == set(want.tolist()) and q in found
    assert tree.visited < 30 * len(tree.leaves) / 2


def test_components_of_a_long_chain(spark):
    from curvelake.llm import shared

    edges = spark.range(3000).select((F.col("id") * 7 % 3001).alias("a"), ((F.col("id") + 1) * 7 % 3001).alias("b")).repartition(5)
    got = components.components(edges, shared.Workspace(spark, "chain"))
    assert got.count() == 3001 and {r.component for r in got.collect()} == {0}


def test_hot_keys_are_combined(spark):
    texts = ["long text " * 400 if i % 3 else f"text {i}" for i in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(30)
    got = exact_dedup.exact_groups(docs, owner_bytes=8_000, bucket_keys=4, held_bytes=10).toPandas()
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    count = collections.Counter(texts)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    for r in got.itertuples():
        t = texts[r.doc_id]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (first[t], count[t], r.doc_id == first[t], hashlib.sha256(norm(t).encode()).hexdigest())


def test_index_file_has_directory_buckets_and_chains(tmp_path):
    index = exact_dedup.ExtendibleHash(capacity=3)
    keys = [hash(("k", i)) for i in range(400)]
    for i, k in enumerate(keys):
        for j in range(1 + i % 3):  # texts of equal key make a chain
            index.insert(k, b"%d-%d" % (i, j), hashlib.sha256(b"%d-%d" % (i, j)).digest(), i, j, 1)
    f = exact_dedup.IndexFile(f"file://{tmp_path}", exact_dedup.write_index(f"file://{tmp_path}", index))
    wanted = [(k, hashlib.sha256(b"%d-%d" % (i, j)).digest(), i, j) for i, k in enumerate(keys) for j in range(1 + i % 3)]
    at = f.find(np.array([w[0] for w in wanted]), [w[1] for w in wanted])
    assert [(int(e["least"]), int(e["run"])) for e in f.entries[at]] == [(w[2], w[3]) for w in wanted]
    assert len(f.directory) == 1 << index.depth and len(f.starts) - 1 == sum(1 for _ in index.buckets())


# Plain versions of the scorers: a dict of weights, one feature after another.


def one_hash(word):
    raw = np.frombuffer(word, np.uint8)
    return textvec.spans(raw, np.array([0]), np.array([len(raw)]))


def bucket(h, salt):
    return int(linear.bucket(h, salt)[0])


def shape(word):
    kinds = bytes(0x61 if 0x61 <= c < 0x7B or c >= 0x80 else 2 if 0x41 <= c < 0x5B else 3 if 0x30 <= c < 0x3A else c for c in word)
    kinds = bytes(1 if c == 0x61 else c for c in kinds)
    return one_hash(re.sub(rb"(.)\1+", rb"\1", kinds, flags=re.S))


def quality_features(text):
    w = [x.encode() for x in WORDS.findall(text)]
    h, s = [one_hash(x) for x in w], [shape(x) for x in w]
    pair = lambda a: [textvec.windows(np.concatenate(p), 2) for p in zip(a, a[1:])]
    three = [textvec.windows(np.concatenate(p), 3) for p in zip(s, s[1:], s[2:])]
    same = [np.array([1 if a[0] == b[0] else 2], np.uint64) for a, b in zip(h, h[1:])]
    out = collections.Counter()
    for salt, grams in ((1, h), (2, s), (3, pair(h)), (4, pair(s)), (5, three), (6, same)):
        for g in grams:
            out[bucket(g, salt)] += quality_classifier.SCALE / len(grams)
    return out


def toxic_features(text):
    low = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in text.encode())
    out = {}
    for w in re.findall(rb"[\x30-\x39\x61-\x7a\x80-\xff]+", low):
        out[bucket(one_hash(w), 1)] = 1.0
        for k in toxicity.PREFIXES:
            if len(w) > k:
                out[bucket(one_hash(w[:k]), k)] = 1.0
    return out


@pytest.mark.parametrize("module, features, scored, threshold", [(quality_classifier, quality_features, None, 0.3), (toxicity, toxic_features, toxicity.Scored, 0.5)])
def test_scores_equal_a_dict_of_weights(spark, module, features, scored, threshold):
    texts, labels = labelled_fixture(spark)
    w = module.train(texts, labels)
    rows = [*ROWS[:58], *[(r.doc_id, r.text) for r in texts.limit(60).collect()]]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1)
    got = linear.score(docs, scored(w) if scored else module.features, w, threshold).collect()
    by = dict(zip(range(len(w)), w.tolist()))
    seen = set()
    for r, (_, t, *_) in zip(got, rows):
        s = by[len(w) - 1] + sum(by[f] * v for f, v in features(t or "").items())
        want = 1 / (1 + math.exp(-max(-35, min(35, s))))
        assert r.score == pytest.approx(want, abs=1e-5) and r.predicted == int(r.score >= threshold)
        seen.add(r.predicted)
    assert seen == {0, 1}


def test_log_ratio_equals_plain_counts(spark):
    rows = [(r[0], r[1]) for r in ROWS[:58] if r[0] is not None]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int")

    def grams(t):
        w = [x.encode() for x in WORDS.findall(t or "")]
        h, s = [one_hash(x) for x in w], [shape(x) for x in w]
        two = lambda a: [textvec.windows(np.concatenate(p), 2) for p in zip(a, a[1:])]
        return [int(textvec.mix(g ^ np.uint64(salt))[0]) >> 64 - quality_rules.BITS for salt, of in ((1, h), (2, s), (3, two(h)), (4, two(s))) for g in of]

    import zlib

    raw, trusted = collections.Counter(), collections.Counter()
    found = {i: grams(t) for i, t in rows}
    for i, g in found.items():
        raw.update(g)
        if i % 3 == 0 and zlib.crc32(str(i).encode()) % 5:
            trusted.update(g)
    n = 1 << quality_rules.BITS

    def log_p(c, k):
        total = sum(c.values())
        return math.log((c[k] + quality_rules.SMOOTHING * total / n) / (total * (1 + quality_rules.SMOOTHING)))

    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    for r in got:
        g = found[r.doc_id]
        want = sum(log_p(trusted, k) - log_p(raw, k) for k in g) / max(1, len(g))
        assert r.llr == pytest.approx(want, abs=1e-4) and (abs(want - quality_rules.THRESHOLD) < 1e-3 or r.kept == (not r.base_failed and want >= quality_rules.THRESHOLD))


def test_workers_give_memory_back(monkeypatch):
    """At a step's end, also of one that is left early; packing also before it divides the ids, when its texts are gone."""
    import pyarrow as pa

    from curvelake.llm import packing, tokens

    told = []
    monkeypatch.setattr(tokens, "give_back", lambda: told.append("given"))
    run = tokens.tidy(lambda batches: (told.append(b) or b for b in batches))
    assert list(run(iter([1, 2]))) == [1, 2] and told == [1, 2, "given"]
    left = run(iter([3, 4]))
    next(left)
    left.close()
    assert told[3:] == [3, "given"]
    told.clear()
    monkeypatch.setattr(packing, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("One", (), {"partitionId": staticmethod(lambda: 0)}))}))
    monkeypatch.setattr(packing, "candidates", lambda *a, real=packing.candidates: told.append("cut") or real(*a))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a word. And more", ""]}, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    pieces = list(packing._pack(tokens.tokenizer_path(), 1, 2048, True)(iter([batch])))
    assert told == ["given", "given", "cut"] and [b.column("doc_id").to_pylist() for b in pieces] == [[1, 2]]
