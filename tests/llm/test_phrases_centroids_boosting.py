"""Phrase mining, centroid clustering and boosted trees against brute force, with nulls, ties, repeats and empty tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from codefootprint.llm import boosting, centroids, phrases, queries
from codefootprint.llm.store import Store


# phrases


def counts_of(rows, longest=3):
    """Occurrences per (lang, words) and all words per language, one word at a time."""
    found, words = collections.Counter(), collections.Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            run = tuple(re.findall(r"[^ \t]+", piece))
            words[lang or "und"] += len(run)
            found.update((lang or "und", run[i : i + n]) for n in range(1, longest + 1) for i in range(len(run) - n + 1))
    return found, words


def ranked(rows, longest, threshold, first):
    found, words = counts_of(rows, longest)
    out = []
    for lang in sorted(words):
        held = {p: n for (la, p), n in found.items() if la == lang and len(p) > 1 and n >= threshold}
        kept = []
        for p, a in held.items():
            longer = [n for q, n in held.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * n >= 50 * a for n in longer):
                continue
            cuts = [(1_000_000 * a * a // (found[lang, p[:k]] * found[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), found[lang, p[:k]], found[lang, p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -s))
    return out


def mined(spark, rows, **settings):
    docs = spark.createDataFrame([(la, t, "clash", 1) for la, t in rows], "lang string, text string, phrase string, n int").repartition(5)
    return sorted(tuple(r) for r in phrases.mine_phrases(docs, **settings).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def noise(seed, texts):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünder", "字", "New", "York", "a b", "x\x1cy"]
    for i in range(texts):
        words = rng.choice(vocabulary, rng.integers(0, 60), p=np.r_[np.full(30, 0.7 / 30), np.full(6, 0.05)])
        yield ["en", "de", None, "und"][i % 4], "".join(w + rng.choice([" ", " ", " ", "\t", ". ", "\n", ", "]) for w in words)


@pytest.mark.parametrize(("shards", "longest", "threshold"), [(3, 3, 10), (1, 3, 4), (4, 4, 5)])
def test_phrases_against_brute_force(spark, shards, longest, threshold):
    rows = [*noise(5, 160), ("en", None), (None, ""), ("de", " .;\n"), *[("en", "one hot line, again one hot line")] * 60]
    assert mined(spark, rows, shards=shards, longest=longest, threshold=threshold, first=25) == ranked(rows, longest, threshold, 25)


def test_phrases_cut_long_texts_and_many_languages(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 64)
    rows = [(f"l{i % 9}", f"alpha beta gamma{i % 2}, " * 9 + "unbroken " * 40) for i in range(27)]
    batches = [pa.RecordBatch.from_pydict({"lang": [la for la, _ in rows], "text": [t for _, t in rows]})]
    found = collections.Counter()
    for lang, part in phrases._chunks(iter(batches)):
        pieces = phrases.Pieces(lang, part)
        for size in (1, 2, 3):
            words, n, _ = pieces.counted(pieces.starts(size), size) if len(pieces.starts(size)) else ([], [], None)
            for w, k in zip(words.to_pylist() if len(n) else [], n):
                found[lang, tuple(w.split(" "))] += int(k)
    assert found == counts_of(rows)[0]


def test_shared_slots_lose_no_phrase(spark, monkeypatch):
    """With 4 slots every phrase shares one: activation comes early, counts stay right."""
    rows = [*noise(8, 80), *[("en", "seldom seen words")] * 12]
    few = lambda self, at, size, plain=phrases.Pieces.slots: plain(self, at, size) & 3
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(phrases.Pieces, "slots", few)
    want = {(la, " ".join(p), n, len(p)) for (la, p), n in counts_of(rows)[0].items() if n >= 10}
    assert {tuple(r) for r in phrases.count_phrases(docs, Store(spark, "t"))[0].collect()} == want


def test_longer_phrases_start_after_their_parts(spark):
    """A phrase's first scan lies behind the one in which both its parts reached the threshold."""
    rows = [*noise(3, 200)]
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("coalesce(lang, 'und') as lang", "text", "pmod(xxhash64(text), 3) as shard")
    active = [np.full(1 << phrases.SLOT_BITS, phrases.NEVER, dtype=np.uint8) for _ in range(2)]
    told = lambda: spark.sparkContext.broadcast([zlib.compress(t.tobytes()) for t in active])
    first = phrases._scan(docs, 0, 3, told(), 3)
    sized = lambda df: {(len(r.key.split("\n")[0].split(" ")), r.since) for r in df.collect()}
    assert sized(first) == {(1, 0)}
    active[0][phrases._reached(first.groupBy("key").sum("n").where("`sum(n)` >= 5"), 1)] = 1
    assert sized(phrases._scan(docs, 1, 3, told(), 3)) == {(1, 0), (2, 1)}


def test_phrases_of_no_rows(spark):
    assert mined(spark, [("en", "a b"), (None, None)]) == []
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.mine_phrases(empty).collect() == []


# centroids


def lloyd(rows, k=40, rounds=5):
    """Whole numbers only, one vector and centroid at a time."""
    kept = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for n, members in groups.items():
            centers[n] = [sum(column) // len(members) for column in zip(*members)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = collections.Counter()
    for _, c, d in got:
        inertia[c] += d
    name = lambda c: hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), name(c)) for i, c, d in got), key=str)


def vectors(seed, n, groups=6, spread=0.02):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (groups, 64))
    return [(i, (middles[i % groups] + rng.normal(0, spread, 64)).astype(np.float32).tolist()) for i in range(n)]


ODD = [
    (900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, [float("nan")] + [0.0] * 63), (904, [float("inf")] + [0.0] * 63),
    (905, [None] + [0.0] * 63), (906, []), (None, [0.5] * 64), (None, [0.25] * 64), (907, [-0.0] * 64), (908, [2000.5] * 64),
]


def test_clusters_against_brute_force(spark, tmp_path):
    rows = vectors(1, 150) + ODD + [(77, [0.1] * 64)] * 90  # a third are copies of one vector
    frame = spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v int")
    frame.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_centroids(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == lloyd(rows)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster_vectors(spark.createDataFrame([], schema)).collect() == []
    assert centroids.cluster_vectors(spark.createDataFrame(ODD[:7], schema)).collect() == []
    two = centroids.cluster_vectors(spark.createDataFrame(vectors(2, 2), schema)).collect()
    assert sorted((r.cluster, r.distance, r.inertia) for r in two) == [(0, 0, 0), (1, 0, 0)]


def test_large_components_are_exact():
    rng = np.random.default_rng(0)
    v, c = rng.integers(-(1 << 27), 1 << 27, (9, 64)), rng.integers(-(1 << 27), 1 << 27, (4, 64))
    assert centroids.distances(v, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]


def test_boxes_leave_few_candidates_and_never_the_nearest():
    rows = np.floor(256 * np.array([v for _, v in vectors(4, 1200, groups=12)])).astype(np.int64)
    keys = centroids.hilbert_keys(((rows - rows.min(0)) / (np.ptp(rows, axis=0) + 1) * 4).astype(np.int64), 2)
    rows = rows[np.lexsort(keys.T[::-1])]
    middles = rows[:: 1200 // 40][:40]
    share = []
    for k in range(0, 1200, 50):
        block = rows[k : k + 50]
        near = centroids.candidates(block.min(0), block.max(0), middles)
        share.append(len(near))
        assert set(centroids.distances(block, middles).argmin(1)) <= set(near)
    assert min(share) <= 4 and np.mean(share) < 30  # a block within one group against one that holds several


def test_hilbert_neighbours_differ_in_one_step():
    bits, width = 3, 2
    cells = np.array(list(itertools.product(range(1 << bits), repeat=width)))
    order = np.lexsort(centroids.hilbert_keys(cells, bits).T[::-1])
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


# boosted trees


def test_trees_learn_and_flat_walk_equals_a_plain_one():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = boosting.grow(x, y, trees=20, depth=3)

    def plain(row):
        total = model.base
        for t in range(len(model.leaf)):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(row[model.statistic[t, node]] > model.border[t, node])
            total += model.leaf[t, node - 7]
        return total

    assert np.allclose(model.raw(x), [plain(r) for r in x])
    assert ((model.raw(x) > 0) == y).mean() > 0.97


def test_statistics_against_plain_counts(monkeypatch):
    texts = ["One two two. One\n\n two two.\nSIX  sechs!", "", None, "é ü ß ###", "a" * 40, " \n\t ", "x y z x y z x y z\n" * 9]
    whole = boosting.statistics_of(texts)
    at = {n: k for k, n in enumerate(boosting.FEATURES)}
    assert whole.shape == (len(texts), len(boosting.FEATURES)) and np.isfinite(whole).all()
    assert np.allclose(whole[1], 0) and np.allclose(whole[2], whole[1])
    for row, text in zip(whole, texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [re.findall(r"[^\x20\x09-\x0D]+", x) for x in (text or "").split("\n")]
        lines = [tuple(x) for x in lines if x]
        assert math.isclose(row[at["log_words"]], math.log1p(len(words))) and math.isclose(row[at["log_lines"]], math.log1p(len(lines)))
        if words:
            assert math.isclose(row[at["distinct_words"]] * math.sqrt(len(words)), len(set(words)))
            assert math.isclose(row[at["commonest_word"]] * len(words), max(collections.Counter(words).values()))
            assert math.isclose(row[at["distinct_pairs"]] * len(words), len(set(zip(words, words[1:]))))
            assert math.isclose(row[at["distinct_triples"]] * len(words), len(set(zip(words, words[1:], words[2:]))))
            assert math.isclose(row[at["repeated_lines"]], 1 - len(set(lines)) / len(lines), abs_tol=1e-12)
            assert math.isclose(row[at["same_as_before"]] * len(words), sum(a == b for a, b in zip(words, words[1:])))
    monkeypatch.setattr(boosting, "SEGMENT", 7)
    assert np.allclose(boosting.statistics_of(texts), whole)
    assert np.allclose(np.vstack([boosting.statistics_of([t]) for t in texts]), whole)


def test_quality_trees_tell_junk(spark):
    rng = np.random.default_rng(1)
    good = lambda i: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(60)) + "."
    rows = [(i, good(i) if i % 3 else ("spam " * 60 if i % 2 else "x# $$ &&& " * 20)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, 9, "q") for i, t in rows] + [(None, "no id", 9, "q"), (800, None, 9, "q"), (801, "", 9, "q"), (5, rows[5][1], 9, "q")], "doc_id long, text string, quality int, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    got = boosting.score_quality(docs.repartition(3), labels).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 300:
            assert (r.score > 0.5) == (r.doc_id % 3 > 0)
    blank = {r.doc_id: r.score for r in got}
    assert blank[800] == blank[801]


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in boosting.score_quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r.predicted for r in boosting.score_quality(docs, one).collect()} == {1}
    assert boosting.score_quality(docs.limit(0), one).collect() == []
