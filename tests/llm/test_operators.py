"""Small fixtures against brute force, and the defined results for nulls, empty and long texts, ties and empty tables."""

import collections
import hashlib
import math
import re
import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from codefootprint.llm import decontamination, language, linededup, maxent, mixing, quality, simhash, substrings, tokencounts, toxicity
from codefootprint.llm.components import connected_components
from codefootprint.llm.store import Store, with_row

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, words int"
LONG = " ".join(f"w{i % 700}x{i}" for i in range(20_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards mix potions near an old stone bridge at night"
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta.\nshort\nAlpha beta gamma delta epsilon zeta.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \n\t ", "de", None),
    (5, LONG, "en", "b"),
    (6, f"start {PASSAGE} stop", "en", "b"),
    (7, f"other words here {PASSAGE} end", "en", None),
    (7, f"other words here {PASSAGE} end", "en", None),
    (8, f"start {PASSAGE} stop", "en", "a"),
    (9, "123 456 *** ###", None, "c"),
    (None, "no id but a text of its own", "en", "c"),
    (10, "é ü ß " * 40, "de", "a"),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, t, la, s, None, "clash", "clash", 1) for i, t, la, s in ROWS]
    path = str(tmp_path_factory.mktemp("docs") / "docs")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 1), (6, 0, 1), (7, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -5")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_empty_tables_give_no_rows(empty, labels, spark):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    results = [
        quality.judge_quality(empty, labels), maxent.score_held_out(empty), mixing.mix_sources(empty), simhash.near_duplicates(empty),
        linededup.repeated_lines(empty), toxicity.score_toxicity(empty, labels), language.identify_languages(empty),
        substrings.remove_repeats(empty), decontamination.find_leaks(empty, bench), tokencounts.count_tokens(empty),
        linededup.delete_repeated_lines(empty), simhash.keep_one_of_each(empty), mixing.mix_documents(empty), decontamination.drop_leaks(empty, bench),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_every_row_of_odd_tables_gets_a_row(docs, labels):
    for got in (
        quality.judge_quality(docs, labels), maxent.score_held_out(docs), toxicity.score_toxicity(docs, labels), language.identify_languages(docs),
        toxicity.score_toxicity(docs, labels.where("doc_id < 0")), tokencounts.count_tokens(docs),
    ):
        assert got.count() == len(ROWS)


def test_quality_counts_against_brute_force(docs, labels):
    text = dict((i, t) for i, t, *_ in ROWS)
    for r in quality.judge_quality(docs, labels).collect():
        w = words(text[r.doc_id])
        windows = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        repeated = {k for j in range(len(w) - 7) if windows[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        lines = [x for x in (text[r.doc_id] or "").split("\n") if WORD.search(x)]
        symbols = sum((text[r.doc_id] or "").count(c) for c in "#*$%&|<>")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated),
        )
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w)) and not (r.kept and r.base_failed)


def test_quality_cutoffs_hold_the_risk():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert quality.upper_bound(5, 5, 0.05) == quality.upper_bound(0, 0, 0.05) == 1.0
    rule = next(iter(quality.MEASURES))
    passed = {("s", m, 0): 10_000 for m in quality.MEASURES} | {("s", rule, 0): 9_990, ("s", rule, 7): 10}
    assert quality.choose_cutoffs(passed, {"s": 10_000})["s", rule] == quality.GRID[-1]
    passed[("s", rule, 7)] = 500
    assert quality.choose_cutoffs(passed, {"s": 10_000})["s", rule] == quality.GRID[7]
    assert quality.choose_cutoffs({}, {"s": 20}) == {}  # too few labels guarantee nothing


def test_maxent_base_and_normalisation(docs):
    text = {i: lower(t) for i, t, *_ in ROWS}
    counts = collections.Counter()
    for i, t, *_ in ROWS:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            counts.update(words(lower(t)) + ["\n"])
    total, kinds = sum(counts.values()), len(counts)
    for r in maxent.score_held_out(docs).collect():
        tokens = words(text[r.doc_id]) + ["\n"]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    weights = maxent.Weights(np.random.default_rng(1).normal(size=(maxent.FEATURE_BUCKETS, maxent.CLASSES)).astype("f4"), np.random.default_rng(2).normal(size=(maxent.FEATURE_BUCKETS, maxent.CLASS_WORDS)).astype("f4"))
    rows = maxent.feature_rows(np.arange(1, 9))[5:6]
    ids = np.concatenate([np.arange(maxent.WORD_CLASSES, maxent.CLASSES), maxent.CLASSES + np.arange(maxent.WORD_CLASSES * maxent.CLASS_WORDS)])
    assert np.exp(weights.log_probability(ids, np.repeat(rows, len(ids), axis=0))).sum() == pytest.approx(1, abs=1e-4)


def test_maxent_learns_from_every_token():
    for text in (None, "one", "two words", "a b c d e f g h i j k l m n o p q", LONG):
        tokens = maxent.tokens_of(text)
        places = np.concatenate([maxent.gradient_places(tokens, number, maxent.STRIDE) for number in range(maxent.ROUNDS)])
        assert sorted(places) == list(range(len(tokens)))


ODD_TEXTS = [t for _, t, *_ in ROWS] + ["\n", " lead", "trail ", "Tab\tA\x0bB\x0cC\r\nD", "\x1c\x1f \x85 \u2003X", "ß", "I\u0307 \u212a", "z" * 5000, None, ""]


def test_maxent_cuts_many_texts_as_one():
    texts, want = pa.array(ODD_TEXTS, pa.string()), [maxent.tokens_of(t) for t in ODD_TEXTS]
    for low, high in ((0, len(want)), (3, 9), (1, 2), (4, 4)):
        for kind in (pa.string(), pa.large_string()):
            tokens, lengths = maxent.tokens_in(texts.cast(kind).slice(low, high - low))
            assert tokens.to_pylist() == [t for own in want[low:high] for t in own] and lengths.tolist() == [len(own) for own in want[low:high]]
    runs = [*maxent.chunks_of(pa.array(ODD_TEXTS * 40, pa.string()))]
    assert [at for at, _ in runs] == [sum(len(t) for _, t in runs[:k]) for k in range(len(runs))]
    assert [t for _, run in runs for t in run.to_pylist()] == ODD_TEXTS * 40 and max(len(run) for _, run in runs) == maxent.CHUNK_TEXTS


def test_maxent_codes_of_frequent_and_rare_tokens():
    tokens = [t for text in ODD_TEXTS for t in maxent.tokens_of(text)]
    head = {t: (i, i if i < 3 else None) for i, t in enumerate(sorted({t for t in tokens if len(t) < 5}))}
    found = maxent.Codes(head).of(pa.array(tokens, pa.binary()))
    assert maxent.token_hashes(found).tolist() == [zlib.crc32(t) for t in tokens]
    assert (found >> 42).tolist() == [head.get(t, (maxent.HEAD,))[0] for t in tokens]
    place = [head.get(t, (None, None))[1] for t in tokens]
    assert maxent.kinds_of(found).tolist() == [maxent.spelling_class(t) if p is None else maxent.CLASSES + p for t, p in zip(tokens, place)]


def plain_step(table, rows, wanted, rate):
    """What a gradient step is, with one sum over all buckets by numpy's reduction."""
    x = sum(table[rows[:, k]] for k in range(rows.shape[1]))
    grad = np.exp(x - x.max(axis=1, keepdims=True))
    grad /= -grad.sum(axis=1, keepdims=True)
    grad[np.arange(len(wanted)), wanted] += 1
    order = np.argsort(rows.ravel(), kind="stable")
    keys, first, n = np.unique(rows.ravel()[order], return_index=True, return_counts=True)
    sums = np.add.reduceat(grad[order // rows.shape[1]], first, axis=0)
    table[keys] += (rate * sums / n[:, None] * np.minimum(1, n / 4)[:, None]).astype(np.float32)


def test_maxent_step_is_the_plain_step_in_less_time():
    rng = np.random.default_rng(3)
    rows = np.minimum(rng.zipf(1.4, (maxent.MINIBATCH, maxent.FEATURES)), 10**9) * 2654435761 % maxent.FEATURE_BUCKETS
    rows[:, 0], rows[:, 2] = 0, rng.integers(0, maxent.FEATURE_BUCKETS, len(rows))
    wanted = rng.integers(0, maxent.CLASSES, len(rows))
    start = rng.normal(size=(maxent.FEATURE_BUCKETS, maxent.CLASSES)).astype(np.float32)
    for some in (1, 2, 9, 100, len(rows)):
        got, want = start.copy(), start.copy()
        maxent.Weights._step(got, rows[:some], wanted[:some], 0.5)
        plain_step(want, rows[:some], wanted[:some], 0.5)
        np.testing.assert_allclose(got, want, rtol=1e-4, atol=1e-5)

    def seconds(step):
        took = []
        for _ in range(9):
            began = time.thread_time()
            step(start, rows, wanted, 0.5)
            took.append(time.thread_time() - began)
        return min(took)

    assert seconds(maxent.Weights._step) < 0.75 * seconds(plain_step)


def test_maxent_training_is_plain_descent(spark, docs):
    one = docs.select("text").coalesce(1)
    counts = maxent.count_tokens(one)
    texts = [maxent.tokens_of(r.text) for r in one.collect()]
    assert {bytes(r.token): r.c for r in counts.collect()} == collections.Counter(t for own in texts for t in own)
    head = maxent.head_table(counts)
    got, want = maxent.train(one, head), maxent.Weights.start()
    for number in range(maxent.ROUNDS):
        waiting = []

        def step(rate=maxent.RATE / (1 + number), waiting=waiting):
            ids = np.array([t for t, _ in waiting])
            rows = np.array([r for _, r in waiting])
            at = np.flatnonzero(ids >= maxent.CLASSES)
            kinds = np.where(ids >= maxent.CLASSES, (ids - maxent.CLASSES) // maxent.CLASS_WORDS, ids)
            plain_step(want.classes, rows, kinds, rate)
            if len(at):
                plain_step(want.words, want.word_rows(rows[at], kinds[at]), (ids[at] - maxent.CLASSES) % maxent.CLASS_WORDS, rate)
            waiting.clear()

        for own in texts:
            rows = maxent.feature_rows(maxent.hashes_of(own))
            for k in maxent.gradient_places(own, number):
                place = head.places.get(own[k])
                waiting.append((maxent.spelling_class(own[k]) if place is None else maxent.CLASSES + place, rows[k]))
            if len(waiting) >= maxent.MINIBATCH:
                step()
        if waiting:
            step()
    np.testing.assert_allclose(got.classes, want.classes, rtol=1e-3, atol=1e-4)
    np.testing.assert_allclose(got.words, want.words, rtol=1e-3, atol=1e-4)


def test_mix_meets_targets(docs):
    rows = mixing.mix_sources(docs).collect()
    assert sorted(r.size for r in rows) == sorted(len(words(t)) for _, t, *_ in ROWS)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    for own in by.values():
        assert sum(r.taken for r in own) == math.floor(own[0].target + 0.5) and own[0].target <= 3 * own[0].source_size
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)
    assert set(mixing.mix_documents(docs).columns) >= {"doc_id", "text", "fp", "words", "size", "taken"}


def test_connected_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 230)] + [(5, 5), (300, 229), (300, 229)]
    got = dict(connected_components(Store(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in [*range(200, 230), 300, 7]} == {7} and 5 not in got


def simhash_of(text):
    w = words(lower(text))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[j : j + 4]).encode(), 42) for j in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_against_brute_force(docs):
    ids = [i for i, *_ in ROWS]
    fps = [simhash_of(t) for _, t, *_ in ROWS]
    root = list(range(len(ids)))
    for _ in ids:
        for a in range(len(ids)):
            for b in range(len(ids)):
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    least = {r: min((ids[k] for k in range(len(ids)) if root[k] == r and ids[k] is not None), default=None) for r in root}
    want = sorted(((ids[k], f"{fps[k]:016x}", least[root[k]]) for k in range(len(ids))), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == want
    kept = simhash.keep_one_of_each(docs)
    # texts without words (2, 3 and 4) have fingerprint zero and are one component, of which 2 stays
    first = {i for i in least.values() if i is not None}
    assert kept.columns == docs.columns and {2} <= first and not {3, 4} & first
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(first)


def test_simhash_links_close_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base[:30]:
        for flips in (1, 2, 3, 4, 5, 6):
            fps.add(int(b) ^ sum(1 << int(k) for k in rng.choice(63, flips, replace=False)))
    fps = sorted(fps)
    store = Store(spark, "t")
    links = simhash.link_fingerprints(store, spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = dict(connected_components(store, links).collect())
    root = {f: f for f in fps}
    for _ in range(8):
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    assert {f: got.get(f, f) for f in fps} == root


def test_one_of_each_component_stays(spark, tmp_path):
    """The stage keeps the smallest id of every component of fingerprints within 4 bits, as op4 has them."""
    rng = np.random.default_rng(8)
    rows = [(None, "no id but a text of its own"), (7, None), (6, ""), (400, "no id but a text of its own")]
    for i in range(40):
        base = [f"w{k}" for k in rng.integers(0, 5000, rng.integers(30, 300))]
        for changes in (0, 0, 1, 2, 3, 5, 8):
            copy = list(base)
            for k in rng.integers(0, len(base), changes):
                copy[k] = f"x{rng.integers(0, 5000)}"
            rows.append((1000 + len(rows), " ".join(copy)))
    rows = [rows[k] for k in rng.permutation(len(rows))] + [(6, "")]
    docs = [(d, t, d, "x", t) for d, t in rows]
    path = str(tmp_path / "t")
    spark.createDataFrame(docs, "doc_id long, text string, row long, row_ string, component_id string").repartition(3).write.parquet(path)
    fps = [simhash_of(t) for _, t in rows]
    root = list(range(len(rows)))
    near = [(a, b) for a in root for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    for _ in range(8):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    groups = collections.defaultdict(list)
    for k, r in enumerate(root):
        groups[r].append((rows[k][0] is None, rows[k][0]))
    kept = simhash.keep_one_of_each(spark.read.parquet(path))
    assert kept.columns == ["doc_id", "text", "row", "row_", "component_id"]
    got = kept.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((n, i or 0) for n, i in map(min, groups.values()))
    assert all(r.row == r.doc_id and r.row_ == "x" and r.component_id == r.text for r in got)


CLASHING = "doc_id long, text string, lang string, source string, row_ string, row string, spans string, left_ int, left int, others string, found_ int, found int, start long, size long"


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows = [(i, f"{PASSAGE} {i}\nsome line of its own {i}\n{PASSAGE}", "en", "a", "r", "s", "p", i, i, "o", i, i, 5, 6) for i in range(6)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, CLASHING).write.parquet(path)
    table = spark.read.parquet(path)
    model = language.fit_language(table)
    for out in (linededup.delete_repeated_lines(table), simhash.keep_one_of_each(table), language.with_language(table, model), mixing.mix_documents(table)):
        assert set(table.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns))
        for r in out.collect():
            assert (r.row_, r.row, r.spans, r.others, r.start) == ("r", "s", "p", "o", 5) and r.left_ == r.left == r.found_ == r.found == r.doc_id


def test_row_numbers_do_not_follow_the_cores(spark, tmp_path):
    """Planned for one core and then for many, every row has the same number."""
    path = str(tmp_path / "t")
    spark.range(40_000).selectExpr("id AS doc_id", "repeat('x', 20) AS text").repartition(2).write.parquet(path)
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    seen = []
    try:
        for cores in ("1", "64"):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
            seen.append(sorted(map(tuple, with_row(spark.read.parquet(path)).select("doc_id", "row_").collect())))
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if before is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)
    assert seen[0] == seen[1] and len({r for _, r in seen[0]}) == 40_000


def test_borders_of_words_beyond_ascii():
    """Every character that is punctuation, a symbol or a space is a border, and no other."""
    old = re.compile("[" + "".join(c for c in map(chr, range(128, 0x10000)) if unicodedata.category(c)[0] in "PSZ") + "]")
    every = "".join(c for c in map(chr, range(1, 0x10000)) if not 0xD800 <= ord(c) <= 0xDFFF)
    assert every.translate(toxicity.borders()) == old.sub(" ", every)
    high = "".join(map(chr, range(0x10000, 0x110000)))
    assert all((b == " ") == (unicodedata.category(a)[0] in "PSZ") for a, b in zip(high, high.translate(toxicity.borders())))


def lines_deleted(rows, least=5):
    """Brute force: lines in any run of ``least`` words that also starts earlier."""
    runs, out = {}, collections.defaultdict(set)
    for d, t in rows:
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(words(x)) for x in lines[a : b + 1]) >= least:
                    if runs.setdefault(tuple(lines[a : b + 1]), (d, a)) != (d, a):
                        out[d].update(range(a, b + 1))
    return out


def test_line_runs_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    pool = ["one", "two words", "three short words", "a line with five words", "", " ", "x y z w", "a longer line that has many more words"]
    rows = [(i, "\n".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(0, 9)))) for i in range(60)] + [(60, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    want = lines_deleted(rows)
    got = {r.doc_id: r for r in linededup.repeated_lines(docs).collect()}
    assert {d: r.n_deleted for d, r in got.items()} == {d: len(want[d]) for d, _ in rows}
    kept = {r.doc_id: r.text for r in linededup.delete_repeated_lines(docs).collect()}
    for d, t in rows:
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        left = [x for k, x in enumerate(lines) if k not in want[d]]
        assert (d in kept) == (not want[d] or bool(left))
        if d in kept:
            assert [x for x in (kept[d] or "").split("\n") if WORD.search(x)] == left


def test_line_dedup_of_odd_rows(docs):
    got = linededup.delete_repeated_lines(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 6, 7, 9, 10]
    assert got.where("doc_id = 1").first().text == ROWS[0][1].rsplit("\n", 1)[0]


def bytes_left(rows, n=100):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for s in range(len(data) - n + 1):
            if data[s : s + n] in seen:
                gone[s : s + n] = True
            seen.add(data[s : s + n])
        rest = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
        out.append((d, len(data), int(gone.sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [False, True])
def test_byte_repeats_against_brute_force(spark, tmp_path, hot, monkeypatch):
    rng = np.random.default_rng(9)
    parts = ["".join(rng.choice(list("ab c"), 130)) for _ in range(6)] + ["z" * 240, "é" * 70, "q"]
    rows = [(i, "".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 7)))) for i in range(40)] + [(40, None), (None, parts[0])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    if hot:
        found = substrings.find_contexts(docs.withColumn("row_", F.monotonically_increasing_id()), [])
        names = [r.x for r in found.where(f"kind = {substrings.CONTEXT}").select("x").distinct().collect()][::2]
        monkeypatch.setattr(substrings, "hot_anchors", lambda store, rows: names)
    got = substrings.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == bytes_left(rows)


def test_byte_repeats_of_odd_rows(docs):
    got = sorted(map(tuple, substrings.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect()), key=str)
    assert got == bytes_left([(i, t) for i, t, *_ in ROWS])


def test_toxicity_learns(spark):
    plain = [f"some ordinary words about item{i} and the weather" for i in range(200)]
    rows = [(i, t + (" you awful wretch" if i % 3 == 0 else ""), i % 3 == 0) for i, t in enumerate(plain)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [(got[i].score, x) for i, _, x in rows if got[i].held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert min(s for s, x in held if x) > max(s for s, x in held if not x) and got[900].score == got[901].score
    assert {i for i in got if got[i].held_out} == {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1}


def test_toxicity_spells_every_byte():
    for text in ("short words and averyveryverylongcompoundword", "字" * 40, "full，width。marks", "a" * 12, ""):
        data = toxicity.letters(text)
        steps = list(toxicity.spelled(data))
        places = np.sort(np.concatenate([at for _, at, _, _ in steps])) if steps else np.zeros(0, int)
        assert places.tolist() == list(range(1, len(data)))
        assert all((toxicity.letters(text)[at] >= 0).all() and len(b) == len(w) == len(at) for _, at, b, w in steps)
    ends = [np.concatenate([w for _, _, _, w in toxicity.spelled(toxicity.letters(t))]) for t in ("donaudampfschiffkind", "donaudampfschiffhund")]
    assert (ends[0] != ends[1]).any()
    assert toxicity.letters("full，width。marks").tobytes() == b" full width marks "


def test_language_learns(spark):
    rng = np.random.default_rng(4)
    syllables = {"xa": ["ka", "lo", "mi"], "yb": ["stru", "gne", "pfo"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[la], 3)) for _ in range(20)), la) for i in range(200) for la in [("xa", "yb")[i % 2]]]
    docs = spark.createDataFrame(rows + [(900, None, "xa"), (901, "12 !?", "yb"), (902, "KALO mika", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify_languages(docs).collect()}
    assert all(got[i].lang_pred == la for i, _, la in rows) and got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "xa"
    kept = {r.doc_id for r in language.keep_identified(docs).collect()}
    assert kept >= {i for i, *_ in rows} and not kept & {900, 901}


def test_leaks_against_brute_force(docs, spark):
    bench = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, PASSAGE.replace("brown", "red")), (3, None), (4, "!?"), (5, "words that stand nowhere else in any text")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == {(d, i) for d in (6, 7, 8) for i in (1, 2)}
    left = decontamination.drop_leaks(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {None, 1, 2, 3, 4, 5, 9, 10}


def leaks_between(spark, rows, items):
    """Pairs found, and pairs by brute force: the common subsequence covers 0.8 of the item, or 0.6 and its last words."""
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()}
    want = set()
    for d, text in rows:
        for i, item in items:
            own, passage = item.encode().split(), text.encode().split()
            if len(set(own) & set(passage)) < 0.5 * len(set(own)):
                continue
            share = decontamination.common_words(own, passage) / len(own)
            if share >= 0.8 or share >= 0.6 and decontamination.common_words(own[-6:], passage) == len(own[-6:]):
                want.add((d, i))
    return got, want


def prose(rng, n):
    return [f"w{int(k)}" for k in np.minimum(rng.zipf(1.2, n), 3000 + rng.integers(0, 3000, n))]


def test_large_benchmarks_lose_no_copies(spark):
    rng = np.random.default_rng(11)
    items = [(i, " ".join(prose(rng, 40))) for i in range(1500)]
    rows = [(d, " ".join([*prose(rng, 50), items[int(i)][1], *prose(rng, 50)])) for d, i in enumerate(rng.choice(1500, 200, replace=False))]
    got, want = leaks_between(spark, rows, items)
    assert len(want) >= 200 and got == want


def test_shortened_and_reworded_items_are_found(spark):
    rng = np.random.default_rng(12)
    items = [(i, " ".join(prose(rng, rng.integers(15, 60)))) for i in range(100)]
    rows = []
    for d in range(600):
        own = items[d % 100][1].split()
        free = rng.permutation(len(own) - 6)[: int(len(own) * rng.uniform(0.15, 0.39))]
        reworded = d % 2
        kept = [prose(rng, 1)[0] if k in free else w for k, w in enumerate(own) if reworded or k not in free]
        rows.append((d, " ".join([*prose(rng, rng.integers(0, 90)), *kept, *prose(rng, rng.integers(0, 90))])))
    got, want = leaks_between(spark, rows, items)
    planted = {(d, d % 100) for d, _ in rows} & want
    assert len(planted) >= 550 and planted <= got <= want


def test_items_of_any_length_are_found(spark):
    rng = np.random.default_rng(13)
    lengths = (2, 3, 5, 6, 9, 12, 24, 47, 49, 80, 150, 300, 700)
    items = [(i, " ".join(f"w{k}" for k in rng.integers(0, 4000, n))) for i, n in enumerate(lengths * 4)]
    rows = [(d, " ".join([*prose(rng, 200 + d), text, *prose(rng, 200)])) for d, text in items]
    got, want = leaks_between(spark, rows, items)
    planted = {(d, d) for d, _ in rows}
    assert planted <= got <= want


def test_common_words_is_the_longest_common_subsequence():
    rng = np.random.default_rng(6)
    for _ in range(100):
        a, b = ([bytes([c]) for c in rng.integers(97, 101, n)] for n in rng.integers(0, 12, 2))
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontamination.common_words(a, b) == table[-1, -1]


@pytest.mark.parametrize("block", [7, 1000])
def test_token_counts_round_trip(docs, block):
    encoding = tokencounts._encoding(tokencounts.VOCABULARY)
    want = sorted(((i, len(encoding.encode_ordinary(t or ""))) for i, t, *_ in ROWS), key=str)
    assert sorted(map(tuple, tokencounts.count_tokens(docs, block_tokens=block).collect()), key=str) == want


def test_raw_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokencounts, "GROUP_BLOCKS", 3)
    runs = {"a.bin": [5, 5, 9, 9, 1, 2, 3, 4, 5, 6, 7, 8, 9, 1], "b.bin": [9], "c.bin": [1, 2, 3], "d.bin": []}
    for name, tokens in runs.items():
        (tmp_path / name).write_bytes(np.array(tokens, dtype="<u2").tobytes())
    blocks = tokencounts.read_token_files(spark, str(tmp_path), block_tokens=2)
    got = tokencounts.stitch_blocks(tokencounts.scan_blocks(blocks, end=9)).collect()
    assert sorted((r.file[-5:], r.ordinal, r.n_tokens, r.closed) for r in got) == [
        ("a.bin", 0, 2, True), ("a.bin", 1, 0, True), ("a.bin", 2, 8, True), ("a.bin", 3, 1, False), ("b.bin", 0, 0, True), ("c.bin", 0, 3, False),
    ]


def test_pipeline_runs_on_odd_rows(docs, spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} <= {None, 1, 5, 10} and [n for n, _ in pipeline.STAGES][0] == "language_id"
