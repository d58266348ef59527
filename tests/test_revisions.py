"""Scores of files that arrive again: equal to a scan of the last versions, whatever the order and however often."""

import itertools

import pytest

import codefootprint as cf
from codefootprint.streaming import Revisions

SCHEMA = "repo_id string, path string, length bigint, content string, version bigint, deleted boolean"
LOOP = "for i in xs:\n    for j in ys:\n        use(i, j)\n"
PRINT = "print(1)\n"
ARRIVALS = [
    [("r", "a.py", LOOP, 0, False), ("r", "b.py", PRINT, 0, None), ("s", "a.py", LOOP, 3, False), ("r", "node_modules/x.py", LOOP, 0, False)],
    [("r", "a.py", PRINT, 1, False), ("s", "a.py", PRINT, 2, False), ("t", "q.sql", "SELECT * FROM t;\n", 0, False)],
    [("r", "b.py", None, 1, True), ("t", "q.sql", "SELECT a FROM t WHERE b = 1;\n", 5, False), ("t", "q.sql", LOOP, 4, False)],
    [("r", "b.py", LOOP, 0, False), ("s", "new.py", "def broken(:\n", 0, False), ("s", "new.py", "x = 1\n", None, False)],
]
LAST = {("r", "a.py"): PRINT, ("s", "a.py"): LOOP, ("t", "q.sql"): "SELECT a FROM t WHERE b = 1;\n", ("s", "new.py"): "def broken(:\n"}


def batch_of(spark, rows):
    return spark.createDataFrame([(r, p, len(c) if c else None, c, v, d) for r, p, c, v, d in rows], SCHEMA)


def state(spark, output):
    scores = sorted(tuple(r) for r in cf.current_scores(spark, output).select("repo_id", "total_files", "code_files", "total_code_lines", "total_violations", "penalty", "score", "grade").collect())
    files = sorted((r.repo_id, r.path, sorted(f.rule_id for f in r.findings), r.error is None) for r in cf.current_files(spark, output).collect())
    return scores, files


@pytest.fixture(scope="module")
def expected(spark, files_of):
    scanned = cf.scan_files(files_of([(r, p, c) for (r, p), c in LAST.items()]))
    scores = sorted(tuple(r) for r in cf.scan_scores(scanned).select("repo_id", "total_files", "code_files", "total_code_lines", "total_violations", "penalty", "score", "grade").collect())
    return scores, sorted((r.repo_id, r.path, sorted(f.rule_id for f in r.findings), r.error is None) for r in scanned.collect())


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)])
def test_any_order_gives_the_scores_of_the_last_versions(spark, tmp_path, order, expected):
    revisions = Revisions(spark, str(tmp_path / "out"), buckets=2)
    for number, k in enumerate(order):
        assert revisions.apply(batch_of(spark, ARRIVALS[k]), cf.DEFAULT_RULES, "q", number)
    assert state(spark, str(tmp_path / "out")) == expected


def test_replayed_batches_change_nothing_and_compaction_keeps_all(spark, tmp_path, expected):
    output = str(tmp_path / "out")
    revisions = Revisions(spark, output, buckets=2)
    for number, rows in enumerate(ARRIVALS):
        assert revisions.apply(batch_of(spark, rows), cf.DEFAULT_RULES, "q", number)
        assert not revisions.apply(batch_of(spark, rows), cf.DEFAULT_RULES, "q", number)
        if number == 2:
            before = state(spark, output)
            revisions.compact()
            assert state(spark, output) == before and len(revisions.commits.read()["files"]) == 1
            revisions.commits.vacuum(keep=1)
            assert state(spark, output) == before
    assert state(spark, output) == expected
    # the same files from another stream: equal versions replace themselves
    assert revisions.apply(batch_of(spark, list(itertools.chain(*ARRIVALS))), cf.DEFAULT_RULES, "other", 0)
    assert state(spark, output) == expected


def test_a_batch_that_fails_half_way_is_not_seen(spark, tmp_path, monkeypatch, expected):
    output = str(tmp_path / "out")
    revisions = Revisions(spark, output, buckets=2)
    revisions.apply(batch_of(spark, ARRIVALS[0]), cf.DEFAULT_RULES, "q", 0)
    before = state(spark, output)
    with monkeypatch.context() as m:
        m.setattr(type(revisions.commits), "commit", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            revisions.apply(batch_of(spark, ARRIVALS[1]), cf.DEFAULT_RULES, "q", 1)
    assert state(spark, output) == before
    for number, rows in enumerate(ARRIVALS[1:], 1):  # another number of buckets is asked for, the first one holds
        Revisions(spark, output, buckets=5).apply(batch_of(spark, rows), cf.DEFAULT_RULES, "q", number)
    assert state(spark, output) == expected


def test_stream_restarts_and_empty_output(spark, tmp_path, expected):
    output, source, checkpoint = (str(tmp_path / x) for x in ("out", "in", "checkpoint"))
    assert cf.current_scores(spark, output).collect() == [] and cf.current_files(spark, output).collect() == []
    for k, rows in enumerate(ARRIVALS):
        batch_of(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        cf.start_scores(stream, output, checkpoint, compact_every=2, buckets=2).awaitTermination()
    assert state(spark, output) == expected
    counts = {(r.repo_id, r.rule_id): r.findings for r in cf.current_counts(spark, output).filter("rule_id IS NOT NULL").collect()}
    assert counts == {("r", "GC040"): 1, ("s", "GC001"): 1}
