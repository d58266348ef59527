"""Outputs of several tables: whole or not at all, and one scan for all of them."""

import json

import pytest
from pyspark.sql import functions as F

import codefootprint as cf
from codefootprint.plans import scan
from codefootprint.sources import Commits, read_committed

SOURCES = {"a.py": "for i in xs:\n    for j in ys:\n        use(i, j)\n", "b.py": "def broken(:\n", "c.sql": "SELECT * FROM t;\n"}


def test_readers_follow_the_last_commit(spark, tmp_path):
    commits = Commits(spark, str(tmp_path / "out"))
    assert commits.versions() == [] and commits.read() == {} and commits.info() == {}
    for n in range(3):
        folder = commits.folder("t")
        spark.range(n + 1).write.parquet(folder)
        assert commits.commit({"t": [folder]}, {"rows": n + 1}) == n
        assert read_committed(spark, commits.root, "t").count() == n + 1 == commits.info()["rows"]
    assert read_committed(spark, commits.root, "t", version=0).count() == 1
    with pytest.raises(FileExistsError):
        commits.commit({"t": []}, version=1)
    with pytest.raises(FileNotFoundError):
        read_committed(spark, commits.root, "other")
    lost = commits.folder("t")
    spark.range(9).write.parquet(lost)  # of a run that failed
    assert len(commits.vacuum(keep=2)) == 2 and commits.versions() == [1, 2]
    assert read_committed(spark, commits.root, "t").count() == 3 and read_committed(spark, commits.root, "t", 1).count() == 2


def test_a_run_that_fails_between_outputs_leaves_the_old_one_whole(spark, files_of, tmp_path, monkeypatch):
    root = str(tmp_path / "run")
    cf.write_run(cf.scan_files(files_of(SOURCES)), root, buckets=2)

    def state():
        tables = {t: read_committed(spark, root, t).count() for t in ("scanned", "file_stats", "violations", "errors")}
        return tables | {t: read_committed(spark, root, t, fmt="json").count() for t in ("repositories", "findings", "report_errors")}

    before = state()
    assert before == {"scanned": 3, "file_stats": 3, "violations": 3, "errors": 1, "repositories": 1, "findings": 3, "report_errors": 1}
    more = cf.scan_files(files_of([("r", "z.py", "print(1)\n"), ("s", "y.py", "print(2)\n")]))
    plain, written = scan.write_bucketed, []

    def failing(rows, path, *rest):
        if len(written) == 2:
            raise OSError("disk is gone")
        written.append(path)
        plain(rows, path, *rest)

    monkeypatch.setattr(scan, "write_bucketed", failing)
    with pytest.raises(OSError):
        cf.write_run(more, root, buckets=2)
    assert state() == before
    monkeypatch.setattr(scan, "write_bucketed", plain)
    cf.write_run(more, root, buckets=2)
    assert state()["scanned"] == 2 and state()["repositories"] == 2


def test_a_lazy_scan_runs_once_for_all_outputs(spark, files_of, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    files = files_of({f"f{i}.py": "print(1)\n" for i in range(7)})
    scanned = cf.scan_files(files.mapInArrow(seen, files.schema))
    cf.write_run(scanned, str(tmp_path / "once"), buckets=2)
    assert read.value == 7
    document = read_committed(spark, str(tmp_path / "once"), "repositories", fmt="json").select("document").first()[0]
    assert json.loads(document)["index"]["total_violations"] == 7


def test_tables_of_a_run_agree(spark, files_of, tmp_path):
    root = str(tmp_path / "tables")
    version = cf.write_tables(cf.scan_files(files_of(SOURCES)), root, buckets=3)
    found = read_committed(spark, root, "violations", version)
    assert sorted(r.rule_id for r in found.select("rule_id").collect()) == ["GC001", "GC030", "GC031"]
    assert read_committed(spark, root, "scanned", version).agg(F.sum(F.size("findings"))).first()[0] == 3
