"""Trees in waves: few jobs a wave, a folder written by one task, one scan of all that was read."""

import os

from pyspark.sql import functions as F

import codefootprint as cf
from codefootprint.sources import list_tree
from workloads import corpora, registry


def test_all_waves_are_scanned_by_one_plan(spark, tmp_path, monkeypatch):
    calls = {"scan_files": [], "files_from_tree": []}
    for name, seen in calls.items():
        monkeypatch.setattr(cf, name, lambda *a, seen=seen, call=getattr(cf, name), **k: (seen.append(a), call(*a, **k))[1])
    monkeypatch.setattr(registry, "WAVE_FILES", 100)
    spark.range(300).select(F.col("id").alias("event_id"), (F.col("id") % 9).alias("user_id")).write.parquet(
        str(tmp_path / "events.parquet")
    )
    found = registry.scan_listing(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        map(tuple, cf.file_stats(cf.scan_files(corpora.code(spark, str(tmp_path)))).collect()), key=str
    )
    assert len(calls["files_from_tree"]) == 4 and len(calls["scan_files"]) == 2, "a wave planned a scan of its own"


def test_a_folder_is_written_by_one_task(spark, tmp_path):
    rows = [(str(k % 5), f"src{k % 3}/f{k}.py", f"x = {k}\n") for k in range(300)]
    files = spark.createDataFrame([*rows, ("0", "top.py", "x\n")], "repo_id string, path string, content string").repartition(8)
    dealt = corpora.by_folder(files).select("repo_id", "path", F.spark_partition_id().alias("task")).collect()
    order = [(r.task, r.repo_id, r.path.rpartition("/")[0]) for r in dealt]
    begun = [place for k, place in enumerate(order) if k == 0 or order[k - 1] != place]
    assert len(begun) == 16 and len({task for task, _, _ in begun}) > 1
    corpora.write_tree(files, f"file://{tmp_path}/tree")
    assert sum(len(names) for _, _, names in os.walk(tmp_path / "tree")) == 301


def test_levels_of_a_small_tree_share_a_job_and_those_of_a_large_one_are_dealt_anew(spark, tmp_path):
    for repo in ("one", "two"):
        folder = tmp_path / "files" / repo / "a" / "b" / "c" / "d"
        folder.mkdir(parents=True)
        for k in range(20):
            (folder / f"{k}.py").write_text("x\n")
            (folder.parent / f"{k}").mkdir()
            (folder.parent / f"{k}" / "y.py").write_text("x\n")
    expected = sorted(
        (repo, path) for repo in ("one", "two") for k in range(20) for path in (f"a/b/c/d/{k}.py", f"a/b/c/{k}/y.py")
    )
    jobs = {}
    for descend in (1_000, 10, 1):
        work = tmp_path / f"work{descend}"
        listing = list_tree(spark, str(tmp_path / "files"), str(work), descend=descend)
        assert sorted((r.repo_id, r.path) for r in listing.collect()) == expected
        (run,) = work.iterdir()
        jobs[descend] = len(list(run.iterdir()))
    assert jobs == {1_000: 2, 10: 3, 1: 6}


def test_files_go_before_their_folders(spark, tmp_path):
    for name in ("r1/a/b/c.py", "r1/d.py", "r2/.cache/e.py"):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text("x\n")
    (tmp_path / "tree" / "r3").mkdir()
    root = f"file://{tmp_path}/tree"
    corpora.next_root(root, f"file://{tmp_path}/next")
    corpora.remove_files(spark, root)
    left = {os.path.relpath(f, tmp_path): names for f, _, names in os.walk(tmp_path)}
    assert set(left) == {".", "next", "tree", "tree/r1", "tree/r1/a", "tree/r1/a/b", "tree/r2", "tree/r2/.cache", "tree/r3"}
    assert not any(left.values())
    corpora.remove_folders(root)
    assert os.listdir(tmp_path) == ["next"]
