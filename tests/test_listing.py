"""Listings and trees: hidden files, ignored folders, unreadable files, equal shares, admitted members."""

from pyspark.sql import functions as F

import codefootprint as cf
from codefootprint.sources import files_from_listing, files_from_tree, list_tree, packed


def test_a_vanished_file_is_a_row_without_content(spark, tmp_path):
    (tmp_path / ".hidden.py").write_text("x = 1\n")
    listing = spark.createDataFrame(
        [("one", p, f"file://{tmp_path}/{p}") for p in (".hidden.py", "gone.py")], "repo_id string, path string, uri string"
    )
    files = files_from_listing(listing)
    assert [(r.path, r.length) for r in files.orderBy("path").collect()] == [(".hidden.py", 6), ("gone.py", None)]
    scanned = {r.path: r.status for r in cf.scan_files(files).collect()}
    assert scanned == {".hidden.py": "scanned", "gone.py": "no content"}


def tree(root):
    (root / "one" / "src" / ".hidden").mkdir(parents=True)
    (root / "one" / "node_modules" / "deep").mkdir(parents=True)
    (root / ".two" / "build").mkdir(parents=True)
    (root / "empty").mkdir()
    for name, text in {
        "one/a.py": "print(1)\n", "one/src/__init__.py": "", "one/src/.hidden.py": "x = 1\n", "one/src/.hidden/b.py": "never",
        "one/node_modules/deep/c.js": "never", ".two/ä b%20.sql": "SELECT 1;\n", ".two/build/d.py": "never", "loose.txt": "root file",
    }.items():
        (root / name).write_text(text)
    (root / "one" / "src" / "loop").symlink_to(root / "one")
    return str(root)


EXPECTED = [("", "loose.txt"), (".two", "ä b%20.sql"), ("one", "a.py"), ("one", "src/.hidden.py"), ("one", "src/__init__.py")]


def test_a_tree_is_listed_without_entering_ignored_folders(spark, tmp_path, monkeypatch):
    root = tree(tmp_path / "files")
    listing = list_tree(spark, root, str(tmp_path / "work"))
    assert sorted((r.repo_id, r.path) for r in listing.collect()) == EXPECTED
    assert {r.path: r.length for r in listing.collect()}["src/.hidden.py"] == 6
    (tmp_path / "files" / "one" / "node_modules").chmod(0)  # entering it would fail or be seen
    files = files_from_tree(spark, f"file://{root}", str(tmp_path / "work"))
    assert sorted((r.repo_id, r.path) for r in files.collect()) == EXPECTED
    assert {r.path: bytes(r.content) for r in files.collect()}["ä b%20.sql"] == b"SELECT 1;\n"
    own = list_tree(spark, root, str(tmp_path / "work"), ignored_dirs={"src"})
    assert not any(r.path.startswith("src/") for r in own.collect())
    (tmp_path / "files" / "one" / "node_modules").chmod(0o755)


def test_an_empty_root_and_a_missing_one(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert files_from_tree(spark, str(tmp_path / "none"), str(tmp_path / "work")).collect() == []
    gone = files_from_tree(spark, str(tmp_path / "gone"), str(tmp_path / "work")).collect()
    assert [(r.length, r.content) for r in gone] == [(None, None)]


def test_packs_hold_about_the_same_bytes(spark):
    rows = [("r", f"small{i}", f"file:///s{i}", 10) for i in range(3000)] + [("r", f"large{i}", f"file:///l{i}", 5000) for i in range(4)]
    rows += [("r", "unread", "file:///u", None)]
    listing = spark.createDataFrame(rows, "repo_id string, path string, uri string, length bigint")
    dealt = packed(listing, pack_bytes=1000, pack_files=400, bucket_files=700)
    parts = dealt.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))
    held = parts.collect()
    assert dealt.count() == 3005 and sorted(map(tuple, dealt.select("path").collect())) == sorted((p,) for _, p, _, _ in rows)
    assert max(r.files for r in held) <= 400 and sum(r.bytes > 1100 for r in held if r.bytes) <= 4 and len(held) >= 30
    many = packed(listing.filter("path LIKE 'small%'"), pack_bytes=1 << 30, pack_files=100, bucket_files=700)
    assert max(r["count"] for r in many.groupBy(F.spark_partition_id().alias("p")).count().collect()) <= 101


def test_contents_of_refused_repositories_are_not_moved(spark, tmp_path):
    rows = [("ok", "a.py", 3, "abc", True), ("ok", "../b.py", 3, "bad", True), ("ok", "link", 0, "", False), ("big", "c.py", 9999, "x" * 9, True)]
    path = str(tmp_path / "members")
    spark.createDataFrame(rows, "repo_id string, path string, length bigint, content string, is_regular boolean").write.parquet(path)
    members = spark.read.parquet(path)
    for limit in (100, 0):
        kept = cf.admitted_files(members, max_bytes=100, broadcast_repos=limit)
        assert [tuple(r) for r in kept.select("repo_id", "path", "content").collect()] == [("ok", "a.py", "abc")]
    plan = cf.admitted_files(members, max_bytes=100)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    for line in plan.splitlines():
        assert "Exchange hashpartitioning" not in line or "content" not in line
